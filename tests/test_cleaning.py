from datetime import date

import pytest
from pyspark.sql import functions as F

from trialframe.functions import scalar as S
from trialframe.operators import cleaning as C
from trialframe.operators import windows as W
from trialframe.sources import OBSERVATIONS, expand_levels, factor_grid, read_csv, spaced_offsets


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_csv_reads_missing_values_and_tidies_names(spark, tmp_path):
    names = [f.name for f in OBSERVATIONS.fields]
    line = "7,Cold,Final,2021-08-25,NA,5.5,NA,2,10.25,1,2,NA,3"
    # columns in another order than the schema
    shuffled = list(reversed(names))
    path = tmp_path / "observations.csv"
    path.write_text(",".join(shuffled) + "\n" + ",".join(reversed(line.split(","))) + "\n")
    df = read_csv(spark, str(path), OBSERVATIONS)
    got = df.first().asDict()
    assert got["rhi_id"] == 7 and got["harvest_date"] == date(2021, 8, 25)
    assert got["leaf_area_cm2"] is None and got["rhi_initial_fw_g"] is None
    assert got["starch_rhi"] == 10.25 and "root_g" in got
    inferred = read_csv(spark, str(path))
    assert dict(inferred.dtypes)["starch_rhi"] == "double"


def test_outlier_mask_keeps_rows_and_ignores_unknown(spark):
    df = spark.createDataFrame(
        [(1, 3.0, 1.0), (2, 9.0, 1.0), (3, None, 1.0), (4, 3.0, None), (5, None, None), (6, 30.0, 5.0)],
        "id int, a double, b double",
    )
    rules = [("a", F.col("a") < 6), ("b", F.col("a").isNotNull() & (F.col("b") < 2)), ("a", F.col("a") > 27)]
    assert rows(C.outlier_mask(df, rules), "id") == [
        (1, None, 1.0),  # masked first, so the second rule no longer sees it
        (2, 9.0, None),
        (3, None, 1.0),
        (4, None, None),
        (5, None, None),
        (6, None, 5.0),
    ]


def test_duplicate_mask_keeps_first_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, "p", 5.0, 1.0), (2, "q", 5.0, 1.0), (3, "p", None, 2.0), (4, "q", None, 2.0), (5, "p", 6.0, None), (6, "p", 5.0, 3.0)],
        "id int, plant string, a double, b double",
    ).repartition(4)
    out = C.duplicate_mask(df, ["a", "b"], "id").select("id", "a", "b")
    assert rows(out, "id") == [
        (1, 5.0, 1.0), (2, None, None), (3, None, 2.0), (4, None, None), (5, 6.0, None), (6, None, 3.0),
    ]
    keyed = C.duplicate_mask(df, ["a"], "id", keys=["plant"]).select("id", "a")
    assert rows(keyed, "id") == [(1, 5.0), (2, 5.0), (3, None), (4, None), (5, 6.0), (6, None)]


def test_membership_flag_null_key_is_outside(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    dead = spark.createDataFrame([(2,), (2,), (None,)], "id int")
    got = dict(C.membership_flag(df, dead, "id").collect())
    assert got == {1: "alive", 2: "dead", None: "alive"}


def test_membership_flag_beyond_the_broadcast_bound(spark, monkeypatch):
    import trialframe.session as session

    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    flagged = C.membership_flag(df, spark.createDataFrame([(2,)], "id int"), "id")
    assert rows(flagged, "id") == [(1, "alive"), (2, "dead"), (2, "dead")]


def test_three_valued_choices(spark):
    df = spark.createDataFrame([(None,), ("2021-04-24",), ("2021-04-25",)], "d string")
    got = [r[0] for r in df.select(S.phase_label("d", "2021-04-25", "Storage", "Growth")).collect()]
    assert got == [None, "Storage", "Growth"]


def test_signif_code_at_the_limits(spark):
    df = spark.createDataFrame([(0.049,), (0.05,), (0.07,), (0.1,), (None,)], "p double")
    assert [r[0] for r in df.select(S.signif_code("p")).collect()] == ["*", None, ".", None, None]


def test_null_tolerant_and_bounds(spark):
    df = spark.createDataFrame([(60, 1.0), (60, 2.0), (80, 2.0), (130, 4.0), (60, None), (10, None)], "x int, v double")
    kept = df.where(S.time_varying_bounds("x", "v", [(50, 1.2), (75, 2.5), (120, 4.2)]))
    assert rows(kept, "x") == [(10, None), (60, 2.0)]
    assert df.where(S.null_tolerant("v", F.col("v") < 2)).count() == 3


def test_formula_anchors(spark):
    row = spark.range(1).select(
        S.q10(F.lit(0.0101), F.lit(0.0538), F.lit(5.0), F.lit(25.0)),
        S.relocation_estimate(F.lit(6.0), F.lit(0.15), F.lit(0.3), F.lit(0.4)),
        S.relative_to(F.lit(1.0), F.lit(0.0)),
    ).first()
    assert row[0] == pytest.approx(2.308, abs=5e-4)
    assert row[1] == pytest.approx(300.0)
    assert row[2] is None


def test_grids_and_offsets(spark):
    levels = spark.createDataFrame([("Cold",), ("Room",)], "treatment string")
    grid = factor_grid(levels, 1, 180)
    assert grid.count() == 360 and grid.select("x").distinct().count() == 180
    assert expand_levels(levels, days=[8, 14]).count() == 4
    days = spark.createDataFrame([(d,) for d in (3, 1, 2, 3, None)], "x int")
    out = spaced_offsets(days, "x", {"Cold": (0, -8), "Room": (-2, -10)})
    assert rows(out, "treatment", "x") == [
        (1, "Cold", 0.0), (2, "Cold", -4.0), (3, "Cold", -8.0),
        (1, "Room", -2.0), (2, "Room", -6.0), (3, "Room", -10.0),
    ]


def test_rank_by_frequency_counts_rows_with_missing_columns(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, None), (1, "a"), (2, "b"), (3, "a"), (3, "b")], "id int, k string"
    )
    got = [tuple(r) for r in W.rank_by_frequency(df, "id", ["k"]).select("id", "k", "n", "freq").collect()]
    assert got == [(2, "b", 1, 1), (3, "a", 1, 2), (3, "b", 1, 2), (1, "a", 2, 3)]


def test_windows(spark):
    df = spark.createDataFrame(
        [("v", "Cold", x, v) for x, v in ((1, 1.0), (2, 4.0), (4, 9.0), (7, 10.0))],
        "family string, treatment string, x int, value double",
    )
    assert [r.rate for r in W.daily_rate(df).orderBy("x").collect()] == [0.0, 3.0, 5.0, 1.0]
    assert [r.loss for r in W.interval_loss(df).orderBy("x").collect()] == [None, -3.0, -5.0, -1.0]
    area = W.accumulated_area(df, 0.5, "value").orderBy("x").collect()
    assert [r.elapsed for r in area] == [1, 3, 6, None]
    assert [r.accumulated for r in area] == [0.25, 3.75, 21.0, None]
    stage = W.stage_window(df).first()
    assert (stage.start_x, stage.end_x) == (2, 2)
    empty = W.stage_window(df.withColumn("value", F.lit(None).cast("double"))).first()
    assert empty.start_x is None


def test_global_rank_over_several_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.xxhash64("id") % 1000003).alias("v")).distinct()
    got = [(r.rank, r.v) for r in W.global_rank(df, "v").orderBy("v").collect()]
    assert [r for r, _ in got] == list(range(len(got)))


def test_duplicates_keep_their_type(spark):
    df = spark.createDataFrame(
        [(1, 2**53, "a", 0.0), (2, 2**53 + 1, "a", -0.0), (3, 2**53, "b", float("nan")), (4, None, None, float("nan"))],
        "id int, n long, s string, d double",
    )
    got = rows(C.duplicate_mask(df, ["n", "s", "d"], "id"), "id")
    assert got == [(1, 2**53, "a", 0.0), (2, 2**53 + 1, None, None), (3, None, "b", None), (4, None, None, None)]
    assert dict(C.duplicate_mask(df, ["n", "s"], "id").dtypes)["n"] == "bigint"


def test_row_ids_follow_files_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n0\n")
    (tmp_path / "b.csv").write_text("v\n" + "\n".join(str(i) for i in range(1, 51)) + "\n")
    df = read_csv(spark, str(tmp_path), row_id="at")
    assert [r.v for r in df.orderBy("at").collect()] == list(range(51))
