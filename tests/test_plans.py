"""What the physical plans may and may not hold."""

import re

import pytest
from pyspark.sql import functions as F

from trialframe.catalog import standins
from trialframe.catalog.base import table
from trialframe.operators import cleaning, windows
from trialframe.operators.cells import cell_stats, line_moments
from trialframe.session import materialize

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_cell_statistics_read_only_their_columns_and_combine_before_the_shuffle(spark):
    text = plan(cell_stats(standins.lineitem(spark, FOLDER), standins.RESPONSES, "l_linestatus", "l_linenumber"))
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "l_orderkey" not in schema and "l_shipdate" not in schema
    assert text.count("Exchange") <= 4  # one exchange, named in tree and details
    assert "partial_count" in text and "Python" not in text and "Arrow" not in text


def test_line_moments_are_one_exchange_without_python(spark):
    text = plan(line_moments(standins.lineitem(spark, FOLDER), standins.RESPONSES, "day", "l_linestatus"))
    assert len(re.findall(r"\(\d+\) Exchange", text)) == 1
    assert "Python" not in text


def test_filters_reach_the_scan(spark):
    df = standins.lineitem(spark, FOLDER).where((F.col("l_quantity") > 45) & (F.col("l_linestatus") == "F"))
    text = plan(cell_stats(df, ["l_tax"], "l_linestatus", "l_linenumber"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "GreaterThan(l_quantity,45.0)" in pushed and "EqualTo(l_linestatus,F)" in pushed


@pytest.mark.parametrize("columns", [1, 4])
def test_duplicate_mask_does_not_sort_by_value(spark, columns):
    events = table(spark, FOLDER, "events").select("event_id", *(F.col("value").alias(f"v{i}") for i in range(columns)))
    text = plan(cleaning.duplicate_mask(events, [f"v{i}" for i in range(columns)], "event_id"))
    assert "Window" not in text and "Cartesian" not in text
    assert len(re.findall(r"\(\d+\) Exchange", text)) <= 4  # the same for any number of columns


def test_membership_does_not_shuffle_the_observations(spark):
    orders = table(spark, FOLDER, "orders").select("o_orderkey", "o_custkey")
    dead = table(spark, FOLDER, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    text = plan(cleaning.membership_flag(orders, dead, "o_custkey"))
    assert "BroadcastHashJoin" in text and not re.search(r"\(\d+\) Exchange", text)


def test_group_shares_use_no_window(spark):
    events = table(spark, FOLDER, "events")
    text = plan(windows.group_share(events, "value", ["event_type"], "max", "share"))
    assert "Window" not in text


def test_materialized_table_is_reliable(spark):
    df = materialize(spark.range(5))
    assert df.rdd.isCheckpointed() or "Scan ExistingRDD" in plan(df)
    assert spark.sparkContext.getCheckpointDir()


def test_frequency_ranking_scans_once(spark):
    events = table(spark, FOLDER, "events")
    df = windows.rank_by_frequency(events, "user_id", ["event_type"])
    df.collect()
    assert "Window" not in plan(df) and "FileScan" not in plan(df)  # the one scan made the counts


def test_many_responses_are_read_in_one_scan(spark):
    rows = table(spark, FOLDER, "lineitem").join(table(spark, FOLDER, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    responses = {f"y{i}": F.col("l_quantity") * (i + 1) for i in range(20)}
    few = cell_stats(rows, dict(list(responses.items())[:3]), "l_returnflag", "l_linenumber")
    many = cell_stats(rows, responses, "l_returnflag", "l_linenumber")
    lines = line_moments(rows, responses, "l_linenumber", "l_returnflag")
    for df in (many, lines):
        assert plan(df).count("FileScan") == plan(few).count("FileScan")
    got = {(r.family, r.treatment, r.x): r.mean for r in many.collect()}
    assert all(got[r.family, r.treatment, r.x] == pytest.approx(r.mean) for r in few.collect())
    assert len({f for f, _, _ in got}) == 20


def test_checkpoint_dir_is_read_from_the_session(spark, monkeypatch, tmp_path):
    from trialframe import session

    class Context:
        master = "spark://cluster"
        chosen = None

        def getCheckpointDir(self):
            return self.chosen

        def setCheckpointDir(self, value):
            self.chosen = value

    class Conf(dict):
        pass

    class Fake:
        def __init__(self, conf):
            self.sparkContext, self.conf = Context(), Conf(conf)

    shared = f"file:{tmp_path}/shared"
    assert session.ensure_checkpoint_dir(Fake({"spark.checkpoint.dir": shared})) == shared
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Fake({}))
