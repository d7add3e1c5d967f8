"""Ingest, cleaning and filter queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialframe.catalog.base import register, table
from trialframe.catalog.standins import DAY_SQL, lineitem
from trialframe.functions import scalar as S
from trialframe.operators import cleaning as C
from trialframe.operators import windows as W
from trialframe.session import ensure_checkpoint_dir
from trialframe.sources import (
    expand_levels,
    factor_grid,
    literal_table,
    read_csv,
    spaced_offsets,
)


@register(
    "factor_grid",
    exact=["treatment", "x", "season"],
    sql="""SELECT treatment, CAST(x AS INTEGER) AS x, season
FROM (SELECT DISTINCT l_linestatus AS treatment FROM lineitem)
CROSS JOIN range(1, 181) AS days(x) CROSS JOIN (VALUES ('dry'), ('wet')) AS s(season)""",
)
def factor_grid_query(spark, folder):
    levels = lineitem(spark, folder).select(F.col("l_linestatus").alias("treatment")).distinct()
    return factor_grid(levels, 1, 180, fixed={"season": ["dry", "wet"]})


@register(
    "spaced_offsets",
    exact=["treatment", "x"],
    sig=["offset_y"],
    sql="""WITH days AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS x FROM events),
ranked AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM days)
SELECT treatment, x, a + (b - a) * i / (n - 1) AS offset_y
FROM ranked CROSS JOIN (VALUES ('Cold', 0.0::DOUBLE, -8.0::DOUBLE), ('Room', -2.0, -10.0)) AS s(treatment, a, b)""",
)
def spaced_offsets_query(spark, folder):
    events = table(spark, folder, "events").withColumn("x", F.col("ts").cast("date").cast("string"))
    return spaced_offsets(events, "x", {"Cold": (0, -8), "Room": (-2, -10)}, out="offset_y")


@register(
    "csv_read",
    exact=["event_id", "event_type", "value", "day"],
    sql="""SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events""",
)
def csv_read_query(spark, folder):
    """The events written as CSV with NA for missing values, and read by header name.

    The file goes to the shared folder; the schema lists the columns in another
    order than the file.
    """
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    value = F.when(F.col("event_type") != "view", F.col("value"))
    events = table(spark, folder, "events").select(
        "event_id", value.alias("value"), F.col("ts").cast("date").alias("day"), "event_type"
    )
    events.write.option("header", True).option("nullValue", "NA").csv(path)
    schema = StructType.fromDDL("event_id long, event_type string, day date, value double")
    return read_csv(spark, path, schema).withColumn("day", F.col("day").cast("string"))


@register(
    "literal_join",
    exact=["treatment", "days", "label", "n"],
    sql="""SELECT l_linestatus AS treatment, CAST(days AS INTEGER) AS days, label, count(*) AS n
FROM lineitem CROSS JOIN (VALUES (8), (14)) AS d(days)
JOIN (VALUES ('F', 'filled'), ('O', 'open')) AS names(status, label) ON status = l_linestatus
GROUP BY ALL""",
)
def literal_join_query(spark, folder):
    """Literal tables: durations unfolded per row, labels joined by key."""
    names = literal_table(spark, [("F", "filled"), ("O", "open")], "treatment string, label string")
    counts = (
        lineitem(spark, folder).groupBy(F.col("l_linestatus").alias("treatment"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return expand_levels(counts, days=[8, 14]).join(names, "treatment")


@register(
    "derived_columns",
    exact=["event_id", "x2", "x3", "half_even", "letters", "day_count"],
    sig=["decay"],
    sql="""SELECT event_id, CAST(day(ts) * day(ts) AS DOUBLE) AS x2, CAST(day(ts) AS DOUBLE) ** 3 AS x3,
 CASE WHEN abs(value * 4 - floor(value * 4) - 0.5) < 1e-9 THEN 2 * round(floor(value * 4) / 2 + 0.25) ELSE round(value * 4) END AS half_even,
 replace(event_type || ' a b', ' ', '') AS letters, CAST(abs(day(ts) - 15) AS INTEGER) AS day_count,
 exp(-abs(value) / 50) AS decay
FROM events""",
)
def derived_columns_query(spark, folder):
    """Powers, half-even rounding, letters without spaces, abs, exp, casts."""
    day = F.dayofmonth("ts")
    return table(spark, folder, "events").select(
        "event_id",
        F.pow(day.cast("double"), F.lit(2)).alias("x2"),
        F.pow(day.cast("double"), F.lit(3)).alias("x3"),
        F.bround(F.col("value") * 4, 0).alias("half_even"),
        S.strip_spaces(F.concat("event_type", F.lit(" a b"))).alias("letters"),
        F.abs(day - 15).cast("int").alias("day_count"),
        F.exp(-F.abs("value") / 50).alias("decay"),
    )


@register(
    "days_since",
    exact=["o_orderkey", "days", "from_planting"],
    sql="""SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
 CAST(date_diff('day', DATE '1998-03-17', CAST(o_orderdate AS DATE)) AS INTEGER) AS from_planting FROM orders""",
)
def days_since_query(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        S.days_since("o_orderdate", "1995-01-01").alias("days"),
        S.days_since("o_orderdate", "1998-03-17").alias("from_planting"),
    )


@register(
    "phase_label",
    exact=["o_orderkey", "phase"],
    sql="""SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1998-04-25' THEN 'Growth'
 WHEN CAST(o_orderdate AS DATE) < DATE '1998-04-25' THEN 'Storage' END AS phase FROM orders""",
)
def phase_label_query(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", S.phase_label("o_orderdate", "1998-04-25", "Storage", "Growth").alias("phase")
    )


@register(
    "phase_substitute",
    exact=["event_id", "sample"],
    sql="""SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(user_id AS DOUBLE)
 WHEN event_type <> 'view' THEN value END AS sample FROM events""",
)
def phase_substitute_query(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        S.phase_substitute(
            F.col("event_type") == "view", F.col("user_id").cast("double"), "value"
        ).alias("sample"),
    )


@register(
    "outlier_mask",
    exact=["event_id", "event_type", "value", "score"],
    sql="""SELECT event_id, event_type,
 CASE WHEN (event_type = 'click' AND value < 6) OR value > 150 THEN NULL ELSE value END AS value,
 CASE WHEN event_type = 'error' AND user_id < 10 AND NOT ((event_type = 'click' AND value < 6) OR value > 150) THEN NULL
      ELSE CAST(user_id AS DOUBLE) END AS score FROM events""",
)
def outlier_mask_query(spark, folder):
    events = table(spark, folder, "events").withColumn("score", F.col("user_id").cast("double"))
    kind, value = F.col("event_type"), F.col("value")
    rules = [
        ("value", value.isNotNull() & (kind == "click") & (value < 6)),
        ("value", value.isNotNull() & (value > 150)),
        ("score", value.isNotNull() & (kind == "error") & (F.col("score") < 10)),
    ]
    return C.outlier_mask(events, rules).select("event_id", "event_type", "value", "score")


@register(
    "duplicate_mask",
    exact=["event_id", "value", "score", "kept_by_type"],
    sql="""SELECT event_id,
 CASE WHEN row_number() OVER (PARTITION BY value ORDER BY event_id) = 1 THEN value END AS value,
 CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN CAST(user_id AS DOUBLE) END AS score,
 CASE WHEN row_number() OVER (PARTITION BY event_type, value ORDER BY event_id) = 1 THEN value END AS kept_by_type
FROM events""",
)
def duplicate_mask_query(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id",
        "event_type",
        "value",
        F.col("user_id").cast("double").alias("score"),
        F.col("value").alias("kept_by_type"),
    )
    plain = C.duplicate_mask(events, ["value", "score"], "event_id")
    return C.duplicate_mask(plain, ["kept_by_type"], "event_id", keys=["event_type"])


@register(
    "membership_flag",
    exact=["o_orderkey", "o_custkey", "status"],
    sql="""SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
 THEN 'dead' ELSE 'alive' END AS status FROM orders""",
)
def membership_flag_query(spark, folder):
    dead = table(spark, folder, "customer").where(F.col("c_acctbal") < 0)
    dead = dead.select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return C.membership_flag(orders, dead, "o_custkey")


@register(
    "relative_to_initial",
    exact=["event_id"],
    sig=["relative"],
    sql="SELECT event_id, value / nullif(user_id, 0) AS relative FROM events",
)
def relative_to_initial_query(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", S.relative_to("value", F.col("user_id").cast("double")).alias("relative")
    )


@register(
    "split_regressor",
    exact=["event_id", "x_click", "x_view"],
    sql="""SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(day(ts) AS DOUBLE) ELSE 0.0::DOUBLE END AS x_click,
 CASE WHEN event_type = 'view' THEN CAST(day(ts) AS DOUBLE) ELSE 0.0::DOUBLE END AS x_view FROM events""",
)
def split_regressor_query(spark, folder):
    events = table(spark, folder, "events").withColumn("x", F.dayofmonth("ts").cast("double"))
    return events.select(
        "event_id",
        S.split_regressor("x", "event_type", "click").alias("x_click"),
        S.split_regressor("x", "event_type", "view").alias("x_view"),
    )


@register(
    "null_tolerant_filter",
    exact=["event_id", "value"],
    sql="""WITH masked AS (SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value FROM events)
SELECT event_id, value FROM masked
WHERE (value IS NULL OR value < 100) AND (value IS NULL OR NOT (event_type = 'click' AND (value < 5 OR value > 80)))""",
)
def null_tolerant_filter_query(spark, folder):
    masked = table(spark, folder, "events").withColumn(
        "value", F.when(F.col("event_type") != "view", F.col("value"))
    )
    value = F.col("value")
    late = (F.col("event_type") == "click") & ((value < 5) | (value > 80))
    return masked.where(S.null_tolerant("value", value < 100)).where(
        S.null_tolerant("value", ~late)
    )


@register(
    "time_varying_bounds",
    exact=["event_id", "x", "value"],
    sql="""WITH rows AS (SELECT event_id, CAST(day(ts) AS INTEGER) AS x,
 CASE WHEN event_type <> 'view' THEN value END AS value FROM events)
SELECT event_id, x, value FROM rows
WHERE NOT ((x > 10 AND value < 12) OR (x > 15 AND value < 25) OR (x > 24 AND value < 42))""",
)
def time_varying_bounds_query(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id",
        F.dayofmonth("ts").alias("x"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
    )
    return rows.where(S.time_varying_bounds("x", "value", [(10, 12), (15, 25), (24, 42)]))


@register(
    "range_and_list_filter",
    exact=["event_type", "n", "n_columns"],
    sql="""SELECT event_type, count(*) AS n, CAST(6 AS INTEGER) AS n_columns FROM events
WHERE value >= 1 AND value <= 150 AND value IS NOT NULL AND event_type NOT IN ('error', 'signup') GROUP BY event_type""",
)
def range_and_list_filter_query(spark, folder):
    """Comparison, not-null and not-in-list filters, with row and column counts."""
    events = table(spark, folder, "events")
    kept = events.where(
        (F.col("value") >= 1)
        & (F.col("value") <= 150)
        & F.col("value").isNotNull()
        & ~F.col("event_type").isin("error", "signup")
    )
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.lit(len(kept.columns)).alias("n_columns")
    )


@register(
    "contingency",
    exact=["l_returnflag", "l_linestatus", "day", "n"],
    sql=f"SELECT l_returnflag, l_linestatus, {DAY_SQL} AS day, count(*) AS n FROM lineitem GROUP BY ALL",
)
def contingency_query(spark, folder):
    return W.contingency(lineitem(spark, folder), ["l_returnflag", "l_linestatus", "day"])


@register(
    "rank_by_frequency",
    exact=["user_id", "event_type", "freq", "n"],
    sql="""SELECT user_id, event_type, count(*) AS n, CAST(any_value(freq) AS BIGINT) AS freq
FROM events JOIN (SELECT user_id, count(*) AS freq FROM events GROUP BY user_id) AS f USING (user_id)
GROUP BY user_id, event_type ORDER BY freq, user_id, event_type""",
)
def rank_by_frequency_query(spark, folder):
    return W.rank_by_frequency(table(spark, folder, "events"), "user_id", ["event_type"])


@register(
    "distinct_sorted",
    exact=["event_type", "day"],
    sql="SELECT DISTINCT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events ORDER BY day, event_type",
)
def distinct_sorted_query(spark, folder):
    day = F.col("ts").cast("date").cast("string")
    events = table(spark, folder, "events").select("event_type", day.alias("day"))
    return events.distinct().orderBy(F.asc_nulls_last("day"), "event_type")
