"""Registered queries against their SQL in DuckDB."""

import glob
import os

import pandas as pd
import pytest

from trialframe.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TRIALFRAME_SF_DIR", "/root/testdata/sf0.001")
SOME = [
    "factor_grid",
    "outlier_mask",
    "duplicate_mask",
    "membership_flag",
    "cell_stats",
    "anova_ancova",
    "anova_factorial_three_levels",
    "gram_ols",
    "pairwise_contrasts_many_levels",
    "letters_share_rule",
    "response_report",
    "percent_explained",
    "treatment_contrast_wide",
    "stack_bounds",
    "logistic_fit_null",
    "segment_table",
]
CHOSEN = list(QUERIES) if os.environ.get("TRIALFRAME_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def cell(v):
        if pd.isna(v):
            return "-"
        return repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        expected = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert normal(got) == normal(expected)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
