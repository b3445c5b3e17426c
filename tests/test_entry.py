"""The registered queries against DuckDB on the smallest input, and the contract of the entry module."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SAMPLE = ["history_totals", "provider_ranking", "outcome_labels", "turnaround_survival", "score_cusum", "score_ewma", "forecast_calibration", "page_codes", "derived_case_keys"]


def rows(df):
    cut = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(map(str, (tuple(cut(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, duck, name):
    import __spark_entry__ as entry

    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["field", "row_key", "pos", "of", "value"]
