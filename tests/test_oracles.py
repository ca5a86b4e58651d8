"""Each registered query of the panel against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from stratapanel.plans import check_queries, factor_queries, monitor_queries, panel_queries, report_queries

QUERIES = factor_queries.QUERIES | panel_queries.QUERIES | monitor_queries.QUERIES | report_queries.QUERIES | check_queries.QUERIES
ORACLES = factor_queries.ORACLES | panel_queries.ORACLES | monitor_queries.ORACLES | report_queries.ORACLES | check_queries.ORACLES


@pytest.fixture(scope="module")
def duck(tables):
    connection = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _rows(frame) -> list[tuple]:
    def plain(v) -> str:
        if pd.isna(v):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if type(v).__name__ in ("Timestamp", "date", "datetime"):
            return str(v)[:10]
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v) + 0.0!r}"
        return str(v)

    return sorted(tuple(map(plain, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, duck, name):
    got, want = QUERIES[name](spark, tables).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("allocate_")))
def test_weights_sum_to_one(spark, tables, name):
    rows = QUERIES[name](spark, tables).toPandas()
    assert len(rows) and (rows["weight"] >= 0).all()
    assert all(math.isclose(x, 1.0, abs_tol=1e-4) for x in rows.groupby("date")["weight"].sum())


def test_all_factors_in_one_plan(spark, tables):
    df = factor_queries.all_factors(spark, tables)
    assert len(df.columns) == 122 and df.count() == QUERIES["bars_ohlcv"](spark, tables).count()


def test_entry_is_importable_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); assert e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
