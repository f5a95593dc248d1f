"""Every query with an SQL twin equals DuckDB on the smallest tables; the others run."""

import math

import pandas as pd
import pytest

from notegrid.plans.registry import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


def rows(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "~"
        kind = type(v).__name__
        if kind.startswith("float"):
            return f"{float(v):.9g}"
        if kind.startswith("int"):
            return str(int(v))
        if kind.startswith("bool"):
            return str(bool(v))
        return str(pd.Timestamp(v)) if kind in ("Timestamp", "date", "datetime") else str(v)

    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
