"""Every registered query with SQL against an independent engine; the others must run."""

import duckdb
import pandas as pd
import pytest

from larkspur.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if not isinstance(v, (list, tuple)) and not hasattr(v, "shape") and pd.isna(v):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and v.dtype.kind in "fiu":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(frame):
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, tiny, name):
    got = catalogue.queries()[name](spark, tiny).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(want) == rows(got)


def test_entry_is_importable_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
