"""Every registered query of the library runs, and equals its SQL where it has one."""

import duckdb
import pytest

from skein.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and hasattr(v, "hour") else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    cols, got = rows_of(registry.queries()[name](spark, sf_dir))
    r = duck.sql(registry.oracle_sql()[name])
    at = [r.columns.index(c) for c in cols]
    assert sorted(r.columns) == cols
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=str)
    assert got or name in {"unlabelled_documents"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["message_id", "channel", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
