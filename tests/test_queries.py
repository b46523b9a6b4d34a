"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from readlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rounded(rows, columns):
    out = [tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in cur.description)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == columns
    assert rounded([r.asDict() for r in df.collect()], columns) == rounded([dict(zip(names, r, strict=True)) for r in cur.fetchall()], columns)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
