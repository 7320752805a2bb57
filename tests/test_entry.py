"""Every registered query of the spatial engine against its SQL."""

import os

import duckdb
import pytest

from tesselar.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def tidy(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows, cols = df.collect(), df.columns
    found = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(cols) == sorted(names)
    mine = sorted((tuple(tidy(r[c]) for c in sorted(cols)) for r in rows), key=repr)
    theirs = sorted((tuple(tidy(r[names.index(c)]) for c in sorted(cols)) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["idx", "dist2"]
