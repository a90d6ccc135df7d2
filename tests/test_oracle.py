"""Every query over the reference's domain against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = Counter(plain(tuple(r[c] for c in columns)) for r in df.collect())
    found = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = Counter(plain(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert ours == theirs


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["symbol", "status", "view"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
