"""Every query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings source_records entity_relations canonical_entities geometry_versions landuse_faces source_systems subjects subject_labels mix_plans".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, data, con, name):
    got = entry.queries()[name](spark, data)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert cols == sorted(want.columns)
    key = lambda row: tuple(str(x) for x in row)
    a = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
