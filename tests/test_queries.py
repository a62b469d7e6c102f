"""Every registered query of the library's own plans gives the rows of its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(queries()))
def test_rows(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in oracle_sql():
        assert got
        return
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_whole_chunking_conserves_length(spark):
    assert all(r.parent_len == r.child_len for r in queries()["whole_chunking"](spark, SF).collect())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "rank", "score", "first_rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
