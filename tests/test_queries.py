"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from inkwell import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(map(str, (tuple(cell(r[i]) for i in order) for r in data)))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    rel = db.execute(registry.oracles()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, rel.fetchall())


def test_all_queries_are_documented_names():
    assert registry.FLAGSHIP in registry.queries()
    assert set(registry.oracles()) <= set(registry.queries())
