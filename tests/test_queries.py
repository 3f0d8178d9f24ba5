"""Every registered query against its SQL in DuckDB, value by value, on the small tables."""

import duckdb
import pytest

from tintmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(rows):
    return sorted(tuple("null" if v is None else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.oracles()))
def test_agrees_with_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = cells(tuple(r[c] for c in columns) for r in got.collect())
    names = want.columns
    order = [names.index(c) for c in columns]
    theirs = cells(tuple(r[k] for k in order) for r in want.fetchall())
    assert len(mine) == len(theirs)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, f"{columns}: {len(wrong)} of {len(mine)} rows differ, first {wrong[:2]}"


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracles()])
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns
