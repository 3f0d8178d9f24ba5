"""Every registered query over rows that are null, empty, long, tied or repeated, and over no rows."""

import pytest

from tintmill.llm import entries

NAMES = list(entries.queries())


def test_one_query_each():
    assert sorted(n.split("_")[0] for n in NAMES if n != "pipeline") == sorted(f"op{k}" for k in range(1, 14))


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, empty, name):
    assert entries.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("pipeline", "op3_tree_mix", "op6_hilbert_packing", "op12_hard_negatives", "op13_ball_kmeans")])
def test_a_row_for_each_row(spark, odd, name):
    from conftest import ROWS

    out = [r["doc_id"] for r in entries.queries()[name](spark, odd).collect()]
    assert sorted(out, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_sql_agrees_on_odd_rows(spark, odd, name):
    import duckdb

    if name == "op2_recipe_dedup":
        pytest.skip("repeated rows: SQL marks both as kept")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    want = con.sql(entries.oracle_sql()[name]).df()
    got = entries.queries()[name](spark, odd).toPandas()
    columns = sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[columns].convert_dtypes().astype(str).itertuples(index=False)))
    assert sorted(got.columns) == columns and rows(got) == rows(want)
