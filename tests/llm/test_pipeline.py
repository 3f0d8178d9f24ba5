import re

from conftest import ROWS
from test_exact_dedup import plain
from test_near_copies import near_pairs
from test_simhash_dedup import groups, naive

import corpus_pipeline
from tintmill.llm import mixing
from tintmill.llm.shared import documents, settle


def stage_tables(spark, sf_dir):
    docs, out = documents(spark, sf_dir), []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in documents(spark, sf).collect()}
    named, exact, near, mixed, packed = stage_tables(spark, sf)
    assert named.columns == exact.columns == near.columns == mixed.columns == documents(spark, sf).columns
    after = {r.doc_id for r in named.collect()}
    assert after <= set(rows) and len(after) >= len(rows) * 0.97
    least = {}
    for i in sorted(after):
        least.setdefault(plain(rows[i].text), i)
    ids = {r.doc_id for r in exact.collect()}
    assert ids == set(least.values())
    fps = {i: naive(rows[i].text) for i in ids}
    root = groups(sorted(set(fps.values())))  # links of fingerprints, and links of near copies over them
    for a, b in near_pairs([(i, rows[i].text) for i in sorted(ids)]):
        old, new = root[fps[a]], root[fps[b]]
        root = {f: new if r == old else r for f, r in root.items()}
    stay = {}
    for i in sorted(ids):
        stay.setdefault(root[fps[i]], i)
    ids = {r.doc_id for r in near.collect()}
    assert ids == set(stay.values())
    tokens = {i: len(re.findall(mixing.WORD, rows[i].text)) + 1 for i in ids}
    taken = {r.doc_id for r in mixed.collect()}
    assert taken <= ids and sum(tokens[i] for i in taken) >= sum(tokens.values()) * corpus_pipeline.MIX_SHARE // 1000
    assert {r.doc_id for r in packed.collect()} == taken
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted(tuple(r) for r in packed.collect())


def test_odd_rows(spark, odd):
    tables = stage_tables(spark, odd)
    counts = [t.count() for t in tables[:4]]
    assert counts[0] <= len(ROWS) and counts == sorted(counts, reverse=True)
    assert len({plain(r.text) for r in tables[1].collect()}) == counts[1]


def test_columns_of_any_name_and_kind_pass_through(spark, odd):
    from pyspark.sql import functions as F

    clash = ["meta.url", "__id", "__key", "__language", "__languageid", "___id", "a`b"]
    docs = documents(spark, odd).select("*", *[F.lit(c).alias(c) for c in clash], F.create_map(F.lit("k"), F.col("source")).alias("labels"), F.parse_json(F.lit('{"a": 1}')).alias("more"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, odd), f"clash-{name}")
        assert docs.columns == names
        rows = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(clash)]).distinct().collect()
        assert [list(r) for r in rows] == [clash]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd).count() > 0


def test_rows_that_differ_in_a_map_are_not_equal(spark):
    from tintmill.llm import exact_dedup

    one = "map('a', 1, 'b', 2)"
    docs = spark.sql(f"SELECT 1L AS doc_id, 'x' AS text, {one} AS m UNION ALL SELECT 1L, 'x', map('b', 2, 'a', 1) UNION ALL SELECT 1L, 'x', map('a', 1) UNION ALL SELECT 1L, 'x', null")
    keys = [r.k for r in docs.select(exact_dedup.row_key(docs).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
