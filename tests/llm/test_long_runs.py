"""Texts that are one run of two million characters: ids of the tokenizers library, and whole results."""

import zlib

import numpy as np
import pytest
from test_packing import reference_ids

import corpus_pipeline
from tintmill.llm import packing, token_counts

RUNS = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "7" * 2_000_000, "!" * 2_000_000, "ab 1\n" * 400_000]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in enumerate(RUNS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_ids_of_long_runs(spark, long_docs):
    want = dict(enumerate(reference_ids(RUNS)))
    counted = token_counts.separator_scan(token_counts.write_tokens(long_docs), carried="ends").collect()
    assert {r.ends: r.n_tokens for r in counted} == {k: len(x) for k, x in want.items()}
    pieces = packing.pack(long_docs).collect()
    for k, ids in want.items():
        own = np.array([*ids, 0], "<u4")
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == k)
        assert sum(p[1] for p in mine) == len(own)
        assert all(zlib.crc32(own[s:s + n].tobytes()) == c for s, n, c in mine)


def test_stages_take_long_runs(spark, long_docs):
    docs = long_docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, "")
        assert docs.count() > 0
    assert corpus_pipeline.keep_language(spark, long_docs, "").count() <= 2
