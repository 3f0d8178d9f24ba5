import hashlib
import re

import numpy as np
from conftest import ROWS

from tintmill.llm import exact_dedup
from tintmill.llm.shared import documents


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_normalised():
    for text in ("", " ", "a", " a  b ", "\t\x0b\x0ca\r\nb", "a\x1cb\x85c d"):
        assert exact_dedup.normalised(text) == plain(text).encode()


def test_against_brute_force(spark, odd):
    groups = {}
    for r in ROWS:
        groups.setdefault(plain(r[1]), []).append(r[0])
    got = exact_dedup.op2_recipe_dedup(spark, odd).collect()
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        want += [(str(i), str(min(known) if known else None), len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(want)
    assert sum(r.kept for r in got) == len(groups)


def test_short_identifiers_are_found_out(spark, odd):
    docs = documents(spark, odd).select("doc_id", "text").withColumn("row_key", __import__("pyspark").sql.functions.lit(1).cast("long"))
    assert not exact_dedup.verified(docs.union(spark.range(3000).selectExpr("id", "cast(id as string)", "1L")), 1)
    out = exact_dedup.exact_dedup(documents(spark, odd), digests=(1, 16)).collect()
    assert sum(r.kept for r in out) == len({plain(r[1]) for r in ROWS})


def test_kept_rows_keep_one_of_equal_rows(spark, odd):
    docs = documents(spark, odd)
    kept = exact_dedup.kept_rows(docs, exact_dedup.exact_dedup(docs))
    assert kept.columns == docs.columns
    texts = [plain(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({plain(r[1]) for r in ROWS})


def test_cuts_depend_on_content_alone():
    body = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    one = exact_dedup.cuts(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]
    both = exact_dedup.cuts(np.frombuffer(b"zz" * 500 + body, np.uint8), np.array([0, 1000, 1000 + len(body)]))[1]
    assert [b - 1000 for b in both] == one and len(one) > 10 and one[-1] == len(body)
    moved = exact_dedup.cuts(np.frombuffer(b"inserted" + body, np.uint8), np.array([0, len(body) + 8]))[0]
    assert len({b - 8 for b in moved} & set(one)) > len(one) * 0.8
    assert exact_dedup.cuts(np.zeros(0, np.uint8), np.array([0, 0])) == [[]]
