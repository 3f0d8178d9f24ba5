import numpy as np
import pytest

import corpus_pipeline
from tintmill.llm import near_copies
from tintmill.llm.shared import documents


def five(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def near_pairs(rows):
    """All pairs at 0.8 or more, by plain sets."""
    sets, out = [(i, five(t)) for i, t in rows if (t or "").split()], set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def test_no_near_copy_stays(spark):
    sf = "/root/testdata/sf0.01"
    docs = corpus_pipeline.drop_copies(spark, documents(spark, sf), sf)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs = near_pairs(rows)
    assert len(pairs) >= 5
    stay = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    assert not [p for p in pairs if set(p) <= stay]
    gone = {i for i, _ in rows} - stay
    assert len(gone) <= 2 * len(pairs)


@pytest.mark.parametrize("part", [3, 64])
def test_chains_and_parts_of_a_group(spark, monkeypatch, part):
    monkeypatch.setattr(near_copies, "PART", part)
    draw = np.random.default_rng(1)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # each a copy with one more word of its own changed
        own = list(base)
        for at in draw.choice(200, i % 5, replace=False):
            own[at] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"other{i} {k}" for k in range(50))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert not [p for p in near_pairs(rows) if set(p) <= stay]
    assert {100 + i for i in range(10)} <= stay and 0 in stay
