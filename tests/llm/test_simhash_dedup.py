import re

import numpy as np
import xxhash
from conftest import ROWS

from tintmill.llm import simhash_dedup
from tintmill.llm.shared import documents


def naive(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes):
    """Least member reached of every node, over all pairs."""
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and bin(a ^ b).count("1") <= 2:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def check(rows, got):
    fps = [(i, naive(t)) for i, t in rows]
    root = groups(sorted({f for _, f in fps}))
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted((str(i), f"{f:016x}", str(least.get(root[f]))) for i, f in fps)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_odd_rows(spark, odd):
    check([(r[0], r[1]) for r in ROWS], simhash_dedup.op8_pigeonring_simhash(spark, odd).collect())


def test_all_pairs_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]
    check(rows, simhash_dedup.op8_pigeonring_simhash(spark, sf).collect())


def near_numbers(count, seed=2):
    draw = np.random.default_rng(seed)
    out = set()
    while len(out) < count:
        x = int(draw.integers(0, 2**63)) * 2 + int(draw.integers(0, 2))
        for _ in range(int(draw.integers(1, 7))):
            out.add(x)
            for b in draw.choice(64, int(draw.integers(1, 4)), replace=False):
                x ^= 1 << int(b)
    return sorted(out)


def test_no_link_is_lost(spark):
    numbers = near_numbers(600)
    signed = [x - 2**64 if x >= 2**63 else x for x in numbers]
    edges = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    want = groups(numbers)
    back = dict(zip(numbers, signed))
    sets = {}
    for x in numbers:
        sets.setdefault(want[x], set()).add(back[x])
    found = {}
    for x in signed:
        found.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, found.values()))


def test_long_runs_of_one_key():
    draw = np.random.default_rng(8)
    ring = np.unique((np.uint64(0xABCDEF1234500000) | draw.integers(0, 2**20, 900).astype(np.uint64)))
    assert len(ring) > simhash_dedup.SHIFTS
    i, j = simhash_dedup._linked(np.zeros(len(ring), np.int64), ring)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    bits = np.bitwise_count(ring[:, None] ^ ring[None, :])
    chain = np.bitwise_count((ring[:, None] ^ ring[None, :]) >> np.uint64(4))
    want = {(a, b) for a, b in zip(*np.nonzero((bits <= 2) & (chain <= 1))) if a < b}
    assert got == {(int(a), int(b)) for a, b in want}
