import zlib

import pytest
from conftest import ROWS

from tintmill.llm import sharding


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 50, 1000, 4097])
def test_a_permutation(rows):
    assert sorted(sharding.position(n, rows, 5) for n in range(rows)) == list(range(rows))


def test_against_numbers_in_order(spark, odd):
    rows = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS]
    rows.sort(key=lambda r: (r[0] is not None, r))
    want = sorted((str(r[0]), r[1], r[2], p % 8, p // 8) for n, r in enumerate(rows) for p in [sharding.position(n, len(rows), 20240229)])
    got = sharding.op1_feistel_shards(spark, odd).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot) for r in got) == want
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, len(rows) // 8 + 1)


def test_walks_are_exact():
    for rows in (3, 11, 97, 1003):
        left, right = sharding._sides(rows)
        keys = sharding._round_keys(9)
        most = 0
        for n in range(rows):
            steps, n = 1, sharding._once(n, left, right, keys)
            while n >= rows:
                steps, n = steps + 1, sharding._once(n, left, right, keys)
            most = max(most, steps)
        assert most <= sharding.longest_walk(rows, 9)
