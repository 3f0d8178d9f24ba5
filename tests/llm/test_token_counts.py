import random

import numpy as np
from conftest import ROWS

from tintmill.llm import token_counts
from tintmill.llm.shared import byte_bpe


def test_counts_of_documents(spark, odd):
    encode = byte_bpe()
    got = token_counts.op4_separator_scan(spark, odd).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), len(encode(r[1] or ""))) for r in ROWS)
    assert all(r.terminated for r in got)


def test_blocks_are_stitched(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN", 3)
    draw = random.Random(4)
    rows, want = [], []
    for file, size in ((0, 200), (1, 0), (2, 57), (3, 40)):
        ids = [draw.choice([9, 9, 9, 9, 1, 2, 3, 0]) if file < 3 else 5 for _ in range(size)]
        ids = [0 if x == 0 else x for x in ids]
        start, ordinal = 0, 0
        for at, x in enumerate(ids):
            if x == 0:
                want.append((file, ordinal, start, at - start, True))
                start, ordinal = at + 1, ordinal + 1
        if start < size:
            want.append((file, ordinal, start, size - start, False))
        rows += [(file, b, np.array(ids[k:k + 4], "<u2").tobytes()) for b, k in enumerate(range(0, size, 4))]
    blocks = spark.createDataFrame([(f, b, bytearray(x)) for f, b, x in rows], "file long, block long, ids binary")
    got = token_counts.separator_scan(blocks, end=0).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_raw_files(spark, tmp_path):
    lengths = [3, 0, 70_000, 5]
    ids = np.concatenate([[7] * n + [50256] for n in lengths] + [[7, 7]]).astype("<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts.separator_scan(token_counts.token_blocks(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [r.n_tokens for r in got] == [*lengths, 2] and [r.terminated for r in got] == [True] * 4 + [False]


def test_a_raw_file_is_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 8)
    monkeypatch.setattr(token_counts, "RUN", 2)
    draw = np.random.default_rng(2)
    want = []
    for name, size in (("x y.bin", 211), ("b.bin", 16), ("c.bin", 1)):
        ids = draw.integers(0, 4, size).astype("<u2")
        (tmp_path / name).write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 0).tolist()
        want += [b - a - 1 for a, b in zip([-1, *ends], ends)] + ([size - 1 - ([-1, *ends])[-1]] if ids[-1] else [])
    blocks = token_counts.token_blocks(spark, str(tmp_path))
    assert blocks.count() == 27 + 2 + 1
    got = token_counts.separator_scan(blocks, end=0).collect()
    assert sorted(r.n_tokens for r in got) == sorted(want)


def test_a_file_that_ends_inside_an_id_is_refused(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    try:
        token_counts.token_blocks(spark, str(tmp_path)).collect()
    except Exception as e:
        assert "no whole number of ids" in str(e)
    else:
        raise AssertionError("read")
