import zlib

import numpy as np
from conftest import ROWS
from tokenizers import Tokenizer

from tintmill.llm import packing
from tintmill.llm.shared import byte_bpe, documents


def reference_ids(texts):
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizers_library(spark):
    texts = [r.text for r in documents(spark, "/root/testdata/sf0.001").select("text").collect()] + [r[1] or "" for r in ROWS] + ["<|endoftext|> it's", "　\xa0 x", "á‍\U0001f468‍\U0001f469"]
    assert [byte_bpe()(t) for t in texts] == reference_ids(texts)


def test_hilbert_is_a_continuous_path():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pieces(spark, odd):
    pieces = packing.op6_hilbert_packing(spark, odd).collect()
    ids = {}
    for r, own in zip(ROWS, reference_ids([r[1] or "" for r in ROWS])):
        ids.setdefault(r[0], []).append([*own, 0])
    total = sum(len(x) for own in ids.values() for x in own)
    for i, own in ids.items():  # rows of one doc_id are equal here
        mine = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert sum(p[1] for p in mine) == sum(map(len, own))
        for start, length, crc, n in mine:
            part = np.array(own[0][start:start + length], "<u4")
            assert n == len(own[0]) and len(part) == length and zlib.crc32(part.tobytes()) == crc
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for sequence, offset, length in places:
        assert sequence * packing.LENGTH + offset == at and offset + length <= packing.LENGTH
        at += length
    assert at == total


def test_neighbours_on_the_curve_are_alike(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    pieces = packing.pack(docs).filter("start = 0").orderBy("sequence_id", "offset").collect()
    row = [langs[p.doc_id] for p in pieces]
    same = sum(a == b for a, b in zip(row, row[1:])) / (len(row) - 1)
    chance = sum((row.count(x) / len(row)) ** 2 for x in set(row))
    assert same > chance + 0.1
