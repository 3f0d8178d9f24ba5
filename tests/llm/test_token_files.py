import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import ROWS, table
from tokenizers import Tokenizer

from tintmill.llm import range_coder, token_files

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_give_the_ids_of_whole_texts():
    odd = ["", " ", "a\x0bb\x0cc\td\r\ne", "#", "don't  'sell", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ΟΔΟΣ Σ", "é ́e", "a b c　d\u0085e", "x\x00y\x1fz", "İ ẞ ǅ", "\U0001f600 ‍ 日本語", "한국 한", "1234 5\t٣", "w" * 5000]
    odd += [chr(a) + " " + chr(b) + chr(a) for a in (0x300, 0x301, 0x327, 0x345, 0x3a3, 0x130, 0x2028, 0xfeff) for b in (0x300, 0x327, 0x41, 0x20, 0x1e9b)]
    odd += ["<|ENDOFTEXT|>", "a<|endoftext|>B.c", "Don't,'s x.'s 'S", "a1b2 (word) é.,x …. .…a A.B;c", "1\u0301 a\u0301. .\u0301a I\u0307 \u212a", "\u00bd.\u00bd x\u00b2,y", "a_b-c--d '' 've, we'VE", "foo\x00bar\x7f."]
    words = token_files.Words("word_bpe_49k")
    assert [words.ids(x).tolist() for x in odd] == [ids_of(x)[:-1] for x in odd]


def test_random_texts_give_the_ids_of_whole_texts():
    import random

    draw, some = random.Random(3), "aBcdé'’.,;-<|>1 2\t\n½…ß́̇ΣσñИ日＊_#\x0b\x1c\u2028"
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(40))) for _ in range(4000)]
    words = token_files.Words("word_bpe_49k")
    assert [words.ids(x).tolist() for x in texts] == [ids_of(x)[:-1] for x in texts]


def test_two_generations_are_remembered(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    words = token_files.Words("word_bpe_49k")
    texts = [f"word{k} other{k % 5} the, {'long' * 40}" for k in range(40)]
    for x in texts:
        assert words.ids(x).tolist() == ids_of(x)[:-1] and len(words) < 9 and all(len(w) <= 64 for w in words)


def test_every_document_comes_back(spark, odd):
    got = token_files.op11_mixed_range_coder(spark, odd).collect()
    sizes = {}
    for r in ROWS:
        own = np.array(ids_of(r[1]), "<u4")
        sizes.setdefault(r[0], []).append((len(own), zlib.crc32(own.tobytes())))
    for k, own in sizes.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == k) == sorted(own)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_documents_span_blocks_and_files(spark, tmp_path, monkeypatch):
    """In this process, with small blocks: a document may fill many, and a file ends where one ends."""
    for name, value in (("LANES", 4), ("STEPS", 8), ("BLOCK", 32)):
        monkeypatch.setattr(range_coder, name, value)
    draw = np.random.default_rng(5)
    lengths = [1, 31, 32, 33, 200, 1, 1, 64, 5]
    docs = [draw.integers(0, 90, n).astype("<u2") for n in lengths]
    writer = token_files._Writer(f"file:{tmp_path}/x", 3, 0, 90)
    for k, ids in enumerate(docs):
        writer.add(ids, None if k == 2 else k)
    row = writer.close().to_pylist()[0]
    assert row["n_ids"] == sum(lengths) and row["n_documents"] == len(docs)
    with open(f"{tmp_path}/x/part-000003-000000.ids", "rb") as own:
        found = list(token_files.sections(own.read))
    assert max(len(ids) for ids, *_ in found) == 32 and len(found) > 9
    flat = np.concatenate([ids for ids, *_ in found])
    assert (flat == np.concatenate(docs)).all()
    assert [d for *_, own in found for d in own] == [0, 1, None, *range(3, 9)]
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["part-000003-000000.ids"]  # nothing half done beside it


def test_starts_run_over_all_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RUN", 2)
    files = spark.createDataFrame([(p, n, 10 * p + n + 1) for p in range(7) for n in range(3)], "part long, number long, n_ids long")
    rows = sorted(token_files.placed(files).collect())
    at = 0
    for r in rows:
        assert r.before == at
        at += r.n_ids


def test_a_damaged_file_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"some words of document {k}") for k in range(50)], "doc_id long, text string")
    manifest = token_files.write_files(docs, f"file:{tmp_path}/y")
    path = manifest.first()["path"]
    name = "/" + path[5:].lstrip("/")
    raw = bytearray(open(name, "rb").read())
    raw[-5] ^= 1
    open(name, "wb").write(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        token_files.read_files(manifest).collect()


def test_no_other_column_is_needed(spark, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(table([(5, "one two", None, None)]), tmp_path / "t.parquet")
    docs = spark.read.parquet(str(tmp_path / "t.parquet"))
    got = token_files.read_files(token_files.placed(token_files.write_files(docs, f"file:{tmp_path}/z"))).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(5, 0, 3)]
