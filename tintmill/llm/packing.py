"""Packing along a space-filling curve.

Each document's ids are hashed into a vector (a seeded random direction for each id), which is their
mean and so a random projection of the bag of ids to three dimensions. The three co-ordinates, cut
into cells, give a Hilbert key: documents near each other on the curve use similar ids. Documents are
sorted by (key, hash of doc_id) in ranges and laid one after the other along the curve; sequences are
cut from that line every `length` ids, so only the very last one is padded.

Ids are made once and written to a durable table; after that they move once, to their range. The
number of ranges and of tasks follows from the number of ids; the driver holds two numbers a range,
that is 16 bytes for some 8 MB of text. The result does not depend on where ranges are cut.

Defined cases: null text counts as empty: its document is the separator alone; documents with equal
keys are ordered by doc_id's hash, then doc_id, and repeated rows follow one another in any order
(they are interchangeable); a null doc_id sorts first; a very long text is encoded whole and cut into
as many sequences as it needs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.llm.shared import byte_bpe, documents, settle, slices, slots, texts_of

LENGTH = 1024
SEPARATOR = 0
#: The vocabulary's one added token.
MARK, MARK_ID = "<|endoftext|>", 50256
DIMENSIONS, BITS = 3, 10
SEED = 5
#: The curve is cut at COARSE quantiles of its keys, and each part at as many quantiles again as make
#: ranges of some RANGE_IDS ids. A task takes the ranges of some TASK_IDS ids.
COARSE, RANGE_IDS, TASK_IDS = 256, 1 << 21, 1 << 26


def directions(seed: int = SEED, ids: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((ids, DIMENSIONS)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells (n x dimensions, 0 <= cell < 2**bits): Skilling's
    transformation of axes, done for all rows at once."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(turned, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def curve_keys(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as ids. A mean of n directions has variance 1/n; the root of n
    is damped so that long documents do not all fall into the middle cells."""
    flat = np.concatenate(ids)
    lengths = np.array([len(x) for x in ids])
    starts = np.cumsum(lengths) - lengths
    vectors = np.add.reduceat(table[flat], starts, axis=0) / lengths[:, None]
    vectors *= np.minimum(np.sqrt(lengths), 8.0)[:, None]
    cells = np.clip(((vectors + 8) / 16 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells)


def encode_marked(encode, text: str) -> list[int]:
    """Ids as the tokenizers library gives them: the literal end-of-text mark is one id of its own."""
    if MARK not in text:
        return encode(text)
    ids: list[int] = []
    for k, part in enumerate(text.split(MARK)):
        ids += [MARK_ID] * bool(k) + encode(part)
    return ids


def _tokenised(batches, vocabulary: str, separator: int, seed: int) -> Iterator[pa.RecordBatch]:
    encode, table = byte_bpe(vocabulary), directions(seed)
    for batch in slices(batches):
        ids = [np.array([*encode_marked(encode, x), separator], dtype="<u2") for x in texts_of(batch)]
        keys = curve_keys(ids, table)
        names = [zlib.crc32(str("" if x is None else x).encode()) for x in batch.column(0).to_pylist()]
        key = (keys << 32) | np.array(names, dtype=np.int64)
        yield pa.record_batch({"doc_id": batch.column(0), "key": pa.array(key), "n_ids": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})


def _cuts(table: DataFrame, total: int) -> np.ndarray:
    """Keys at which the curve is cut into ranges, in order: quantiles, and quantiles between them."""
    coarse = table.agg(F.percentile_approx("key", [k / COARSE for k in range(1, COARSE)], 10 * COARSE).alias("b")).first()["b"] or []
    coarse = sorted(set(coarse))
    parts = -(-total // (COARSE * RANGE_IDS))
    fine = [k / parts for k in range(1, parts)]
    if not fine:
        return np.array(coarse, np.int64)
    shared = table.sparkSession.sparkContext.broadcast(np.array(coarse, np.int64))

    @F.pandas_udf("long")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy(), side="right"))

    inside = table.select("key", part_of("key").alias("part")).groupBy("part").agg(F.percentile_approx("key", fine, 10 * parts).alias("b"))
    found = inside.select("b").toArrow().column("b").combine_chunks().flatten().to_numpy()
    return np.unique(np.concatenate([np.array(coarse, np.int64), found]))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = "byte_bpe_50k", separator: int = SEPARATOR, seed: int = SEED,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = settle(rows.mapInArrow(lambda it: _tokenised(it, vocabulary, separator, seed), f"doc_id {kind}, key long, n_ids long, ids binary"), "tokenised")
    total = table.agg(F.coalesce(F.sum("n_ids"), F.lit(0)).alias("n")).first()["n"]
    cuts = _cuts(table, total)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(cuts)  # 8 bytes a range

    @F.pandas_udf("long")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy(), side="right"))

    ranged = table.withColumn("__range", range_of("key"))
    sums = ranged.groupBy("__range").agg(F.sum("n_ids").alias("n")).toArrow().sort_by("__range")  # a row for each range
    n = sums.column("n").to_numpy().astype(np.int64)
    places = np.zeros(len(cuts) + 1, np.int64)
    places[sums.column("__range").to_numpy()] = np.cumsum(n) - n
    offsets = spark.sparkContext.broadcast(places)
    tasks = max(slots(spark), total // TASK_IDS)
    ordered = ranged.repartition(int(tasks), "__range").sortWithinPartitions("__range", "key", "doc_id")

    def pieces(batches):
        current, at = None, 0
        for batch in batches:
            out = []
            for k, (name, inside, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if inside != current:
                    current, at = inside, int(offsets.value[inside])
                wide = np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()
                n, start = len(wide) // 4, 0
                while start < n:
                    take = min(n - start, length - at % length)
                    part = wide[4 * start:4 * (start + take)]
                    out.append((name, start, take, zlib.crc32(part), n, at // length, at % length, part))
                    start, at = start + take, at + take
            columns = list(zip(*out)) or [()] * 8
            kinds = [batch.column(0).type, *[pa.int64()] * 6, pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ordered.select("doc_id", "__range", "ids").mapInArrow(pieces, schema)


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids")
