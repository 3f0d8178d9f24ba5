"""Near copies by word shingles: pairs whose shingle sets have a Jaccard similarity of a threshold or more.

Candidates come from MinHash: BANDS keys of ROWS least values each, so that a pair at similarity s is
missed with odds (1 - s**ROWS)**BANDS: 7e-5 at 0.8, less above. A fingerprint's distance cannot find
them: near copies lie up to a dozen bits apart, where no key of a ring has any bit to hold on to.
Every candidate is then checked by its exact shingle sets.

Keys with the same members are one group. A group goes through its texts by doc_id and compares each
with the texts that are no copy of an earlier one: a text that names its component is always among
these, so no two texts that stay can be near copies, without a comparison of all pairs. Large groups
do so in parts first, and again with what is left of each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tintmill.llm.shared import settle

SEED = 43
BANDS, ROWS = 24, 5
#: Members of a group that one part of it has about.
PART = 64


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than a shingle are one shingle."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) < words:
        return np.array([xxh64_intdigest(b" ".join(own), SEED)], np.uint64)
    return np.unique(np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(own[k:] for k in range(words)))), repeat(SEED)), np.uint64, len(own) - words + 1))


_DRAW = np.random.default_rng(SEED)
_TURN, _ODD = (_DRAW.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_MIX = _DRAW.integers(0, 2**63, (BANDS, ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, none of an empty one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[at:at + 2048, None] ^ _TURN) * _ODD).min(axis=0))
    least ^= least >> np.uint64(29)
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _keyed(batches, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(shingles(x, words)) for x in batch.column(1).to_pylist()]
        yield pa.record_batch({"unit": batch.column(0), "bands": pa.array(keys, pa.list_(pa.int64()))})


def _sets(batches, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.record_batch({"unit": part.column(0), "shingles": pa.array([shingles(x, words).tobytes() for x in part.column(1).to_pylist()], pa.binary())})


def _compared(batches, similarity: float) -> Iterator[pa.RecordBatch]:
    """(group, part, unit, shingles) in order: each unit with the first one kept of its part that it
    is a copy of; units that are kept have themselves."""
    current, kept = None, []
    for batch in batches:
        groups, parts, units = (batch.column(k).to_pylist() for k in range(3))
        to = []
        for k, unit in enumerate(units):
            if (groups[k], parts[k]) != current:
                current, kept = (groups[k], parts[k]), []
            own = np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
            first = next((name for name, theirs in kept if alike(own, theirs, similarity)), None)
            if first is None:
                kept.append((unit, own))
            to.append(unit if first is None else first)
        yield pa.record_batch({"group": batch.column(0), "a": batch.column(2), "b": pa.array(to, pa.int64())})


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b: links of texts (xxhash64 of a text) that are near copies; b has the lesser doc_id."""
    own = docs.select(F.col(doc_id).alias("doc_id"), unit_of(text).alias("unit"), F.col(text).alias("text"))
    table = settle(own.select("unit", "text").mapInArrow(lambda it: _keyed(it, words), "unit long, bands array<long>"), "bands")
    names = own.groupBy("unit").agg(F.min("doc_id").alias("least"))
    keyed = settle(table.select("unit", F.explode("bands").alias("key")).distinct(), "keyed")
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("unit").alias("x"), F.bit_xor(F.xxhash64("unit")).alias("y")).filter("n > 1")
    groups = members.groupBy("n", "x", "y").agg(F.min("key").alias("group"))
    inside = settle(keyed.join(groups.select("group", "n"), F.col("key") == F.col("group")).select("group", "n", "unit"), "members")
    asked = inside.select("unit").distinct()
    texts = own.select("unit", "text").join(asked, "unit", "left_semi").mapInArrow(lambda it: _sets(it, words), "unit long, shingles binary")
    sets = settle(texts.groupBy("unit").agg(F.first("shingles").alias("shingles")).join(names, "unit"), "shingles")

    def rounds(rows: DataFrame, part) -> DataFrame:
        dealt = rows.join(sets, "unit").withColumn("part", part).repartition("group", "part").sortWithinPartitions("group", "part", F.col("least").asc_nulls_last(), "unit")
        found = dealt.select("group", "part", "unit", "shingles").mapInArrow(lambda it: _compared(it, similarity), "group long, a long, b long")
        return settle(found, "compared")

    none = F.lit(0).cast("long")
    first = rounds(inside, F.pmod(F.xxhash64("unit", F.lit(1)), F.ceil(F.col("n") / PART)))
    left = first.filter("a = b").select("group", F.col("a").alias("unit"))
    # Groups of one part are done; of the others, what is left of each part meets.
    again = left.join(inside.filter(F.col("n") > PART).select(F.col("group").alias("__group")).distinct(), F.col("group") == F.col("__group"), "left_semi")
    second = rounds(again, none)
    return first.union(second).filter("a != b").select("a", "b").distinct()


def unit_of(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
