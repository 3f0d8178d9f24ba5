"""Exact dedup by content-defined chunk recipes.

Texts are compared after each run of white space (space, U+0009..U+000D) became one space. A rolling
hash cuts the normalised bytes into chunks; equal content is cut equally wherever it stands. Pass 1
moves each distinct chunk once and proves that no identifier stands for two contents (if one does,
longer identifiers are taken). Pass 2 makes each document an ordered list of identifiers, its recipe;
from there on only recipes move, about a hundredth of the text. Equal recipes are equal texts.

Defined cases: null text counts as empty, and all empty texts are one group; of repeated rows
(same doc_id, same text) one row stays; a null doc_id stays only if no other row of its group has
one; a very long text is cut whole, in one piece of memory of some ten times its bytes, and moves on as its recipe;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.llm.shared import documents, quoted, settle, slices, texts_of, unused

#: A byte's share in a cut hash: fixed by this seed.
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
WINDOW = 32
LEAST, MOST, MEAN_BITS = 64, 1 << 15, 11
#: Bytes of an identifier; the next one is taken if two contents share one.
DIGESTS = (16, 32, 64)


def normalised(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at space and 09..0D only
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] <= 32 and raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def cuts(data: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text; data holds all texts, starts their bounds (n + 1)."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # h[i] becomes the sum of gear[data[i - j]] << j over j < WINDOW
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    found = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out = []
    lows, highs = np.searchsorted(found, starts[:-1], "right"), np.searchsorted(found, starts[1:], "left")
    for a, b, low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), lows.tolist(), highs.tolist()):
        ends, last = [], a
        for at in [*found[low:high].tolist(), b]:
            if at - last < LEAST and at != b:
                continue
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at > last:
                ends.append(at)
                last = at
        out.append(ends)
    return out


def _chunked(batches, size: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [normalised(x) for x in texts_of(batch)]
        starts = np.cumsum([0, *map(len, texts)])
        joined = b"".join(texts)
        ends = cuts(np.frombuffer(joined, dtype=np.uint8), starts)
        recipes, pieces = [], []
        for a, own in zip(starts[:-1].tolist(), ends):
            ids = []
            for b in own:
                piece = joined[a:b]
                ids.append(hashlib.blake2b(piece, digest_size=size).digest())
                if with_bytes:
                    pieces.append(piece)
                a = b
            recipes.append(ids)
        if with_bytes:
            yield pa.record_batch({"chunk": pa.array([i for r in recipes for i in r], pa.binary()), "bytes": pa.array(pieces, pa.binary())})
        else:
            shas = [hashlib.sha256(x).hexdigest() for x in texts]
            yield pa.record_batch({"doc_id": batch.column(0), "row_key": batch.column(2), "text_sha256": pa.array(shas, pa.string()), "recipe": pa.array(recipes, pa.list_(pa.binary()))})


def verified(docs: DataFrame, size: int) -> bool:
    """Whether every identifier of that size stands for one content in docs (doc_id, text)."""
    chunks = docs.mapInArrow(lambda it: _chunked(it, size, True), "chunk binary, bytes binary").distinct()
    return chunks.groupBy("chunk").count().filter("count > 1").isEmpty()


def recipes(docs: DataFrame, digests: tuple[int, ...] = DIGESTS) -> DataFrame:
    """doc_id, row_key, text_sha256, recipe (identifiers in order) of docs (doc_id, text, row_key)."""
    for size in digests:
        if verified(docs, size):
            return docs.mapInArrow(lambda it: _chunked(it, size, False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, text_sha256 string, recipe array<binary>")
    raise ValueError(f"two chunks share an identifier of {digests[-1]} bytes")


def row_key(docs: DataFrame):
    """Rows that share doc_id and this key are equal, so either may stand for the other. What Spark does not
    hash (maps, variants, and what holds them) is hashed as JSON, maps with their entries in order."""

    def hashable(name: str, kind: str):
        own = F.col(quoted(name))
        if kind.startswith("map<") and "variant" not in kind and "map<" not in kind[4:]:
            return F.to_json(F.array_sort(F.map_entries(own)))
        return F.to_json(F.struct(own.alias("c"))) if "map<" in kind or "variant" in kind else own

    return F.xxhash64(*[hashable(c, kind) for c, kind in docs.dtypes])


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: tuple[int, ...] = DIGESTS) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, row_key."""
    own = recipes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(docs).alias("row_key")), digests)
    table = settle(own.withColumn("row", F.monotonically_increasing_id()), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")))
    groups = table.groupBy("recipe").agg(first.alias("keep"), F.count(F.lit(1)).alias("group_size"))
    # A table of its own: beside an aggregate, Spark could not split the join's partition of a hot group.
    groups = settle(groups.select(F.col("recipe").alias("of"), "keep", "group_size"), "recipe-groups")
    both = table.join(groups, F.col("recipe") == F.col("of"))
    return both.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "row_key")


def kept_rows(docs: DataFrame, decisions: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that decisions (doc_id, row_key, kept) keep, with all their columns."""
    start = unused(docs)
    id_, of, stays, all_, key, piece, n, size, before = (start + x for x in ("id", "of", "stay", "rows", "key", "piece", "n", "size", "before"))
    stay = decisions.groupBy(F.col("doc_id").alias(id_), F.col("row_key").alias(of)).agg(F.count_if("kept").alias(stays), F.count(F.lit(1)).alias(all_)).filter(f"{stays} > 0")
    names = [F.col(quoted(c)) for c in docs.columns]
    keyed = docs.withColumn(key, row_key(docs))
    same = F.col(quoted(doc_id)).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(of))
    out = keyed.join(stay.filter(f"{stays} = {all_}"), same, "left_semi").select(*names)
    part = stay.filter(f"{all_} > {stays}")
    if part.isEmpty():
        return out
    # Equal rows, of which some stay: a number beside each, in pieces so that no task gets them all.
    some = keyed.join(part, same).withColumn(piece, F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    in_piece = F.row_number().over(Window.partitionBy(id_, of, piece).orderBy(stays))
    some = settle(some.withColumn(n, in_piece), "equal-rows")
    sizes = some.groupBy(id_, of, piece).agg(F.count(F.lit(1)).alias(size))
    ahead = F.sum(size).over(Window.partitionBy(id_, of).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn(before, F.coalesce(ahead, F.lit(0))).select(F.col(id_).alias(id_ + "2"), F.col(of).alias(of + "2"), F.col(piece).alias(piece + "2"), before)
    both = some.join(sizes, F.col(id_).eqNullSafe(F.col(id_ + "2")) & (F.col(of) == F.col(of + "2")) & (F.col(piece) == F.col(piece + "2")))
    return out.unionByName(both.filter(f"{before} + {n} <= {stays}").select(*names))


def op2_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("row_key")


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM d"""
