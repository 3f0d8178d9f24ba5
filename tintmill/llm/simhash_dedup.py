"""SimHash near-dedup with pigeonring filtering.

Fingerprints (64 bits of word shingles) link at a Hamming distance of at most 2. The 64 bits form a
ring of 16 segments of 4 bits. If two fingerprints differ in at most 2 bits, then some segment starts
a chain whose first l segments together differ in at most l * 2 / 16 bits, for every l: 0 in the
first seven, at most 1 in the first fifteen, at most 2 in all. So candidates must share a chain of
seven segments (28 bits), and, because segments eight to fifteen hold one differing bit at most, one
half of the next 32 bits (16 bits more). The 44 bits are the join key; a key holds at most 2**20
different fingerprints whatever the input. The chain's budget prunes before the full Hamming check.

Equal fingerprints are one node. Each partition sends on a spanning forest of the links it found,
never all pairs, and connected components come from alternating large-star and small-star rounds.

Defined cases: null text counts as empty, and texts without a word have fingerprint zero; fewer words
than a shingle: the whole sequence is the one shingle; null doc_ids never name a component unless
all of it is null; repeated rows are linked like equal texts; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tintmill.llm.near_copies import near_copies, unit_of
from tintmill.llm.shared import documents, settle

WORDS, SEED, DISTANCE = 3, 42, 2
SEGMENT, CHAIN = 4, 7
KEY_BITS = SEGMENT * CHAIN + 16
#: Runs of one key up to this length are compared shift by shift; longer ones by looking up the
#: at most 211 neighbours that differ within the 20 bits beyond the key.
SHIFTS = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and space or 09..0D
    if not own:
        return 0
    if len(own) < words:
        hashes = [xxh64_intdigest(b" ".join(own), SEED)]
    else:
        hashes = list(map(xxh64_intdigest, map(b" ".join, zip(*(own[k:] for k in range(words)))), repeat(SEED)))
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = np.array(hashes[at:at + 4096], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([fingerprint(x) for x in batch.tolist()], dtype="int64")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b: each linked node and the least node that it reaches, the node itself left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if np.array_equal(label, before):
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _near(x: np.ndarray) -> np.ndarray:
    """Whether differences (chain first) are within the chain's budgets: the first seven segments are
    equal by the key, the first fifteen differ in one bit at most, all in two."""
    inside = _bits(x >> np.uint64(SEGMENT)) <= 1
    inside[inside] = _bits(x[inside]) <= 2
    return inside


def _linked(key: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked rows; rows are sorted by key, ring has the key's bits in front."""
    first, second = [], []
    change = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
    sizes = ends - starts
    at = np.arange(len(key))
    room = np.repeat(ends, sizes) - at
    room[np.repeat(sizes > SHIFTS, sizes)] = 0
    for shift in range(1, SHIFTS):
        at = at[room[at] > shift]
        if not len(at):
            break
        ok = at[_near(ring[at] ^ ring[at + shift])]
        first.append(ok)
        second.append(ok + shift)
    flips = [0, *(1 << i for i in range(20)), *((1 << i) | (1 << j) for i in range(20) for j in range(i))]
    for s, e in zip(starts[sizes > SHIFTS].tolist(), ends[sizes > SHIFTS].tolist()):
        order = np.argsort(ring[s:e])
        own = ring[s:e][order]
        for flip in flips[1:]:
            want = own ^ np.uint64(flip)
            hit = np.minimum(np.searchsorted(own, want), len(own) - 1)
            found = np.flatnonzero((own[hit] == want) & (want > own))
            found = found[_near(own[found] ^ own[hit[found]])]
            first.append(s + order[found])
            second.append(s + order[hit[found]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _forest(batches) -> Iterator[pa.RecordBatch]:
    """(key, ring, fp) sorted by key to links (a, b) of a spanning forest; a key may span batches."""
    left = None

    def links(key, ring, fp):
        i, j = _linked(key, ring.view(np.uint64))
        full = _bits((fp[i] ^ fp[j]).view(np.uint64)) <= DISTANCE
        i, j = i[full], j[full]
        a, b = roots(fp[i], fp[j]) if len(i) else (np.zeros(0, np.int64),) * 2
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if left is not None:
            own = [np.concatenate([x, y]) for x, y in zip(left, own)]
        cut = int(np.searchsorted(own[0], own[0][-1])) if len(own[0]) else 0
        if cut:
            yield links(*(x[:cut] for x in own))
        left = [x[cut:] for x in own]
    if left is not None and len(left[0]):
        yield links(*left)


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links of different fingerprints (nodes: fp), enough of them to span every component."""
    starts = 64 // SEGMENT
    turned = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    ring = F.when(F.col("start") == 0, F.col("fp")).otherwise(F.expr(f"shiftleft(fp, start * {SEGMENT})").bitwiseOR(F.expr(f"shiftrightunsigned(fp, 64 - start * {SEGMENT})")))
    turned = turned.withColumn("ring", ring)
    half = lambda shift: F.shiftrightunsigned("ring", shift).bitwiseAND(0xFFFF)
    swapped = F.expr(f"ring & ~{0xFFFFFFFF << 4}L").bitwiseOR(F.shiftleft(half(4), 20)).bitwiseOR(F.shiftleft(half(20), 4))
    both = turned.select("fp", "start", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ring").alias("ring")), F.struct(F.lit(1).alias("side"), swapped.alias("ring")))).alias("v"))
    key = F.xxhash64(F.col("start"), F.col("v.side"), F.shiftrightunsigned("v.ring", 64 - KEY_BITS))
    keyed = both.select(key.alias("key"), F.col("v.ring").alias("ring"), "fp")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_forest, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reached) for every node of edges (a, b)."""
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")

    def least(table: DataFrame, column: str, other: str) -> DataFrame:
        mins = settle(table.groupBy(F.col(column).alias("n")).agg(F.min(other).alias("m")), "minima")
        return table.join(mins, table[column] == mins["n"])

    state = None
    while True:
        # Large star: every neighbour above a node goes to the least of the node and its neighbours.
        two_way = edges.union(edges.select("b", "a"))
        star = least(two_way, "a", "b").select("a", "b", F.least("m", "a").alias("m"))
        large = star.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every neighbour below a node, and the node, go to the least of them.
        large = settle(large, "large")
        star = least(large, "a", "b")
        small = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        small = settle(small, "small")
        edges, before = small, state
        state = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if state == before:
            nodes = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(nodes.select("node", F.col("node").alias("root")))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None, words: int = 5) -> DataFrame:
    """A row for each row of docs: doc_id, fp (64 bits as a long), component_id. With a similarity,
    texts whose sets of shingles (of so many words) are that similar link too."""
    fingerprints = F.pandas_udf(_fingerprints, "long")
    more = [unit_of(text).alias("unit")] if similarity else []
    table = settle(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp"), *more), "fingerprints")
    nodes = settle(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes.select("fp"))
    if similarity:
        of = table.groupBy("unit").agg(F.first("fp").alias("fp"))
        pairs = near_copies(docs, words, similarity, doc_id, text)
        for end in "ab":
            pairs = pairs.join(of.select(F.col("unit").alias(end), F.col("fp").alias(f"fp_{end}")), end)
        edges = edges.union(pairs.select("fp_a", "fp_b"))
    linked = components(edges)
    groups = settle(nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "groups")
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(groups.join(named.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).select(F.col("fp").alias("of"), "component_id"), "named")
    return table.join(named, table["fp"] == named["of"]).select("doc_id", "fp", "component_id")


def op8_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
