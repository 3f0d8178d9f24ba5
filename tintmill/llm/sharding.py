"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order (doc_id, size, text_crc32), nulls first, equal rows in any
order (they are interchangeable). The permutation sends row number n to position p; p gives shard
p mod shards and slot p div shards. `position()` is the same law for one number in plain Python, so
shard and slot of any row number can be computed without the data.

Defined cases: null text counts as empty; null doc_id sorts first; repeated rows each get a place of
their own; an empty table gives no rows; other columns of the input are not read and do not clash.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.llm.shared import documents, settle

#: Round functions work modulo this prime, so that products stay below 2**62.
PRIME = 2**31 - 1
ROUNDS = 6


def _round_keys(seed: int) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(ROUNDS)]


def _sides(rows: int) -> tuple[int, int]:
    """left x right >= rows, with fewer than `left` numbers too many."""
    left = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return left, max(1, -(-rows // left))


def _once(n: int, left: int, right: int, keys: list[tuple[int, int]]) -> int:
    high, low = divmod(n, right)
    for k, (factor, shift) in enumerate(keys):
        mixed = ((low if k % 2 == 0 else high) * factor + shift) % PRIME
        mixed = mixed * mixed % PRIME
        if k % 2 == 0:
            high = (high + mixed) % left
        else:
            low = (low + mixed) % right
    return high * right + low


def position(n: int, rows: int, seed: int) -> int:
    """Where the permutation of 0..rows-1 sends n."""
    left, right = _sides(rows)
    keys = _round_keys(seed)
    n = _once(n, left, right, keys)
    while n >= rows:
        n = _once(n, left, right, keys)
    return n


def longest_walk(rows: int, seed: int) -> int:
    """How often the permutation is applied at most until it is back below rows: exact, from the
    numbers beyond rows alone, of which there are fewer than the root of rows."""
    left, right = _sides(rows)
    keys = _round_keys(seed)
    walks = 1
    for n in range(rows, left * right):
        steps = 1
        while n >= rows and steps <= left:
            n = _once(n, left, right, keys)
            steps += 1
        walks = max(walks, steps)
    return walks


def _permuted(df: DataFrame, name: str, rows: int, seed: int) -> DataFrame:
    """One application, only to numbers not yet below rows; plain long arithmetic, no overflow."""
    left, right = _sides(rows)
    df = df.withColumns({"__high": F.expr(f"{name} div {right}"), "__low": F.col(name) % right})
    for k, (factor, shift) in enumerate(_round_keys(seed)):
        given, put, size = ("__low", "__high", left) if k % 2 == 0 else ("__high", "__low", right)
        df = df.withColumn("__mixed", (F.col(given) * factor + shift) % PRIME)
        df = df.withColumn(put, (F.col(put) + F.col("__mixed") * F.col("__mixed") % PRIME) % size)
    return df.withColumn(name, F.col("__high") * right + F.col("__low")).drop("__high", "__low", "__mixed")


def numbered(df: DataFrame, *order: str | Column) -> tuple[DataFrame, int]:
    """df with row_number (0..N-1 in that order), and N. The rows are dealt by range and counted by
    partition; only those counts, one for each partition, reach the driver. A number of the row in
    the input breaks ties, so equal rows spread over partitions too."""
    dealt = df.withColumn("__tie", F.monotonically_increasing_id())
    by = [*order, "__tie"]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    table = settle(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = table.groupBy(part.alias("part")).count().collect()
    starts, rows = [], 0
    for c in sorted(counts, key=lambda c: c["part"]):
        starts.append((c["part"], rows))
        rows += c["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    table = table.withColumn("__part", part.cast("long")).join(F.broadcast(offsets), "__part")  # a row for each partition
    return table.withColumn("row_number", F.col("__start") + F.col("__at").bitwiseAND(2**33 - 1)).drop("__part", "__start", "__at"), rows


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240229, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard, slot: counts of shards differ by one at
    most, slots are gapless from 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    table, n = numbered(rows, "doc_id", "size", "text_crc32")
    walk = f"position >= {n}"
    table = table.withColumn("position", F.col("row_number"))
    if n:
        table = _permuted(table, "position", n, seed)
        for _ in range(longest_walk(n, seed) - 1):
            again = _permuted(table.withColumn("__next", F.col("position")), "__next", n, seed)
            table = again.withColumn("position", F.expr(f"if({walk}, __next, position)")).drop("__next")
    return table.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.expr(f"position div {shards}")})


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
