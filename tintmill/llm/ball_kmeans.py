"""K-means of vectors of whole numbers by balls.

A cluster is a ball: its centroid, and the distance of its farthest member. Only centroids less than
two radii away can win a member; the members nearer to their centroid than half the way to the next
one are the stable core and are not compared at all. The others lie in annuli, bounded by half the
ways to the neighbours in order of distance; a member is compared with the neighbours up to its own annulus,
by exact squared distances (equal ones go to the smaller number). What is left out cannot win, so each
round is an exact round of Lloyd's algorithm.

Vectors are stored once, in blocks, bucketed by block: each round reads them where they lie, beside the
clusters of the round before (two bytes a vector, settled each round). A ball's members in one block
are a ball too, with a smaller radius, so each block finds its own neighbours. Sums are taken by block,
then task, then over all; the driver sees k sums and k centroids.

Defined cases: vectors that are null, have another number of components, or one that is null or not
finite are left out; components that scale to 2^27 or beyond are an error; a null vec_id is carried,
and never starts a centroid before others do; repeated rows count each; of fewer than k vectors each starts a
centroid; a centroid without members stays where it is; no vectors, no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.llm.shared import settle, shared_place, slots
from tintmill.llm.vectors import scaled, usable

K, ROUNDS, SCALE, SEED, DIMS = 8, 10, 1024, 3, 64
#: Vectors of a block; bytes of a bucket of blocks.
BLOCK, BUCKET = 1024, 64 << 20


def compared(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector of x, whose clusters were own; squared distances; comparisons made."""
    out, least, made = own.astype(np.int64), np.zeros(len(x), np.int64), len(x)
    for c in np.unique(own).tolist():
        members = np.flatnonzero(own == c)
        mine = x[members].astype(np.int64)
        here = ((mine - centroids[c]) ** 2).sum(axis=1)
        between = ((centroids - centroids[c]) ** 2).sum(axis=1)
        # In squares: half the way to a centroid is at most a distance d if between <= 4 d * d.
        near = [j for j in np.lexsort((np.arange(len(centroids)), between)).tolist() if j != c and between[j] <= 4 * here.max()]
        best, number = here.copy(), np.full(len(members), c)
        for j in near:
            ring = np.flatnonzero(between[j] <= 4 * here)  # this annulus and all beyond it
            d = ((mine[ring] - centroids[j]) ** 2).sum(axis=1)
            wins = (d < best[ring]) | ((d == best[ring]) & (j < number[ring]))
            best[ring[wins]], number[ring[wins]] = d[wins], j
            made += len(ring)
        out[members], least[members] = number, best
    return out, least, made


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    part, block = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            own = batch.slice(at, BLOCK)
            flat = own.column(1).flatten().to_numpy().astype("<i4")
            ids = pa.array([own.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.record_batch({"block": pa.array([part << 32 | block], pa.int64()), "ids": ids, "vectors": pa.array([flat.tobytes()], pa.binary())})
            block += 1


def stored(rows: DataFrame, dims: int) -> DataFrame:
    """rows (vec_id, v) as blocks (block, ids, vectors), bucketed by block in the shared folder."""
    spark = rows.sparkSession
    made = settle(rows.mapInArrow(_blocks, "block long, ids array<long>, vectors binary"), "vector-blocks")
    buckets = min(100_000, max(slots(spark), -(-made.count() * BLOCK * dims * 4 // BUCKET)))
    name = f"vector_blocks_{uuid.uuid4().hex}"
    writer = made.repartition(buckets, "block").write.format("parquet").option("path", shared_place(spark, "bucketed"))
    writer.bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    return spark.table(name)


def starts(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of rows (vec_id, v) with the k smallest sha256 of '<seed>:<vec_id>', in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64)


def _passed(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, dims: int) -> DataFrame:
    """A round's assignments: block, own (two bytes a vector), sums (by cluster: components, then
    vectors, then squared distances), made (comparisons)."""
    k = len(centroids)

    def assign(batches):
        for batch in batches:
            for block, raw, own in zip(*(batch.column(c).to_pylist() for c in range(3))):
                x = np.frombuffer(raw, "<i4").reshape(-1, dims)
                before = np.zeros(len(x), np.int64) if own is None else np.frombuffer(own, "<u2").astype(np.int64)
                now, far, made = compared(x, before, centroids)
                sums = np.zeros((k, dims + 2), np.int64)
                for c in np.unique(now).tolist():
                    of = now == c
                    sums[c] = [*x[of].sum(axis=0, dtype=np.int64), of.sum(), far[of].sum()]
                values = [pa.array([block], pa.int64()), pa.array([now.astype("<u2").tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array([made], pa.int64())]
                yield pa.record_batch(values, ["block", "own", "sums", "made"])

    both = blocks.select("block", "vectors", F.lit(None).cast("binary").alias("own")) if state is None else blocks.select("block", "vectors").join(state.select("block", "own"), "block").select("block", "vectors", "own")
    return settle(both.mapInArrow(assign, "block long, own binary, sums binary, made long"), "ball-round")


def _summed(state: DataFrame, k: int, dims: int) -> list[list[int]]:
    """The sums of all blocks, by cluster: summed by task first, then over the tasks."""

    def add(batches):
        whole = np.zeros(k * (dims + 2), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                whole += np.frombuffer(raw, np.int64)
        yield pa.record_batch({"place": pa.array(np.arange(len(whole))), "n": pa.array(whole)})

    out = [[0] * (dims + 2) for _ in range(k)]
    for r in state.select("sums").mapInArrow(add, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"] // (dims + 2)][r["place"] % (dims + 2)] = int(r["n"])
    return out


def ball_kmeans(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """rows (vec_id, v: dims whole numbers) to vec_id, cluster, distance (squared), cluster_inertia,
    inertia, centroid_sha256, after so many rounds and one more assignment. k at most 65,536."""
    spark = rows.sparkSession
    rows = settle(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "vectors")
    centroids = starts(rows, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks, state = stored(rows, dims), None
    k = len(centroids)
    for step in range(rounds + 1):
        state = _passed(blocks, state, centroids, dims)
        sums = _summed(state, k, dims)
        moved = [[s // own[dims] for s in own[:dims]] if own[dims] else old.tolist() for own, old in zip(sums, centroids)]
        if step == rounds or moved == centroids.tolist():  # nothing would change in the rounds that are left
            break
        centroids = np.array(moved, np.int64)
    spent = [own[dims + 1] for own in sums]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def told(batches):
        for batch in batches:
            for ids, raw, own in zip(*(batch.column(c).to_pylist() for c in range(3))):
                cluster = np.frombuffer(own, "<u2").astype(np.int32)
                far = ((np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
                own_spent = pa.array([spent[c] for c in cluster.tolist()], pa.int64())
                values = [pa.array(ids, pa.int64()), pa.array(cluster), pa.array(far), own_spent, pa.array([sum(spent)] * len(ids), pa.int64()), pa.array([shas[c] for c in cluster.tolist()], pa.string())]
                yield pa.record_batch(values, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.join(state.select("block", "own"), "block").select("ids", "vectors", "own").mapInArrow(told, schema)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.filter((F.size("embedding") == DIMS) & usable(F.col("embedding")))
    return ball_kmeans(rows.select("vec_id", scaled(F.col("embedding"), SCALE).alias("v")))


def oracle() -> str:
    """DuckDB SQL of the same: every round assigns all vectors by all distances."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT n, k, sum((x - y) * (x - y))::BIGINT AS d FROM long JOIN c{r} USING (i) GROUP BY n, k),
a{r} AS MATERIALIZED (SELECT n, arg_min(k, d * {2 * K} + k) AS k, min(d) AS d FROM d{r} GROUP BY n)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT k, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS y FROM a{r} JOIN long USING (n) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce(m{r}.y, c{r}.y) AS y FROM c{r} LEFT JOIN m{r} USING (k, i))""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS n, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
long AS MATERIALIZED (SELECT n, i, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS x FROM kept, range(1, {DIMS} + 1) r(i)),
c0 AS MATERIALIZED (SELECT n AS k, i, x AS y FROM long WHERE n < {K}),
{''',
'''.join(steps)},
shas AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (n) JOIN shas USING (k)"""
