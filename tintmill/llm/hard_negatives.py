"""Hard negatives by inverted lists with centroid radii.

Rows are dealt to the lists of k centroids, fitted by k-means on a bounded sample; every row is in a list,
and each list keeps the distance of its farthest row (its radius). An anchor a scores no row of a list
above a.c + |a| r (Cauchy-Schwarz). It visits lists in falling order of that bound; lists whose bounds
lie outside its windows of scores are skipped, and it stops when the bound falls strictly below its
kth score. So nothing that counts is missed: recall is 1, whatever the sample.

Visits go in waves: each anchor's first WAVE lists, then eight times as many, and so on, with kth
scores settled between. In a wave, each visited block of a list (about BLOCK rows, so that a hot list is
many blocks) meets the anchors that visit it in one stream: its rows are held, anchors pass by in
batches, and each anchor emits at most its k best rows of the block that beat its kth score.

Defined cases: rows with a null label, a null vector, or a component that is null or not finite take
no part, nor do rows without vec_id (nothing can name them); of rows that share a vec_id one stands, the
smallest by label and vector; a shorter vector counts as filled with zeros; components that scale to 2^27
or beyond are an error; ties go to the smaller vec_id; an anchor without positives, and a positive
without negatives, give no rows; no rows, no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.llm.shared import settle
from tintmill.llm.vectors import longest, products, scaled, usable

K, SCALE, LEAST_PERCENT = 5, 256, 80
#: Rows that centroids are fitted on, at most; centroids, at most; rounds of the fit.
SAMPLE, LISTS, ROUNDS = 1 << 14, 1024, 5
#: Rows of a block of a list, about; lists of the first wave, and growth of waves.
BLOCK, WAVE, GROWTH = 4096, 8, 8
LOWEST, HIGHEST = -(1 << 62), 1 << 62
WINDOW = "w array<struct<of: long, least: long, most: long, score: long, id: long>>"


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part, one for each vec_id; rows has
    vec_id, label, embedding."""
    fine = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    whole = fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled(F.col("embedding"), scale).alias("v"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def fitted(rows: DataFrame, lists: int, dims: int) -> np.ndarray:
    """Centroids (lists x dims) of SAMPLE rows at most, those with the smallest hashes of vec_id."""
    drawn = rows.select(F.xxhash64("vec_id").alias("draw"), "vec_id", "v").orderBy("draw", "vec_id").limit(SAMPLE).collect()
    x = np.zeros((len(drawn), dims))
    for k, r in enumerate(drawn):
        x[k, :len(r["v"])] = r["v"]
    if not len(x):
        return np.zeros((1, dims))
    centroids = x[:lists].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([(half - x[at:at + 1024] @ centroids.T).argmin(axis=1) for at in range(0, len(x), 1024)])


def _matrix(column, dims: int) -> np.ndarray:
    """Lists of numbers as rows, filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.int32)
    out = np.zeros((len(sizes), dims), np.int32)
    for k, (at, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        out[k, :n] = flat[at:at + n]
    return out


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<i4")], pa.binary())


class Index:
    """Rows in lists: `rows` (settled: vec_id, label, v, list), centroids, radii, and blocks of each list."""

    def __init__(self, rows: DataFrame):
        self.dims = max(1, longest(rows, "v"))
        n = rows.count()
        self.centroids = fitted(rows, max(1, min(LISTS, round(n**0.5 / 2))), self.dims)
        dims, centroids = self.dims, self.centroids

        def deal(batches):
            for batch in batches:
                x = _matrix(batch.column(2), dims)
                own = _nearest(x.astype(np.float64), centroids) if len(x) else np.zeros(0, np.int64)
                far = np.sqrt(((x - centroids[own]) ** 2).sum(axis=1))
                yield pa.record_batch({"vec_id": batch.column(0), "label": batch.column(1), "v": _raw(x), "list": pa.array(own.astype(np.int32)), "far": pa.array(far)})

        self.rows = settle(rows.mapInArrow(deal, "vec_id long, label long, v binary, list int, far double"), "lists")
        told = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # one row a list
        self.radii, self.blocks = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
        for r in told:
            self.radii[r["list"]], self.blocks[r["list"]] = r["far"], -(-r["n"] // BLOCK)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores that no row of a list exceeds, or falls below (anchors x lists); with room for rounding."""
        middle = anchors.astype(np.float64) @ self.centroids.T
        reach = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.radii[None, :]
        room = 1 + 1e-9 * (np.abs(middle) + reach)
        return middle + reach + room, middle - reach - room


def _visits(index: Index, anchors: DataFrame, begin: int, end: int) -> DataFrame:
    """The lists that anchors (anchor_id, label, v, w) still have to visit among their begin'th to
    end'th best: list, its number of blocks, and the anchor."""
    shared = anchors.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.blocks))  # LISTS centroids at most
    dims = index.dims

    def choose(batches):
        own = Index.__new__(Index)
        own.centroids, own.radii, own.blocks = shared.value
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i4").reshape(-1, dims)
                high, low = own.bounds(x)
                order = np.argsort(-high, axis=1, kind="stable")[:, begin:end]
                lists, who = [], []
                for k, windows in enumerate(part.column(3).to_pylist()):
                    near = order[k]
                    wanted = np.zeros(len(near), bool)
                    for w in windows:
                        wanted |= (high[k, near] >= max(w["least"], w["score"])) & (low[k, near] <= w["most"])
                    near = near[wanted & (own.blocks[near] > 0)].tolist()
                    lists += near
                    who += [k] * len(near)
                taken = part.take(pa.array(who, pa.int64()))
                blocks = pa.array(own.blocks[lists] if lists else [], pa.int64())
                yield pa.record_batch([pa.array(lists, pa.int32()), blocks, *taken.columns], ["list", "blocks", "anchor_id", "label", "v", "w"])

    return anchors.select("anchor_id", "label", "v", "w").mapInArrow(choose, f"list int, blocks long, anchor_id long, label long, v binary, {WINDOW}")


def _best(ids: np.ndarray, scores: np.ndarray, window: dict, k: int) -> np.ndarray:
    """Places of the k best scores inside the window that beat its kth score."""
    fits = (scores <= window["most"]) & (scores >= window["least"])
    fits &= (scores > window["score"]) | ((scores == window["score"]) & (ids < window["id"]))
    at = np.flatnonzero(fits)
    if len(at) > k:
        cut = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= cut]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _met(index: Index, visits: DataFrame, same: bool, k: int) -> DataFrame:
    """What visiting anchors find: anchor_id, of, id, score. Rows of a block come first, then its visitors."""
    spark = visits.sparkSession
    places = spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.blocks)], "list int, blocks long")  # LISTS rows at most
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    asked = places.join(visits.select("list").distinct(), "list", "left_semi")  # lists that nobody visits stay where they are
    rows = index.rows.join(F.broadcast(asked), "list").select("list", block.alias("block"), "vec_id", "label", "v")
    visits = visits.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    none = F.lit(None).cast(WINDOW[2:]).alias("w")
    both = rows.select("list", "block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "v", none)
    both = both.unionByName(visits.select("list", "block", F.lit(1).alias("kind"), F.col("anchor_id").alias("id"), "label", "v", "w"))
    dims = index.dims

    def meet(batches) -> Iterator[pa.RecordBatch]:
        key, ids, labels, x = None, [], [], []
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) << 40 | batch.column(1).to_numpy()
            kinds, own_ids, own_labels = (batch.column(c).to_numpy() for c in (2, 3, 4))
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    key, ids, labels, x = keys[a], [], [], []
                vectors = np.frombuffer(b"".join(batch.column(5).slice(a, b - a).to_pylist()), "<i4").reshape(-1, dims)
                if kinds[a] == 0:
                    ids, labels, x = [*ids, own_ids[a:b]], [*labels, own_labels[a:b]], [*x, vectors]
                    continue
                if not ids:
                    continue
                ids, labels, x = [np.concatenate(ids)], [np.concatenate(labels)], [np.concatenate(x)]
                out = []
                for at in range(a, b, 256):
                    to = min(b, at + 256)
                    scores = products(vectors[at - a:to - a], x[0])
                    for n, windows in enumerate(batch.column(6).slice(at, to - at).to_pylist()):
                        anchor = int(own_ids[at + n])
                        fits = (labels[0] == own_labels[at + n]) == same
                        lowest = min(max(w["least"], w["score"]) for w in windows)
                        near = np.flatnonzero(fits & (scores[n] >= lowest) & (scores[n] <= max(w["most"] for w in windows)) & (ids[0] != anchor))
                        if len(near):
                            for w in windows:
                                best = near[_best(ids[0][near], scores[n][near], w, k)]
                                out += zip([anchor] * len(best), [w["of"]] * len(best), ids[0][best].tolist(), scores[n][best].tolist())
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor_id", "of", "id", "score"])

    dealt = both.repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    return dealt.mapInArrow(meet, "anchor_id long, of long, id long, score long")


def search(index: Index, anchors: DataFrame, same: bool, k: int = K) -> DataFrame:
    """The k best rows of each window of anchors (anchor_id, label, v, windows: array<struct<of, least,
    most>>), of the anchor's label (same) or of others: anchor_id, of, id, score, rank."""
    best = None
    begin, end = 0, WAVE
    rank = F.row_number().over(Window.partitionBy("anchor_id", "of").orderBy(F.col("score").desc(), "id"))
    while best is None or begin < len(index.centroids):
        asked = anchors
        kth = [F.lit(LOWEST).alias("score"), F.lit(HIGHEST).alias("id")]
        if best is not None:
            last = F.struct(F.col("of"), F.col("score"), F.col("id"))
            found = best.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.collect_list(last).alias("kths"))  # one for each window
            asked = anchors.join(found, "anchor_id", "left")
            mine = lambda w, name, other: F.coalesce(F.get(F.transform(F.filter(F.col("kths"), lambda x: x["of"] == w["of"]), lambda x: x[name]), F.lit(0)), F.lit(other))
        windows = F.transform("windows", lambda w: F.struct(w["of"].alias("of"), w["least"].alias("least"), w["most"].alias("most"), *(kth if best is None else [mine(w, "score", LOWEST).alias("score"), mine(w, "id", HIGHEST).alias("id")])))
        visits = settle(_visits(index, asked.select("anchor_id", "label", "v", windows.alias("w")), begin, end), "visits")
        met = _met(index, visits, same, k)
        met = met if best is None else met.unionByName(best.drop("rank"))
        best = settle(met.withColumn("rank", rank).filter(F.col("rank") <= k), "best")
        begin, end = end, end + (end - begin) * GROWTH
    return best


def mine(rows: DataFrame, anchors, k: int = K, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, v) for which `anchors`, a condition, holds: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    rows = settle(rows, "vectors")
    index = Index(rows)
    chosen = index.rows.filter(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    all_scores = F.array(F.struct(F.lit(0).cast("long").alias("of"), F.lit(LOWEST).alias("least"), F.lit(HIGHEST).alias("most")))
    near = search(index, chosen.withColumn("windows", all_scores), True, k)
    # least_percent * positive <= 100 * negative <= 100 * positive: under zero no score fits
    least = F.expr(f"({least_percent} * score + 99) div 100")
    window = F.struct(F.col("id").alias("of"), least.alias("least"), F.col("score").alias("most"))
    windows = near.filter("score >= 0").groupBy("anchor_id").agg(F.collect_list(window).alias("windows"))  # k at most
    far = search(index, chosen.join(windows, "anchor_id"), False, k)
    positives = near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = far.withColumnRenamed("of", "positive_id").join(positives, ["anchor_id", "positive_id"])
    return both.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


#: DuckDB SQL of the same, over rows whose vec_id is theirs alone and whose vectors are equally long.
ORACLE_SQL = f"""WITH e AS MATERIALIZED (SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT a, b, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {K})
SELECT near.a AS anchor_id, near.b AS positive_id, (row_number() OVER own)::INTEGER AS rank, s.b AS negative_id, near.score AS positive_score, s.score AS negative_score
FROM near JOIN scored s ON s.a = near.a AND NOT s.same AND {LEAST_PERCENT} * near.score <= 100 * s.score AND s.score <= near.score
WINDOW own AS (PARTITION BY near.a, near.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER own <= {K}"""
