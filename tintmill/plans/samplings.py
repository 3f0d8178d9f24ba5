"""Queries over samples of frames, neighbourhoods of anchors, and polygon masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.functions import colour
from tintmill.operators import sampling
from tintmill.plans import sql
from tintmill.plans.frames import SCENE_LUM, rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures

PIXELS, LEAST = 200, 8
COLUMNS, ROWS = 12, 9
W = fixtures.WIDTH


def _grid_sql(columns: str, rows: str) -> str:
    """Means by area: each pixel meets the cells of its row and column that it overlaps."""
    over = lambda at, size, to, k: f"least(({at} + 1) * {to} / CAST({size} AS DOUBLE), {k} + 1) - greatest({at} * {to} / CAST({size} AS DOUBLE), {k})"
    return f"""sized AS (SELECT *, {columns} AS cw, {rows} AS ch FROM px),
cells AS (SELECT s.*, cx.k AS cx, cy.k AS cy, ({over('x', W, 'cw', 'cx.k')}) * ({over('y', 'h', 'ch', 'cy.k')}) AS wt FROM sized s, range(64) cx(k), range(64) cy(k)
  WHERE cx.k < cw AND cy.k < ch AND {over('x', W, 'cw', 'cx.k')} > 1e-9 AND {over('y', 'h', 'ch', 'cy.k')} > 1e-9),
cell AS (SELECT frame_id, cx, cy, cw, ch, {', '.join(f'CAST(round_even(round(sum({c} * wt) / sum(wt), 6), 0) AS BIGINT) AS {c}' for c in 'rgb')}, sum(wt) * {W} * h / (cw * ch) AS area FROM cells GROUP BY frame_id, cx, cy, cw, ch, h)"""


_SIDE = lambda n: f"CAST(greatest({LEAST}, least({n}, round_even({n} * sqrt({PIXELS} / ({W}e0 * h)), 0))) AS INT)"
_CELL = f"SELECT frame_id, (cy * cw + cx)::BIGINT AS idx, cw::BIGINT AS w, ch::BIGINT AS h, r, g, b, {s6(area='area')} FROM cell"


def _told(cells: DataFrame) -> DataFrame:
    return rounded(cells.select("frame_id", "idx", "w", "h", "r", "g", "b", "area"), "frame_id")


@query(f"WITH {fixtures.SCENES_SQL}, {_grid_sql(_SIDE(str(W)), _SIDE('h'))} {_CELL}")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: frames scaled by area to about so many pixels, in their own shape."""
    return _told(sampling.sample(fixtures.scenes(spark, sf_dir), F.lit(W), F.col("h"), PIXELS, LEAST))


@query(f"WITH {fixtures.SCENES_SQL}, {_grid_sql(str(COLUMNS), str(ROWS))} {_CELL}")
def grid_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as a fixed grid of area means."""
    return _told(sampling.grid(fixtures.scenes(spark, sf_dir), F.lit(W), F.col("h"), COLUMNS, ROWS))


_CLIPS = f"WITH {fixtures.STEPS_SQL}, clips AS (SELECT clip_id, CASE WHEN clip_id % 7 = 0 THEN 'photo' ELSE 'video' END AS media, count(*) * 7e-1 AS duration FROM steps GROUP BY clip_id)"
_PLAN = f"""{_CLIPS}, f AS (SELECT *, media = 'photo' OR duration <= 0 AS still, greatest(8, least(90, CAST(floor(duration / 30) AS INT) + 8)) AS n FROM clips),
p AS (SELECT *, greatest(1e-4, least(30e0, n / duration)) AS rate FROM f)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = F.when(F.col("clip_id") % 7 == 0, "photo").otherwise("video")
    return fixtures.steps(spark, sf_dir).groupBy("clip_id").agg((F.count(F.lit(1)) * 0.7).alias("duration")).select("clip_id", media.alias("media"), "duration")


@query(f"""{_PLAN} SELECT clip_id, CASE WHEN still THEN 1 ELSE n END::BIGINT AS frames, CASE WHEN NOT still THEN round(rate, 6) END AS fps, CASE WHEN still THEN 0e0 ELSE round(least(duration, n / rate), 3) END AS covered,
  CASE WHEN still THEN 1e0 ELSE round(least(duration, n / rate) / duration, 4) END AS coverage FROM p""")
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames of a clip are looked at, and that they cover it."""
    out = sampling.sampling_plan(clips(spark, sf_dir)).select("clip_id", "frames", "fps", "covered", "coverage")
    return rounded(out, "clip_id")


@query(f"""{_PLAN}, t AS (SELECT clip_id, k.n, CASE WHEN still THEN 0e0 ELSE k.n * duration / p.n END AS seconds FROM p, range(90) k(n) WHERE k.n < CASE WHEN still THEN 1 ELSE p.n END)
SELECT clip_id, t.n::BIGINT AS n, {s6(seconds='seconds', luma='luma')} FROM t JOIN steps USING (clip_id) WHERE frame_no = CAST(floor(seconds / 7e-1 + 1e-9) AS BIGINT)""")
def sampled_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of clips that are looked at, by equi-join on the frame that a time falls in."""
    at = sampling.sampled_times(sampling.sampling_plan(clips(spark, sf_dir)))
    at = at.withColumn("frame_no", F.floor(F.col("seconds") / 0.7 + 1e-9).cast("int"))
    return rounded(at.join(fixtures.steps(spark, sf_dir).select("clip_id", "frame_no", "luma"), ["clip_id", "frame_no"]).select("clip_id", "n", "seconds", "luma"), "clip_id")


@query(f"""{SCENE_LUM}, rad AS (SELECT *, greatest(2, CAST(round_even(least({W}, h) * 5e-2, 0) AS INT)) AS radius, r >= 200 AS anchor FROM lum),
near AS (SELECT a.frame_id, a.idx, a.lum, avg(b.lum) AS mean FROM rad a JOIN rad b ON a.frame_id = b.frame_id AND abs(a.x - b.x) <= a.radius AND abs(a.y - b.y) <= a.radius WHERE a.anchor GROUP BY a.frame_id, a.idx, a.lum),
e AS (SELECT frame_id, count(*) AS anchors, quantile_cont(log2(greatest(lum, 1e-6) / greatest(mean, 1e-6)), 0.5) AS ev FROM near GROUP BY frame_id)
SELECT frame_id, coalesce(anchors, 0) AS anchors, {s6(ev='ev')} FROM (SELECT DISTINCT frame_id FROM rad) LEFT JOIN e USING (frame_id)""")
def anchor_neighborhood_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the bright parts of a frame stand out of what is around them."""
    px = colour.with_linear(fixtures.scenes(spark, sf_dir)).withColumn("lum", colour.combined(colour.LUMINANCE["srgb"], *[F.col(f"lin_{c}") for c in "rgb"]))
    px = sampling.completed(px.select("frame_id", "idx", "x", "y", "h", "r", "lum"), W)
    return rounded(sampling.neighbourhood_ev(px, F.lit(W), F.col("h"), F.coalesce(F.col("r") >= 200, F.lit(False))), "frame_id")


SPAN = 4


def polygons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames, and keyframes of a polygon, one for every SPAN'th frame of a clip of 10 frames: suppliers as frames."""
    frames = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id")).withColumns({"clip_id": F.expr("frame_id div 10"), "frame_no": F.expr("frame_id % 10")})
    keys = frames.filter(F.col("frame_no") % SPAN == 0)
    k = F.col("frame_id")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    shape = F.array(point(k % 5, k % 3), point(F.lit(31) - k % 7, k % 4), point(k % 11 + 8, k % 6 + 5), point(F.lit(28) - k % 3, F.lit(15) - k % 2), point(k % 4 + 2, F.lit(14) - k % 5))
    return frames, keys.select("clip_id", "frame_no", shape.alias("points"))


_FRAMES = "sup AS (SELECT s_suppkey AS frame_id, s_suppkey // 10 AS clip_id, s_suppkey % 10 AS frame_no FROM supplier)"
_SHAPE = "[{'x': k % 5e0, 'y': k % 3e0}, {'x': 31e0 - k % 7, 'y': k % 4e0}, {'x': k % 11 + 8e0, 'y': k % 6 + 5e0}, {'x': 28e0 - k % 3, 'y': 15e0 - k % 2}, {'x': k % 4 + 2e0, 'y': 14e0 - k % 5}]"
POLYGONS = f"""{_FRAMES}, keyed AS (SELECT clip_id, frame_no AS t0, {_SHAPE} AS p0 FROM (SELECT *, frame_id AS k FROM sup) WHERE frame_no % {SPAN} = 0),
pairs AS (SELECT *, lead(t0) OVER o AS t1, lead(p0) OVER o AS p1 FROM keyed WINDOW o AS (PARTITION BY clip_id ORDER BY t0)),
poly AS (SELECT s.frame_id, CASE WHEN p1 IS NULL THEN p0 ELSE list_transform(range(1, 6), lambda i: {{'x': p0[i].x + (p1[i].x - p0[i].x) * (frame_no - t0) / (t1 - t0), 'y': p0[i].y + (p1[i].y - p0[i].y) * (frame_no - t0) / (t1 - t0)}}) END AS pts
  FROM sup s JOIN pairs p ON p.clip_id = s.clip_id AND s.frame_no >= t0 AND (t1 IS NULL OR s.frame_no < t1)),
edges AS (SELECT frame_id, pts[k].x AS ax, pts[k].y AS ay, pts[k % 5 + 1].x AS bx, pts[k % 5 + 1].y AS by_ FROM poly, range(1, 6) t(k)),
hits AS (SELECT px.frame_id, px.idx, any_value(px.r) AS r, sum(CASE WHEN (ay > px.y) <> (by_ > px.y) AND px.x < (bx - ax) * (px.y - ay) / (by_ - ay) + ax THEN 1 ELSE 0 END) % 2 = 1
  OR bool_or((bx - ax) * (px.y - ay) = (by_ - ay) * (px.x - ax) AND px.x BETWEEN least(ax, bx) AND greatest(ax, bx) AND px.y BETWEEN least(ay, by_) AND greatest(ay, by_)) AS inside FROM px JOIN edges USING (frame_id) GROUP BY px.frame_id, px.idx)"""


@query(f"WITH {fixtures.SCENES_SQL}, {POLYGONS} SELECT frame_id, idx::BIGINT AS idx, inside FROM hits")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of every frame against its frame's polygon, which moves between keyframes."""
    frames, keys = polygons(spark, sf_dir)
    placed = sampling.between_keyframes(frames.select("clip_id", "frame_no"), keys).join(frames, ["clip_id", "frame_no"]).select("frame_id", "points")
    rows = fixtures.scenes(spark, sf_dir).join(placed, "frame_id")
    return rows.select("frame_id", F.col("idx").cast("long"), F.coalesce(sampling.inside(F.col("x"), F.col("y"), F.col("points")), F.lit(False)).alias("inside"))
