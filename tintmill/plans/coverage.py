"""Queries over masks and clips in time, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.functions import labels
from tintmill.operators import coverage as cov
from tintmill.plans import sql
from tintmill.plans.frames import colour_names, rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures
from tintmill.sources.fixtures import WIDTH, table

SCENES, STEPS = f"WITH {fixtures.SCENES_SQL}", f"WITH {fixtures.STEPS_SQL}"


@query(f"""{SCENES}, d AS (SELECT frame_id, y, CASE WHEN y < frame_id % 3 OR y >= h - frame_id % 2 THEN 0 ELSE {sql.luma()} END AS luma FROM px),
rw AS (SELECT frame_id, y, avg(luma) AS luma FROM d GROUP BY frame_id, y)
SELECT frame_id, CAST(coalesce(min(y) FILTER (WHERE luma >= 1.2e-2), 0) AS BIGINT) AS first_row, CAST(coalesce(max(y) FILTER (WHERE luma >= 1.2e-2), max(y)) + 1 AS BIGINT) AS end_row FROM rw GROUP BY frame_id""")
def active_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows between a frame's dark bars."""
    bar = (F.col("y") < F.col("frame_id") % 3) | (F.col("y") >= F.col("h") - F.col("frame_id") % 2)
    rows = fixtures.scenes(spark, sf_dir)
    return cov.active_rows(rows.withColumns({c: F.when(bar, 0).otherwise(F.col(c)) for c in "rgb"}), WIDTH)


@query(f"""{SCENES}, la AS (SELECT *, abs(r - lag(r) OVER (PARTITION BY frame_id, x ORDER BY y)) > 90 AS jump FROM px WHERE x % 2 = 0 AND y % greatest(1, h // 12) = 0)
SELECT frame_id, {s6(coverage='avg(CASE WHEN r >= 200 THEN 1e0 ELSE 0e0 END)', soft_edge_ratio='avg(CASE WHEN r BETWEEN 60 AND 199 THEN 1e0 ELSE 0e0 END)', boundary_activity='avg(CASE WHEN jump THEN 1e0 ELSE 0e0 END)', mean='avg(r) / 255e0')} FROM la GROUP BY frame_id""")
def mask_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, soft edges and activity of a mask on a lattice of 12 x 12."""
    return rounded(cov.mask_stats(fixtures.scenes(spark, sf_dir).withColumn("value", F.col("r")), WIDTH, 12))


@query(f"{SCENES} SELECT frame_id, {s6(edge_ratio='sum(' + ' + '.join(f'CASE WHEN {c} IN (0, 255) THEN 1 ELSE 0 END' for c in 'rgb') + ') / (count(*) * 3e0)')} FROM px GROUP BY frame_id")
def gamut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of channel values at either end of their range."""
    return rounded(fixtures.scenes(spark, sf_dir).groupBy("frame_id").agg(cov.edge_ratio("r", "g", "b").alias("edge_ratio")))


@query(f"{STEPS}, d AS (SELECT clip_id, min(frame_no) AS a, max(frame_no) AS b FROM steps WHERE value > 250 GROUP BY clip_id) SELECT clip_id, frame_no FROM steps JOIN d USING (clip_id) WHERE value <= 250 AND frame_no BETWEEN a AND b")
def detection_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without a detection between a clip's first and last."""
    return cov.isolated_gaps(fixtures.steps(spark, sf_dir).select("clip_id", "frame_no", (F.col("value") > 250).alias("detected")))


FPS = 10
_SEGMENTS = f"""{STEPS}, n AS (SELECT clip_id, count(*) AS frames FROM steps GROUP BY clip_id), sg AS (
  SELECT clip_id, frames, 8 + clip_id % 5 AS s, 8 + clip_id % 5 + 11 AS e, CASE WHEN clip_id % 4 = 0 THEN 4 ELSE 5 END AS t FROM n UNION ALL SELECT clip_id, frames, 22 + clip_id % 3, 33 + clip_id % 3, 6 FROM n),
ck AS (SELECT *, s > coalesce(lag(e) OVER (PARTITION BY clip_id ORDER BY s, e), -1) AND s >= 10 AND e < frames AND e - s + 1 >= 10 AND t >= 5 AND t * 2 <= e - s + 1 AS ok FROM sg)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fixtures.steps(spark, sf_dir)
    clips = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"))
    start = (F.col("clip_id") % 5) + 8
    first = F.struct(start.alias("s"), (start + 11).alias("e"), F.when(F.col("clip_id") % 4 == 0, 4).otherwise(5).cast("long").alias("t"))
    later = F.col("clip_id") % 3
    second = F.struct((later + 22).alias("s"), (later + 33).alias("e"), F.lit(6).cast("long").alias("t"))
    segments = clips.select("clip_id", F.explode(F.array(first, second)).alias("p")).select("clip_id", F.col("p.s").alias("start_frame"), F.col("p.e").alias("end_frame"), F.col("p.t").alias("transition_frames"))
    return cov.checked_releases(segments, clips, FPS)


@query(f"{_SEGMENTS} SELECT clip_id, s AS start_frame, e AS end_frame, CAST(t AS BIGINT) AS transition_frames, ok AS valid FROM ck")
def release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which releases are held back, long and gentle enough."""
    return _segments(spark, sf_dir)


@query(f"""{_SEGMENTS}, cl AS (SELECT * FROM ck WHERE clip_id IN (SELECT clip_id FROM ck GROUP BY clip_id HAVING bool_and(ok))),
x AS (SELECT clip_id, frame_no, least(1e0, (frame_no - s + 1) / CAST(t AS DOUBLE), (e - frame_no + 1) / CAST(t AS DOUBLE)) AS x FROM steps JOIN cl USING (clip_id) WHERE frame_no BETWEEN s AND e)
SELECT clip_id, frame_no, {s6(weight='coalesce(x * x * (3 - 2 * x), 0e0)')} FROM steps LEFT JOIN x USING (clip_id, frame_no)""")
def release_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of a release at each frame; a clip with a segment that is not valid has none."""
    segments = _segments(spark, sf_dir).withColumn("all_valid", F.every("valid").over(Window.partitionBy("clip_id"))).filter("all_valid")
    return rounded(cov.release_weights(fixtures.steps(spark, sf_dir), segments))


@query(f"""{STEPS}, s AS (SELECT clip_id, frame_no // 8 AS shot, luma, value / 4900e0 AS m, radians(user_id * 7 % 360) AS a FROM steps),
v AS (SELECT clip_id, shot, count(*) AS samples, avg(luma) AS luma, avg(m * cos(a)) AS ca, avg(m * sin(a)) AS cb FROM s GROUP BY clip_id, shot)
SELECT clip_id, shot, samples, {s6(luma='luma', cast_a='ca', cast_b='cb', cast_magnitude='sqrt(ca * ca + cb * cb)', cast_hue=sql.hue('ca', 'cb'))} FROM v""")
def shot_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of a shot, its cast averaged as a vector."""
    shot = F.expr("frame_no div 8")
    rows = fixtures.steps(spark, sf_dir).select("clip_id", shot.alias("shot"), "luma", (F.col("value") / 4900.0).alias("cast_magnitude"), (F.col("user_id") * 7 % 360).alias("cast_hue"))
    return rounded(cov.shot_profile(rows, ["luma"]))


@query("""WITH l AS (SELECT l_suppkey AS recipe_id, l_linenumber % 3 AS level, avg(l_extendedprice) AS effect FROM lineitem GROUP BY ALL),
g AS (SELECT recipe_id, effect > coalesce(lag(effect) OVER (PARTITION BY recipe_id ORDER BY level), effect - 1) AS up FROM l) SELECT recipe_id, count(*) AS levels, bool_and(up) AS strictly_rising FROM g GROUP BY recipe_id""")
def strength_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes whose effect grows with every strength."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("recipe_id"), (F.col("l_linenumber") % 3).alias("level")).agg(F.avg("l_extendedprice").alias("effect"))
    return cov.rising(rows, ["recipe_id"], "level", "effect")


@query(f"""WITH l AS (SELECT l_suppkey AS device, CAST(l_linenumber AS BIGINT) AS x, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT device, x, {s6(measured='v', monotone='max(v) OVER (PARTITION BY device ORDER BY x)')} FROM l""")
def response_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of devices that never fall."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("device"), F.col("l_linenumber").cast("long").alias("x")).agg(F.avg("l_quantity").alias("measured"))
    return rounded(cov.forced_rising(rows, "device", "x", "measured"))


@query(f"{SCENES} SELECT frame_id, {s6(lift='avg(least(greatest((r - 16) * 3, 0), 255))', gain='avg(least(r * 1.5e0, 255e0))', invert='avg(least(greatest((140 - r) * 2, 0), 255))')} FROM px GROUP BY frame_id")
def mask_remaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three maps that stretch a mask."""
    kinds = ("lift", "gain", "invert")
    return rounded(fixtures.scenes(spark, sf_dir).groupBy("frame_id").agg(*[F.avg(cov.remapped(F.col("r"), k)).alias(k) for k in kinds]))


_WARM = "2e-1 * (1 - least(1e0, sqrt(pow(x / 32e0 - 3e-1, 2) + pow(y / CAST(h AS DOUBLE) - 4e-1, 2)) / 2.5e-1))"


@query(f"{SCENES}, w AS (SELECT *, {_WARM} AS w FROM px) SELECT frame_id, {s6(r='avg(least(r * (1 + w), 255e0))', g='avg(least(g * (1 + w * 3.5e-1), 255e0))', b='avg(least(greatest(b * (1 - w * 5.5e-1), 0e0), 255e0))')} FROM w GROUP BY frame_id")
def light_warmth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warmth that falls off with the distance from a light."""
    rows = fixtures.scenes(spark, sf_dir)
    warm = cov.warmed(F.col("x") / float(WIDTH), F.col("y") / F.col("h"), (F.lit(0.3), F.lit(0.4)), F.lit(0.1), 0.2)
    return rounded(rows.groupBy("frame_id").agg(*[F.avg(v).alias(c) for c, v in warm.items()]))


@query(f"""{SCENES}, {sql.oklab()}, f AS (SELECT frame_id, {sql.cases(sql.hue('oka', 'okb'), labels.HUE_FAMILIES, labels.HUE_FAMILIES[0][1])} AS family FROM lab),
n AS (SELECT frame_id, family, count(*) AS pixels FROM f GROUP BY ALL) SELECT frame_id, family, pixels, row_number() OVER (PARTITION BY frame_id ORDER BY pixels DESC, family) AS dominance_rank FROM n""")
def dominance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hue families of a frame by the area they cover; of equals the first name."""
    areas = colour_names(spark, sf_dir).groupBy("frame_id", "family").agg(F.count(F.lit(1)).alias("pixels"))
    order = Window.partitionBy("frame_id").orderBy(F.col("pixels").desc(), "family")
    return rounded(areas.withColumn("dominance_rank", F.row_number().over(order)))
