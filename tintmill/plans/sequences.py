"""Queries over clips: steps, transitions, cuts, shots, dissolves, timelines and shot matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.operators import diagnosis as diag
from tintmill.operators import sequence as seq
from tintmill.plans import sql
from tintmill.plans.frames import POLISHED_SQL, rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures

#: Frames a second of the coarse scan.
FPS = 10

STEP = "st AS (SELECT clip_id, frame_no, luma, abs(lead(luma) OVER o - luma) AS step, count(*) OVER (PARTITION BY clip_id) AS n FROM steps WINDOW o AS (PARTITION BY clip_id ORDER BY frame_no))"
CLIP = f"WITH RECURSIVE {fixtures.STEPS_SQL}, {STEP}"


@query(f"""{CLIP}, big AS (SELECT clip_id, frame_no, row_number() OVER (PARTITION BY clip_id ORDER BY step DESC, frame_no) AS k FROM st WHERE step IS NOT NULL)
SELECT clip_id, any_value(n) AS frames, count(step) AS steps, {s6(mean_step='avg(step)', median_step='quantile_cont(step, 0.5)', largest='max(step)')}, any_value(b.at) AS largest_at
FROM st LEFT JOIN (SELECT clip_id, frame_no AS at FROM big WHERE k = 1) b USING (clip_id) GROUP BY clip_id""")
def shot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between neighbouring frames, and where the largest is."""
    rows = seq.with_step(fixtures.steps(spark, sf_dir))
    first = F.max_by(-F.col("frame_no"), F.struct("step", -F.col("frame_no")))
    out = rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.count("step").alias("steps"), F.avg("step").alias("mean_step"), F.percentile("step", 0.5).alias("median_step"), F.max("step").alias("largest"), first.alias("at"))
    return rounded(out.select("*", F.when(F.col("steps") > 0, -F.col("at")).cast("long").alias("largest_at")).drop("at"))


def _scale(w: int) -> str:
    over = "OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN {} AND {})"
    inside, before, after = over.format("CURRENT ROW", f"{w - 1} FOLLOWING"), over.format(f"{w} PRECEDING", "1 PRECEDING"), over.format(f"{w} FOLLOWING", f"{2 * w - 1} FOLLOWING")
    return f"""SELECT * FROM (SELECT clip_id, frame_no AS start, n, CAST({w} AS BIGINT) AS length, abs(lead(luma, {w}) OVER (PARTITION BY clip_id ORDER BY frame_no) - luma) AS direct, sum(step) {inside} AS travelled, max(step) {inside} AS peak,
  quantile_cont(step, 0.5) {inside} AS inside, least(quantile_cont(step, 0.5) {before}, quantile_cont(step, 0.5) {after}) AS base FROM st) WHERE start % {max(1, w // 3)} = 0 AND start < n - 1 - {w}"""


@query(f"""{CLIP}, win AS ({' UNION ALL '.join(map(_scale, seq.window_lengths(FPS)))})
SELECT clip_id, start, length, {s6(direct='direct', travelled='travelled', peak='peak', coherence='direct / travelled')}, direct / travelled >= 5e-1 AND peak < direct * 5e-1 AND (base <= 0 OR inside >= base * 2.5e0) AS accepted
FROM win WHERE direct >= 8e-2 AND travelled > 0 AND base IS NOT NULL""")
def shot_gradual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four lengths in which the picture drifts, and which of them are transitions."""
    rows = seq.gradual_windows(fixtures.steps(spark, sf_dir), FPS)
    return rounded(rows.select("clip_id", "start", "length", "direct", "travelled", "peak", "coherence", "accepted"))


@query(f"""{CLIP}, win AS ({' UNION ALL '.join(map(_scale, seq.window_lengths(FPS)))}),
ok AS (SELECT clip_id, start, length, direct / travelled AS coherence FROM win WHERE direct >= 8e-2 AND travelled > 0 AND base IS NOT NULL AND direct / travelled >= 5e-1 AND peak < direct * 5e-1 AND (base <= 0 OR inside >= base * 2.5e0)),
ls AS (SELECT clip_id, list({{'c': -coherence, 'l': length, 's': start}} ORDER BY -coherence, length, start) AS ws FROM ok GROUP BY clip_id),
fd AS (SELECT clip_id, ws, ws[1:0] AS kept, 1 AS k FROM ls UNION ALL SELECT clip_id, ws, CASE WHEN len(list_filter(kept, lambda t: ws[k].s < t.s + t.l AND t.s < ws[k].s + ws[k].l)) > 0 THEN kept ELSE list_append(kept, ws[k]) END, k + 1 FROM fd WHERE k <= len(ws)),
un AS (SELECT clip_id, unnest(kept) AS w FROM fd WHERE k > len(ws)), kp AS (SELECT clip_id, w.s AS s, w.l AS l, w.s + w.l AS e, -w.c AS coherence FROM un),
d AS (SELECT clip_id, frame_no AS k, step, n - 1 AS steps FROM st WHERE step IS NOT NULL),
fl AS (SELECT kp.clip_id, s, l, e, any_value(steps) AS steps, any_value(coherence) AS coherence, quantile_cont(step, 0.5) FILTER (WHERE k >= s - l AND k < s) * 2 AS lf, quantile_cont(step, 0.5) FILTER (WHERE k >= e AND k < e + l) * 2 AS rf FROM kp JOIN d USING (clip_id) GROUP BY kp.clip_id, s, l, e)
SELECT fl.clip_id, s AS found_start, e AS found_end, CASE WHEN any_value(lf) IS NULL THEN s ELSE coalesce(max(k + 1) FILTER (WHERE k < s AND k >= greatest(0, s - 2 * l) AND step <= lf), greatest(0, s - 2 * l)) END AS start,
  CASE WHEN any_value(rf) IS NULL THEN e ELSE coalesce(min(k) FILTER (WHERE k >= e AND k < least(fl.steps, e + 2 * l) AND step <= rf), least(any_value(fl.steps), e + 2 * l)) END AS "end", {s6(coherence='any_value(coherence)')} FROM fl JOIN d USING (clip_id) GROUP BY fl.clip_id, s, l, e""")
def shot_dissolves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions without overlaps, widened to where the picture is calm."""
    frames = fixtures.steps(spark, sf_dir)
    kept = seq.without_overlaps(seq.gradual_windows(frames, FPS).filter("accepted"))
    return rounded(seq.expanded(kept, frames))


_NEAR = ", ".join(f"{f}(step, {k}) OVER o" for f in ("lag", "lead") for k in range(1, seq.AROUND + 1))
_AT = ", ".join(f"{'lag' if k < 0 else 'lead'}(luma, {abs(k)}) OVER o AS l{'m' if k < 0 else 'p'}{abs(k)}" for k in range(-4, 5) if k)
CUTS = f"""nb AS (SELECT *, list_filter([{_NEAR}], lambda x: x IS NOT NULL) AS near, {_AT},
  coalesce(max(step) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN {seq.AROUND} PRECEDING AND 1 PRECEDING), -1e0) AS earlier, coalesce(max(step) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND {seq.AROUND} FOLLOWING), -1e0) AS later
  FROM st WINDOW o AS (PARTITION BY clip_id ORDER BY frame_no)),
pk AS (SELECT *, {' OR '.join(f'coalesce(abs(lm1 - lp{1 + k}) < step * 3.5e-1, FALSE)' for k in (1, 2, 3))} AS rises,
  CASE {' '.join(f'WHEN abs(lm{1 + k} - lp1) < step * 3.5e-1 THEN {k}' for k in (1, 2, 3))} END AS falls FROM nb WHERE step >= 1e-1 AND step > earlier AND step >= later),
cuts AS (SELECT clip_id, CAST(CASE WHEN rises OR falls IS NULL THEN frame_no ELSE frame_no - 1 - falls END + 1 AS BIGINT) AS frame_no, CASE WHEN rises OR falls IS NOT NULL THEN 'flash' ELSE 'hard_cut' END AS kind,
  round(least(step / (step + coalesce(list_aggregate(near, 'median'), 0e0) * 3), 9.9e-1), 6) AS confidence FROM pk)"""


_DETAIL = "((user_id * 37 + frame_no * 11) % 100) / 2000e0"


@query(f"""{CLIP}, {CUTS}, h AS (SELECT clip_id, frame_no - 1 AS peak FROM cuts WHERE kind = 'hard_cut'), ne AS (SELECT h.clip_id, peak, frame_no - peak AS off, {_DETAIL} AS detail FROM h JOIN steps ON steps.clip_id = h.clip_id AND frame_no BETWEEN peak - 9 AND peak + 9),
sd AS (SELECT clip_id, peak, count(*) AS n, least(coalesce(max(detail) FILTER (WHERE off < -1), 0e0), coalesce(max(detail) FILTER (WHERE off >= 2), 0e0)) AS shoulder, min(detail) FILTER (WHERE off BETWEEN -2 AND 3) AS trough FROM ne GROUP BY clip_id, peak),
dp AS (SELECT *, CASE WHEN shoulder > 0 THEN 1 - trough / shoulder ELSE 0e0 END AS depth FROM sd)
SELECT clip_id, peak + 1 AS frame_no, n, {s6(shoulder='shoulder', trough='trough', depth='depth')}, n >= 8 AND depth >= 4.5e-1 AND shoulder >= 1e-2 AS suspected FROM dp""")
def whip_pans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard cuts about which detail sinks on both sides."""
    frames = fixtures.steps(spark, sf_dir)
    detail = ((F.col("user_id") * 37 + F.col("frame_no") * 11) % 100) / 2000.0
    return rounded(seq.whip_pans(seq.boundaries(frames), frames.withColumn("detail", detail), 9))


@query(f"""WITH {fixtures.STEPS_SQL}, j AS (SELECT *, abs(luma - lag(luma) OVER (PARTITION BY clip_id ORDER BY frame_no)) AS jump FROM steps)
SELECT clip_id, count(*) AS frames, {s6(mean_luma='avg(luma)', std_luma='stddev_pop(luma)', jump_luma='coalesce(max(jump), 0e0)')} FROM j GROUP BY clip_id""")
def clip_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure's mean and spread over a clip, and its largest jump."""
    return rounded(seq.over_time(fixtures.steps(spark, sf_dir), ["luma"]))


@query(f"{CLIP}, {CUTS} SELECT clip_id, frame_no, kind, {s6(confidence='confidence')}, confidence < 6e-1 AND kind <> 'flash' AS review FROM cuts")
def shot_flash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts with their confidence, and flashes by either edge."""
    found = seq.boundaries(fixtures.steps(spark, sf_dir))
    return rounded(found.withColumn("review", (F.col("confidence") < seq.REVIEW_BELOW) & (F.col("kind") != "flash")))


KEPT = f"""{CUTS}, od AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no, confidence, kind) AS rn FROM cuts),
fold AS (SELECT clip_id, rn, frame_no, kind, confidence, 1 AS grp FROM od WHERE rn = 1
  UNION ALL SELECT o.clip_id, o.rn, CASE WHEN o.frame_no - f.frame_no >= 6 OR o.confidence > f.confidence THEN o.frame_no ELSE f.frame_no END, CASE WHEN o.frame_no - f.frame_no >= 6 OR o.confidence > f.confidence THEN o.kind ELSE f.kind END,
    CASE WHEN o.frame_no - f.frame_no >= 6 OR o.confidence > f.confidence THEN o.confidence ELSE f.confidence END, CASE WHEN o.frame_no - f.frame_no >= 6 THEN f.grp + 1 ELSE f.grp END FROM fold f JOIN od o ON o.clip_id = f.clip_id AND o.rn = f.rn + 1),
kept AS (SELECT clip_id, arg_max(frame_no, rn) AS frame_no, arg_max(kind, rn) AS kind, arg_max(confidence, rn) AS confidence FROM fold GROUP BY clip_id, grp)"""
SHOTS = f"""{KEPT}, ends AS (SELECT clip_id, frame_no AS stop, kind AS ends_with FROM kept WHERE kind <> 'flash' UNION ALL SELECT clip_id, count(*), 'end-of-file' FROM steps GROUP BY clip_id),
pieces AS (SELECT *, lag(stop, 1, 0) OVER (PARTITION BY clip_id ORDER BY stop, ends_with = 'end-of-file') AS start FROM ends),
shots AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY stop, ends_with = 'end-of-file') - 1 AS shot, start, stop, ends_with FROM pieces WHERE ends_with = 'end-of-file' OR stop - start >= 3)"""


def found_shots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames, and the shots in them."""
    frames = fixtures.steps(spark, sf_dir)
    kept = seq.deduplicated(seq.boundaries(frames), FPS)
    return frames, seq.shots(kept, frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")), FPS)


@query(f"{CLIP}, {KEPT} SELECT clip_id, frame_no, kind, {s6(confidence='confidence')}, CASE WHEN kind <> 'flash' AND confidence < 6e-1 THEN row_number() OVER (PARTITION BY clip_id, kind <> 'flash' AND confidence < 6e-1 ORDER BY confidence, frame_no) END AS review_rank FROM kept")
def shot_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries at least a shot apart, and the order in which to look at the unsure ones."""
    kept = seq.deduplicated(seq.boundaries(fixtures.steps(spark, sf_dir)), FPS)
    unsure = (F.col("kind") != "flash") & (F.col("confidence") < seq.REVIEW_BELOW)
    queue = Window.partitionBy("clip_id", "unsure").orderBy("confidence", "frame_no")
    rows = kept.withColumn("unsure", unsure).withColumn("review_rank", F.when(F.col("unsure"), F.row_number().over(queue)))
    return rounded(rows.drop("unsure"))


@query(f"{CLIP}, {SHOTS} SELECT clip_id, shot, start, stop AS \"end\", ends_with FROM shots")
def shot_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots between cuts, flashes left inside."""
    return found_shots(spark, sf_dir)[1]


INSIDE = f"{SHOTS}, ins AS (SELECT s.clip_id, s.shot, f.frame_no, f.luma, f.step FROM shots s JOIN st f ON f.clip_id = s.clip_id AND f.frame_no >= s.start AND f.frame_no < s.stop)"


@query(f"""{CLIP}, {INSIDE} SELECT clip_id, shot, count(*) AS frames, {s6(mean_luma='avg(luma)', spread='stddev_pop(luma)', span='max(luma) - min(luma)')}, count(*) FILTER (WHERE step > 1.2e-1) AS jumps FROM ins GROUP BY ALL""")
def shot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies inside each shot."""
    frames, found = found_shots(spark, sf_dir)
    rows = seq.with_shot(seq.with_step(frames), found)
    return rounded(rows.groupBy("clip_id", "shot").agg(F.count(F.lit(1)).alias("frames"), F.avg("luma").alias("mean_luma"), F.stddev_pop("luma").alias("spread"), (F.max("luma") - F.min("luma")).alias("span"), F.count_if(F.col("step") > 0.12).alias("jumps")))


@query(f"""{CLIP}, {INSIDE}, rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id, shot ORDER BY luma, frame_no) - 1 AS k, count(*) OVER (PARTITION BY clip_id, shot) AS m FROM ins),
md AS (SELECT clip_id, shot, luma AS middle FROM rk WHERE k = m // 2), cl AS (SELECT clip_id, shot, frame_no, middle, row_number() OVER (PARTITION BY clip_id, shot ORDER BY abs(luma - middle), frame_no) AS best FROM ins JOIN md USING (clip_id, shot))
SELECT clip_id, shot, {s6(middle='middle')}, frame_no AS representative FROM cl WHERE best = 1""")
def representative_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame that stands for its shot."""
    frames, found = found_shots(spark, sf_dir)
    return rounded(seq.representatives(seq.with_shot(frames, found)))


@query(f"""{CLIP}, {SHOTS}, gap AS (SELECT *, start - lag(stop) OVER (PARTITION BY clip_id ORDER BY start, stop) AS away FROM shots), ends2 AS (SELECT clip_id, count(*) AS n FROM steps GROUP BY clip_id)
SELECT clip_id, count(*) AS segments, count(*) FILTER (WHERE away > 0) AS gaps, count(*) FILTER (WHERE away < 0) AS overlaps, count(*) FILTER (WHERE away <> 0) = 0 AND min(start) = 0 AND max(stop) = any_value(n) AS covered FROM gap JOIN ends2 USING (clip_id) GROUP BY clip_id""")
def segment_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether segments follow each other without gap or overlap from first to last frame."""
    frames, found = found_shots(spark, sf_dir)
    rows = found.withColumn("away", F.col("start") - F.lag("end").over(Window.partitionBy("clip_id").orderBy("start", "end")))
    rows = rows.join(frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")), "clip_id")
    away = F.col("away")
    whole = (F.count_if(away != 0) == 0) & (F.min("start") == 0) & (F.max("end") == F.max("n"))
    return rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(away > 0).alias("gaps"), F.count_if(away < 0).alias("overlaps"), whole.alias("covered"))


RATE, TIMESCALE = 30, 15360


@query(f"""WITH {fixtures.STEPS_SQL}, p AS (SELECT clip_id, frame_no, frame_no * 512 + CASE WHEN event_id % 97 = 0 THEN 9 WHEN event_id % 89 = 0 THEN -1024 ELSE 0 END AS pts FROM steps), q AS (SELECT *, pts - lag(pts) OVER (PARTITION BY clip_id ORDER BY frame_no) AS gone FROM p)
SELECT clip_id, count(*) FILTER (WHERE abs(pts * {RATE} - frame_no * {TIMESCALE}) * 2 > {RATE}) AS off_beat, count(*) FILTER (WHERE gone <= 0) AS not_rising, count(*) FILTER (WHERE abs(pts * {RATE} - frame_no * {TIMESCALE}) * 2 > {RATE} OR gone <= 0) = 0 AS regular FROM q GROUP BY clip_id""")
def pts_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps rise and keep to the frame rate, in whole numbers."""
    moved = F.when(F.col("event_id") % 97 == 0, 9).when(F.col("event_id") % 89 == 0, -1024).otherwise(0)
    rows = fixtures.steps(spark, sf_dir).withColumn("pts", F.col("frame_no").cast("long") * 512 + moved)
    rows = rows.withColumns({"off": seq.off_beat(F.col("pts"), F.col("frame_no"), RATE, TIMESCALE), "still": F.coalesce(F.col("pts") - F.lag("pts").over(seq.clip_order()) <= 0, F.lit(False))})
    return rows.groupBy("clip_id").agg(F.count_if("off").alias("off_beat"), F.count_if("still").alias("not_rising"), (F.count_if(F.col("off") | F.col("still")) == 0).alias("regular"))


@query(f"""WITH {fixtures.RECIPES_SQL}, g AS (SELECT media, recipe_id, 1 + midpoint_ev AS ga, 1 + 6e-1 * temperature AS re, 1 - 6e-1 * temperature AS bl FROM recipes), nx AS (SELECT *, lead(ga) OVER o AS ga2, lead(re) OVER o AS re2, lead(bl) OVER o AS bl2 FROM g WINDOW o AS (PARTITION BY media ORDER BY recipe_id)),
n AS (SELECT *, CAST(least(greatest(ceil(round(greatest(abs(ga2 - ga), abs(re2 - re), abs(bl2 - bl)) / 4e-2, 6)), 6), 48) AS BIGINT) AS steps FROM nx WHERE ga2 IS NOT NULL), e AS (SELECT *, unnest(range(1, steps + 1)) AS step FROM n)
SELECT recipe_id, steps, step, {s6(share='step / CAST(steps AS DOUBLE)', gamma='ga + (ga2 - ga) * step / steps')} FROM e""")
def dissolve_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dissolve between neighbouring grades as steps small enough not to show."""
    t = F.col("temperature")
    rows = fixtures.recipes(spark, sf_dir).select("media", "recipe_id", (F.lit(1) + F.col("midpoint_ev")).alias("ga"), (F.lit(1) + t * 0.6).alias("re"), (F.lit(1) - t * 0.6).alias("bl"))
    order, names = Window.partitionBy("media").orderBy("recipe_id"), ("ga", "re", "bl")
    rows = rows.withColumns({n + "2": F.lead(n).over(order) for n in names}).filter("ga2 is not null")
    rows = rows.withColumn("steps", seq.dissolve_steps([F.col(n) for n in names], [F.col(n + "2") for n in names]))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("steps"))))
    return rounded(rows.select("recipe_id", "steps", "step", (F.col("step") / F.col("steps")).alias("share"), (F.col("ga") + (F.col("ga2") - F.col("ga")) * F.col("step") / F.col("steps")).alias("gamma")))


HEALTH = "least(tone_span, 7.5e-1) * 26 + least(seconds, 8e0) - luma_blown_ratio * 260 - luma_crushed_ratio * 90 - abs(p50 - 2.2e-1) * 55 - greatest(p01 - 5e-2, 0e0) * 60 - greatest(p99 - 9.7e-1, 0e0) * 120"
ANCHORED = f"""{POLISHED_SQL}, hl AS (SELECT *, frame_id // 10 AS reel, round({HEALTH}, 6) + 0e0 AS health FROM (SELECT *, n / 1e2 AS seconds FROM stats)),
rk AS (SELECT *, row_number() OVER (PARTITION BY reel ORDER BY health DESC, frame_id) AS rank FROM hl)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each scene as if of a shot, ten to a reel, with their score and rank."""
    c = F.col
    rows = diag.statistics(fixtures.scenes(spark, sf_dir), parts=fixtures.frame_parts(spark, sf_dir))
    score = seq.health(c("tone_span"), c("p01"), c("p50"), c("p99"), c("luma_blown_ratio"), c("luma_crushed_ratio"), c("n") / 100.0)
    rows = rows.withColumns({"reel": F.expr("frame_id div 10"), "health": F.round(score, 6) + 0.0})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("reel").orderBy(c("health").desc(), "frame_id")))


@query(f"{ANCHORED} SELECT reel, frame_id, health, rank, rank = 1 AS anchor FROM rk")
def shot_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The healthiest shot of a reel, to which the others are matched."""
    return rounded(profiles(spark, sf_dir).select("reel", "frame_id", "health", "rank", (F.col("rank") == 1).alias("anchor")))


_LIKE = "least(s.{0}, a.{0}) / greatest(s.{0}, a.{0}, 1e-6)"
_APART = {"chromatic_pixel_ratio": "abs(s.chromatic_pixel_ratio - a.chromatic_pixel_ratio) > 3e-1"} | {n: f"{_LIKE.format(n)} < {sql.num(v)}" for n, v in (("colorfulness", 0.65), ("tone_span", 0.45), ("local_contrast_region", 0.45))}


@query(f"""{ANCHORED}, j AS (SELECT s.frame_id, a.frame_id AS anchor_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _APART.items())}], lambda x: x IS NOT NULL), ',') AS apart FROM rk s JOIN rk a ON s.reel = a.reel AND a.rank = 1)
SELECT frame_id, anchor_id, apart, apart = '' AS eligible FROM j""")
def match_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only shots whose statistics resemble the anchor's are matched to it."""
    fields = F.struct("frame_id", "chromatic_pixel_ratio", "colorfulness", "tone_span", "local_contrast_region")
    rows = profiles(spark, sf_dir).select("reel", "rank", fields.alias("own"))
    rows = rows.withColumn("anchor", F.first("own").over(Window.partitionBy("reel").orderBy("rank")))
    apart = seq.differences("own", "anchor")
    return rows.select("own.frame_id", F.col("anchor.frame_id").alias("anchor_id"), apart.alias("apart"), (apart == "").alias("eligible"))
