"""Queries over the foundation of frames: plan, curve, readiness, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.functions import colour
from tintmill.operators import diagnosis, foundation
from tintmill.plans import frames as own
from tintmill.plans import sql
from tintmill.plans.frames import rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures


def hazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of which a third lies under haze, a third has lost its colour, and a third is as it was."""
    px = fixtures.scenes(spark, sf_dir)
    grey = F.expr("(2 * r + 3 * g + b) div 6")
    haze = lambda c: F.when(F.col("frame_id") % 3 == 0, F.expr(f"70 + {c} div 3")).when(F.col("frame_id") % 3 == 1, F.expr(f"{c} div 8") + grey - F.expr("grey div 8")).otherwise(F.col(c)).cast("int")
    return px.withColumn("grey", grey).select("frame_id", "idx", "x", "y", "h", *[haze(c).alias(c) for c in "rgb"])


HAZY = f"""{fixtures.SCENES_SQL.replace(', px AS (', ', clear AS (')}, haze AS (SELECT *, (2 * r + 3 * g + b) // 6 AS grey FROM clear),
px AS (SELECT frame_id, idx, x, y, h, {', '.join(f"CAST(CASE frame_id % 3 WHEN 0 THEN 70 + {c} // 3 WHEN 1 THEN {c} // 8 + grey - grey // 8 ELSE {c} END AS INT) AS {c}" for c in 'rgb')} FROM haze)"""
_STATS = own.POLISHED_SQL[len(f"WITH {fixtures.SCENES_SQL}, "):]


def _encode(v: str) -> str:
    return f"({sql.encode(v)})"


def _linear(level: str) -> str:
    return f"({sql.decode(level)})"


def _curve_sql() -> str:
    """Points of the curve of each frame in `q`: one step for each raw point, in order."""
    raw = [("0e0", "0e0"), *((_encode(f"q{k}"), _encode(f"t{k}")) for k in ("01", "05", "50", "95")), ("9e-1", f"greatest(9e-1, {_encode('t99')})"), ("1e0", "1e0")]
    out = [f"w0 AS (SELECT *, [{{'x': 0e0, 'y': 0e0}}] AS pts FROM target)"]
    for k, (x, y) in enumerate(raw[1:], 1):
        low, high = "prev.y + 15e-2 * (x - prev.x)", "prev.y + 4e0 * (x - prev.x)"
        held = f"least(greatest({low}, y), {high})"
        ended = f"CASE WHEN x < 1 THEN least(greatest(1 - 4e0 * (1 - x), {held}), 1 - 15e-2 * (1 - x)) ELSE {held} END"
        out.append(f"""s{k} AS (SELECT *, round({x}, 6) AS x, round({y}, 6) AS y, pts[-1] AS prev FROM w{k - 1}),
w{k} AS (SELECT * EXCLUDE (x, y, prev, pts), CASE WHEN x - prev.x < 5e-2 THEN pts ELSE list_append(pts, {{'x': x, 'y': round(least(1e0, {ended}), 6)}}) END AS pts FROM s{k})""")
    return ",\n".join(out)


PLAN = f"""stats0 AS MATERIALIZED (WITH {_STATS} SELECT * FROM stats),
q0 AS (SELECT *, greatest(0e0, least(1e0, p01)) AS q01 FROM stats0), q1 AS (SELECT *, greatest(q01 + 1e-6, least(1e0, p05)) AS q05 FROM q0), q2 AS (SELECT *, greatest(q05 + 1e-6, least(1e0, p50)) AS q50 FROM q1),
q3 AS (SELECT *, greatest(q50 + 1e-6, least(1e0, p95)) AS q95 FROM q2), q4 AS (SELECT *, greatest(q95 + 1e-6, least(1e0, p99)) AS q99, tone_span < 42e-2 AS flat FROM q3),
q5 AS (SELECT *, q01 > 4e-2 AND q50 < 65e-2 AND q95 < 9e-1 AS raised, greatest(3e-2, (q95 - q05) * 1e-1) AS least_gain FROM q4),
q6 AS (SELECT *, round_even(least(1e0, {_encode('q95 + least_gain')} + 2 / 255e0) * 255, 0) AS aim FROM q5),
q7 AS (SELECT *, CASE WHEN flat THEN greatest(least_gain, {_linear('aim')} - q95) ELSE 0e0 END AS gain FROM q6),
target AS (SELECT *, CASE WHEN raised THEN greatest(6e-2, q01 - least(4e-2, (q01 - 4e-2) * 4e-1)) ELSE q01 END AS t01, CASE WHEN raised THEN greatest(11e-2, q05 - least(35e-3, (q05 - 5e-2) * 2e-1)) ELSE q05 END AS t05,
  CASE WHEN flat AND q50 < 24e-2 THEN greatest(q50, least(24e-2, q50 * 12e-1)) ELSE q50 END AS t50, CASE WHEN flat THEN greatest(q95, least(68e-2, q95 + gain)) ELSE q95 END AS t95,
  CASE WHEN flat THEN greatest(q99, least(82e-2, q99 + gain * 15e-1)) ELSE q99 END AS t99 FROM q7),
{_curve_sql()},
ended AS (SELECT *, CASE WHEN pts[-1].x >= 1 THEN pts WHEN 1 - pts[-1].x < 5e-2 THEN list_append(pts[:-2], {{'x': 1e0, 'y': 1e0}}) ELSE list_append(pts, {{'x': 1e0, 'y': 1e0}}) END AS done FROM w6),
mode AS (SELECT *, CASE WHEN q95 - q05 < 4e-2 THEN 'degenerate' WHEN NOT flat AND NOT raised THEN 'healthy' ELSE 'five zones' END AS tone_mode,
  (colorfulness >= 16e-2 AND chromatic_pixel_ratio >= 4e-1) OR (colorfulness >= 12e-2 AND chromatic_pixel_ratio >= 65e-2) AS narrative, colorfulness < 8e-2 AND chromatic_pixel_ratio < 2e-1 AS pale FROM ended),
plan AS MATERIALIZED (SELECT *, CASE WHEN tone_mode = 'five zones' THEN done ELSE [{{'x': 0e0, 'y': 0e0}}, {{'x': 1e0, 'y': 1e0}}] END AS points, neutral_sample_count / n >= 2e-2 AND cast_magnitude >= 6e-3 AND NOT narrative AS reliable,
  CASE WHEN pale THEN round(least(128e-2, greatest(1e0, greatest(colorfulness + 1e-2, colorfulness * 12e-1) / greatest(colorfulness, 2e-2))), 6) ELSE 1e0 END AS saturation FROM mode),
planned AS MATERIALIZED (SELECT *, CASE WHEN reliable THEN round(greatest(-6e-2, least(6e-2, -35e-1 * cast_b)), 6) ELSE 0e0 END AS temperature, CASE WHEN reliable THEN round(greatest(-25e-3, least(25e-3, -25e-1 * cast_a)), 6) ELSE 0e0 END AS tint FROM plan)"""


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foundation.with_plan(diagnosis.statistics(hazy(spark, sf_dir), parts=fixtures.frame_parts(spark, sf_dir)))


@query(f"WITH {HAZY}, {PLAN}, u AS (SELECT frame_id, unnest(points) AS p, generate_subscripts(points, 1) AS place FROM plan) SELECT frame_id, place::BIGINT AS place, {s6(x='p.x', y='p.y')} FROM u")
def foundation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the tone curve that each frame's own percentiles ask for."""
    rows = _plans(spark, sf_dir).select("frame_id", F.posexplode("points").alias("at", "p"))
    return rounded(rows.select("frame_id", (F.col("at") + 1).alias("place"), "p.x", "p.y"), "frame_id")


@query(f"""WITH {HAZY}, {PLAN} SELECT frame_id, tone_mode, CASE WHEN reliable THEN 'limited' WHEN narrative THEN 'narrative' ELSE 'unreliable' END AS neutral_mode, CASE WHEN pale THEN 'midtones' ELSE 'preserve' END AS colour_mode,
  {s6(temperature='temperature', tint='tint', saturation='saturation')}, array_to_string(list_filter([CASE WHEN tone_mode = 'five zones' THEN 'tone_span' END, CASE WHEN pale THEN 'colorfulness' END, CASE WHEN reliable THEN 'neutral_cast' END], lambda a: a IS NOT NULL), ', ') AS axes FROM planned""")
def foundation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral balance, recovery of colour, and the axes that a frame's foundation works on."""
    rows = _plans(spark, sf_dir)
    return rounded(rows.select("frame_id", "tone_mode", "neutral_mode", "colour_mode", "temperature", "tint", "saturation", F.array_join("axes", ", ").alias("axes")), "frame_id")


#: Values of each frame's curve at the 256 levels, from its points by windows over them.
TABLE = """pt AS (SELECT frame_id, k, p.x AS x, p.y AS y FROM (SELECT frame_id, unnest(points) AS p, generate_subscripts(points, 1) AS k FROM planned)),
sg AS (SELECT *, lead(x) OVER o - x AS sh, (lead(y) OVER o - y) / (lead(x) OVER o - x) AS sd, count(*) OVER (PARTITION BY frame_id) AS np FROM pt WINDOW o AS (PARTITION BY frame_id ORDER BY k)),
nb AS (SELECT *, lag(sh) OVER o AS hb, lag(sd) OVER o AS db, lag(sh, 2) OVER o AS hbb, lag(sd, 2) OVER o AS dbb, lead(sh) OVER o AS hn, lead(sd) OVER o AS dn FROM sg WINDOW o AS (PARTITION BY frame_id ORDER BY k)),
en AS (SELECT *, CASE WHEN k = 1 THEN ((2 * sh + hn) * sd - sh * dn) / (sh + hn) WHEN k = np THEN ((2 * hb + hbb) * db - hb * dbb) / (hb + hbb) END AS es, CASE WHEN k = 1 THEN sd ELSE db END AS e0, CASE WHEN k = 1 THEN dn ELSE dbb END AS e1 FROM nb),
sl AS (SELECT *, CASE WHEN np = 2 THEN coalesce(sd, db) WHEN k IN (1, np) THEN CASE WHEN es * e0 <= 0 THEN 0e0 WHEN e0 * e1 <= 0 AND abs(es) > 3 * abs(e0) THEN 3 * e0 ELSE es END
  WHEN db * sd > 0 THEN 3 * (hb + sh) / ((2 * sh + hb) / db + (sh + 2 * hb) / sd) ELSE 0e0 END AS m FROM en),
pc AS (SELECT *, lead(x) OVER o AS x1, lead(m) OVER o AS m1 FROM sl WINDOW o AS (PARTITION BY frame_id ORDER BY k)),
tb AS MATERIALIZED (SELECT frame_id, level, least(1e0, greatest(0e0, y + (v - x) * m + pow(v - x, 2) * (3 * sd - 2 * m - m1) / sh + pow(v - x, 3) * (m + m1 - 2 * sd) / (sh * sh))) AS v
  FROM pc, (SELECT level::INT AS level, level / 255e0 AS v FROM range(256) t(level)) WHERE x1 IS NOT NULL AND v <= x1 AND (v > x OR (k = 1 AND v >= x)))"""


@query(f"WITH {HAZY}, {PLAN}, {TABLE} SELECT frame_id, level::BIGINT AS level, {s6(v='v')} FROM tb")
def foundation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each frame's own monotone cubic curve, at all 256 levels."""
    rows = foundation.with_table(_plans(spark, sf_dir)).select("frame_id", F.posexplode("table").alias("level", "v"))
    return rounded(rows, "frame_id")


_W = colour.LUMINANCE["srgb"]
_GREY = sql.dot(_W, "r0", "g0", "b0")
_SMOOTH = lambda v, a, b: f"pow(({v} - {a}) / ({b} - {a}), 2) * (3 - 2 * ({v} - {a}) / ({b} - {a}))"
_BELL = f"CASE WHEN grey <= 12e-2 OR grey >= 76e-2 THEN 0e0 WHEN grey < 24e-2 THEN {_SMOOTH('grey', '12e-2', '24e-2')} WHEN grey <= 58e-2 THEN 1e0 ELSE 1 - ({_SMOOTH('grey', '58e-2', '76e-2')}) END"
_HIGH = f"CASE WHEN grey <= 68e-2 THEN 0e0 WHEN grey >= 84e-2 THEN 1e0 ELSE {_SMOOTH('grey', '68e-2', '84e-2')} END"
_CLAMP = lambda v: f"least(1e0, greatest(0e0, {v}))"


def _masked(source: str, out: str, mask: str, saturation: str) -> str:
    cs = ", ".join(f"{c}0 + ({_CLAMP(f'grey + ({c}0 - grey) * {saturation}')} - {c}0) * mask AS {c}0" for c in "rgb")
    return f"{out}_g AS (SELECT *, {_GREY} AS grey FROM {source}), {out}_m AS (SELECT *, {mask} AS mask FROM {out}_g), {out} AS (SELECT * EXCLUDE (r0, g0, b0, grey, mask), {cs} FROM {out}_m)"


APPLIED = f"""tl AS MATERIALIZED (SELECT frame_id, list(v ORDER BY level) AS vs FROM tb GROUP BY frame_id), l0 AS (SELECT px.frame_id, idx, px.x, px.y, px.h, temperature, tint, saturation, vs[px.r + 1] AS r0, vs[px.g + 1] AS g0, vs[px.b + 1] AS b0
  FROM px JOIN planned USING (frame_id) JOIN tl USING (frame_id)),
{_masked('l0', 'l1', f'CASE WHEN saturation > 1 THEN {_BELL} ELSE 0e0 END', 'saturation')},
l2 AS (SELECT * EXCLUDE (r0, g0, b0), {_CLAMP('r0 * round(1 + 6e-1 * temperature, 6)')} AS r0, {_CLAMP('g0 * round(1 - 35e-2 * tint, 6)')} AS g0, {_CLAMP('b0 * round(1 - 6e-1 * temperature, 6)')} AS b0 FROM l1),
{_masked('l2', 'l3', f'CASE WHEN saturation > 1 OR temperature <> 0 OR tint <> 0 THEN {_HIGH} ELSE 0e0 END', '72e-2')},
graded AS MATERIALIZED (SELECT frame_id, idx, x, y, h, {', '.join(f'CAST(round_even({c}0 * 255, 0) AS INT) AS {c}' for c in 'rgb')} FROM l3)"""


@query(f"WITH {HAZY}, {PLAN}, {TABLE}, {APPLIED} SELECT frame_id, {s6(mean_r='avg(r)', mean_g='avg(g)', mean_b='avg(b)')}, min(least(r, g, b))::BIGINT AS darkest, max(greatest(r, g, b))::BIGINT AS brightest FROM graded GROUP BY frame_id")
def foundation_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames after their own foundation."""
    out = foundation.applied(hazy(spark, sf_dir), _plans(spark, sf_dir))
    low, high = F.least(*[f"out_{c}" for c in "rgb"]), F.greatest(*[f"out_{c}" for c in "rgb"])
    return rounded(out.groupBy("frame_id").agg(*[F.avg(f"out_{c}").alias(f"mean_{c}") for c in "rgb"], F.min(low).alias("darkest"), F.max(high).alias("brightest")), "frame_id")


_LOW = "tone_span < 42e-2 AND tone_mode = 'five zones'"
READY = f"""{PLAN}, {TABLE}, {APPLIED}, stats1 AS MATERIALIZED (WITH px AS (SELECT * FROM graded), {_STATS} SELECT * FROM stats),
met AS (SELECT p.*, n.tone_span AS span1, n.colorfulness AS vivid1, n.local_contrast_region AS local1, n.cast_magnitude AS cast1 FROM planned p JOIN stats1 n USING (frame_id)),
lim AS (SELECT *, CASE WHEN {_LOW} THEN tone_span + greatest(3e-2, tone_span * 1e-1) ELSE tone_span * 9e-1 END AS least_span, CASE WHEN pale THEN colorfulness + greatest(1e-2, colorfulness * 2e-1) ELSE colorfulness * 9e-1 END AS least_vivid,
  local_contrast_region - greatest(2e-3, local_contrast_region * 1e-1) AS least_local, tone_mode = 'five zones' OR pale OR reliable AS asked FROM met),
lim2 AS (SELECT *, CASE WHEN pale THEN greatest(least_vivid + 15e-3, colorfulness * 15e-1) ELSE colorfulness * 115e-2 + 1e-2 END AS most_vivid FROM lim),
ready AS (SELECT *, CASE WHEN NOT asked THEN [] ELSE list_filter([CASE WHEN tone_mode = 'five zones' AND span1 < least_span THEN 'tone_span' END, CASE WHEN vivid1 < least_vivid OR vivid1 > most_vivid THEN 'colorfulness' END,
  CASE WHEN local1 < least_local THEN 'local_contrast' END, CASE WHEN cast1 > cast_magnitude + 2e-3 THEN 'neutral_cast' END], lambda f: f IS NOT NULL) END AS failures FROM lim2)"""


@query(f"""WITH {HAZY}, {READY} SELECT frame_id, CASE WHEN NOT asked THEN 'not required' WHEN len(failures) > 0 THEN 'blocked' ELSE 'passed' END AS status, array_to_string(failures, ', ') AS failures,
  {s6(least_span='least_span', least_vivid='least_vivid', most_vivid='most_vivid', least_local='least_local')} FROM ready""")
def foundation_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: four checks of a frame before and after its foundation."""
    plans = _plans(spark, sf_dir)
    graded = foundation.applied(hazy(spark, sf_dir), plans)
    after = diagnosis.statistics(graded.select("frame_id", "idx", "x", "y", "h", *[F.col(f"out_{c}").alias(c) for c in "rgb"]), parts=fixtures.frame_parts(spark, sf_dir))
    out = foundation.readiness(plans, after)
    return rounded(out.select("frame_id", "status", F.array_join("failures", ", ").alias("failures"), "least_span", "least_vivid", "most_vivid", "least_local"), "frame_id")


@query(f"""WITH {fixtures.SCENES_SQL}, v AS (SELECT frame_id, {sql.luma()} AS luma FROM px), p AS (SELECT frame_id, quantile_cont(luma, 0.75) AS p75, quantile_cont(luma, 0.95) AS p95 FROM v GROUP BY frame_id),
m AS (SELECT frame_id, round(greatest(0e0, least(94e-2, p75)), 6) AS start, round(greatest(greatest(0e0, least(94e-2, p75)) + 2e-2, least(99e-2, p95)), 6) AS full_at FROM p),
c AS (SELECT frame_id, round(avg(CASE WHEN luma > start THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM v JOIN m USING (frame_id) GROUP BY frame_id)
SELECT frame_id, CASE WHEN frame_id % 5 = 0 THEN 'coloured highlight' ELSE 'path to white' END AS mode, CASE WHEN frame_id % 5 <> 0 THEN start END AS mask_start, CASE WHEN frame_id % 5 <> 0 THEN full_at END AS mask_full, CASE WHEN frame_id % 5 <> 0 THEN coverage END AS coverage
FROM m JOIN c USING (frame_id)""")
def highlight_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each frame's highlights are protected, and how much of it the mask covers."""
    return foundation.highlight_policy(fixtures.scenes(spark, sf_dir), F.col("frame_id") % 5 == 0)
