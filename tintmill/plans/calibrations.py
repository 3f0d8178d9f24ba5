"""Queries over calibration charts: every frame is one, its pixels are the patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.operators import calibration
from tintmill.plans import sql
from tintmill.plans.frames import _DE, rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures

GROUPS = ("grayscale", "color-steps", "skin", "scene")
T = calibration.TERMS


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart, id, grp, r, g, b, and what an editor made of them: a softer tone, mixed channels, a root term, and on some
    charts a disturbance that no such model can follow."""
    px = fixtures.pixels(spark, sf_dir)
    grp = F.element_at(F.array(*[F.lit(g) for g in GROUPS]), (F.col("idx") % 4 + 1).cast("int"))
    px = px.select(F.col("frame_id").alias("chart"), F.col("idx").alias("id"), grp.alias("grp"), "r", *[F.when(F.col("idx") % 4 == 0, F.col("r")).otherwise(F.col(c)).alias(c) for c in "gb"])
    px = px.withColumns({f"s{c}": F.pow(F.col(c) / 255.0, 0.9) * 0.94 + 0.02 for c in "rgb"})
    root = F.sqrt(F.col("sr") * F.col("sg")) * 0.05
    mixed = {"mr": F.col("sr") * 0.93 + F.col("sg") * 0.02 + root, "mg": F.col("sr") * 0.02 + F.col("sg") * 0.95 + F.col("sb") * 0.03, "mb": F.col("sg") * 0.05 + F.col("sb") * 0.90 + root}
    odd = F.when((F.col("chart") % 3 == 0) & (F.col("id") % 2 == 1), (F.col("id") * 37 % 61 - 30) * (F.col("chart") % 4 + 1)).otherwise(0)
    held = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), v)).cast("int")
    return px.select("chart", "id", "grp", "r", "g", "b", held(F.rint(mixed["mr"] * 255) + odd).alias("mr"), held(F.rint(mixed["mg"] * 255)).alias("mg"), held(F.rint(mixed["mb"] * 255) - odd).alias("mb"))


_HELD = lambda v: f"CAST(least(255e0, greatest(0e0, {v})) AS INT)"
_ROUND = lambda v: f"round_even(({v}) * 255, 0)"
PATCHES = f"""{fixtures.PIXELS_SQL}, pa AS (SELECT frame_id AS chart, idx AS id, ({list(GROUPS)})[CAST(idx % 4 + 1 AS INT)] AS grp, r, CASE WHEN idx % 4 = 0 THEN r ELSE g END AS g, CASE WHEN idx % 4 = 0 THEN r ELSE b END AS b FROM px),
ps AS (SELECT *, {', '.join(f'pow({c} / 255e0, 9e-1) * 94e-2 + 2e-2 AS s{c}' for c in 'rgb')}, CASE WHEN chart % 3 = 0 AND id % 2 = 1 THEN (id * 37 % 61 - 30) * (chart % 4 + 1) ELSE 0 END AS odd FROM pa),
pat AS (SELECT chart, id, grp, r, g, b, {_HELD(_ROUND('sr * 93e-2 + sg * 2e-2 + sqrt(sr * sg) * 5e-2') + ' + odd')} AS mr, {_HELD(_ROUND('sr * 2e-2 + sg * 95e-2 + sb * 3e-2'))} AS mg,
  {_HELD(_ROUND('sg * 5e-2 + sb * 9e-1 + sqrt(sr * sg) * 5e-2') + ' - odd')} AS mb FROM ps),
gp AS (SELECT chart, round(x, 6) AS x, round(max(y) OVER (PARTITION BY chart ORDER BY x, y ROWS UNBOUNDED PRECEDING), 6) AS y, row_number() OVER (PARTITION BY chart ORDER BY x, y) AS k
  FROM (SELECT chart, id, r / 255e0 AS x, (mr + mg + mb) / 3e0 / 255 AS y FROM pat WHERE grp = 'grayscale'))"""


@query(f"WITH {PATCHES} SELECT chart, k::BIGINT AS place, {s6(x='x', y='y')} FROM gp")
def cal_grey_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: grey patches in order, what was measured never falling."""
    rows = calibration.grey_response(patches(spark, sf_dir)).select("chart", F.posexplode("response").alias("at", "p"))
    return rounded(rows.select("chart", (F.col("at") + 1).alias("place"), "p.x", "p.y"), "chart")


def _toned(c: str) -> str:
    at = f"list_filter(range(2, len(xs) + 1), lambda i: {c} / 255e0 <= xs[i])[1]"
    return f"""CASE WHEN {c} / 255e0 <= xs[1] THEN ys[1] WHEN {c} / 255e0 >= xs[-1] THEN ys[-1]
  ELSE ys[{at} - 1] + (ys[{at}] - ys[{at} - 1]) * CASE WHEN xs[{at}] > xs[{at} - 1] THEN ({c} / 255e0 - xs[{at} - 1]) / (xs[{at}] - xs[{at} - 1]) ELSE 0e0 END END"""


def _terms(p: str) -> list[str]:
    r, g, b = (f"{p}{c}" for c in "rgb")
    return [r, g, b, f"sqrt(greatest(0e0, {r} * {g}))", f"sqrt(greatest(0e0, {g} * {b}))", f"sqrt(greatest(0e0, {r} * {b}))"]


def _elimination() -> str:
    """Gauss and Jordan's elimination, a column a step, beside the sums as they are."""
    sums = [f"sum(t{i} * t{j}) + {1e-7 if i == j else 0e0!r} AS m{i}_{j}" for i in range(T) for j in range(T)] + [f"sum(t{i} * y{k}) AS m{i}_{T + k}" for i in range(T) for k in range(3)]
    out = [f"ge0 AS (SELECT chart, count(*) AS samples, {', '.join(sums)} FROM tt GROUP BY chart)"]
    for p in range(T):
        cells = []
        for i in range(T):
            for j in range(T + 3):
                unit = f"m{p}_{j} / m{p}_{p}"
                cells.append(f"{unit if i == p else f'm{i}_{j} - m{i}_{p} * {unit}'} AS m{i}_{j}")
        out.append(f"ge{p + 1} AS (SELECT chart, samples, {', '.join(cells)} FROM ge{p})")
    return ", ".join(out)


MODELS = f"""{PATCHES}, gl AS (SELECT chart, list(x ORDER BY k) AS xs, list(y ORDER BY k) AS ys FROM gp GROUP BY chart),
tn AS MATERIALIZED (SELECT pat.*, {', '.join(f'{_toned(c)} AS t{c}' for c in 'rgb')} FROM pat JOIN gl USING (chart)),
tt AS (SELECT chart, {', '.join(f'{t} AS t{k}' for k, t in enumerate(_terms('t')))}, mr / 255e0 AS y0, mg / 255e0 AS y1, mb / 255e0 AS y2 FROM tn WHERE id % 5 <> 0), {_elimination()}"""
_C = {f"c{k}{i}": f"m{i}_{T + k}" for k in range(3) for i in range(T)}


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = patches(spark, sf_dir)
    toned = calibration.with_tone(rows, calibration.grey_response(rows))
    learned = toned.filter("id % 5 != 0").select("chart", "tr", "tg", "tb", *[(F.col(f"m{c}") / 255.0).alias(f"y{c}") for c in "rgb"])
    return toned, calibration.root_polynomial(learned)


@query(f"WITH {MODELS} SELECT chart, samples, {', '.join(f'round({m}, 4) + 0e0 AS {c}' for c, m in _C.items())} FROM ge{T}")
def cal_root_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: a colour model of six terms that scale with exposure, by Cholesky in columns; the SQL eliminates."""
    models = _models(spark, sf_dir)[1]
    return models.select("chart", "samples", *[(F.round(c, 4) + 0.0).alias(c) for c in _C])


_EIGHT = lambda v: f"(least(255e0, greatest(0e0, {_ROUND(v)})) / 255)"
_TAIL = _DE[_DE.index("f AS MATERIALIZED (SELECT l1"):]
HOLDOUT = f"""{MODELS}, co AS (SELECT chart, {', '.join(f'round({m}, 8) AS {c}' for c, m in _C.items())} FROM ge{T}), ev AS (SELECT *, {', '.join(f"{_EIGHT('t' + c)} AS e{c}" for c in 'rgb')} FROM tn WHERE id % 5 = 0),
pr AS (SELECT ev.*, {', '.join(f"{_HELD(_ROUND(' + '.join(f'c{k}{i} * {t}' for i, t in enumerate(_terms('e')))))} AS p{c}" for k, c in enumerate('rgb'))} FROM ev JOIN co USING (chart)),
q1 AS (SELECT chart AS frame_id, id AS idx, mr AS r, mg AS g, mb AS b FROM pr), q2 AS (SELECT chart AS frame_id, id AS idx, pr AS r, pg AS g, pb AS b FROM pr), {sql.linear('q1', 'l1')}, {sql.linear('q2', 'l2')}, {_TAIL}"""


# The differences of two pictures, as `ciede2000_pairs` has them, with each pixel's number.
HOLD = HOLDOUT.replace("(SELECT l1.frame_id, l1.idx, ", "(SELECT l1.frame_id, l1.idx AS idx, ").replace("t AS (SELECT frame_id, ", "t AS (SELECT frame_id, idx, ")
_GAP = f"abs(({sql.hue('pa', 'pb')}) - ({sql.hue('sa', 'sb')}))"
_MEASURED = f"""er AS (SELECT d5.frame_id AS chart, d5.idx AS id, de, CASE WHEN sqrt(pa * pa + pb * pb) < 15 OR sqrt(sa * sa + sb * sb) < 15 THEN 0e0 ELSE least({_GAP}, 360 - {_GAP}) END AS hue FROM d5),
al AS (SELECT pr.*, de, hue, pow((mr + mg + mb - pr.pr - pg - pb) / 3e0 / 255, 2) AS gap FROM pr JOIN er USING (chart, id)),
gm AS (SELECT chart, grp, quantile_cont(de, 0.5) AS own FROM al GROUP BY chart, grp), wk AS (SELECT chart, array_to_string(list(grp ORDER BY grp) FILTER (WHERE own > 3), ', ') AS weak FROM gm GROUP BY chart),
sm AS (SELECT chart, count(*) AS held_out, quantile_cont(de, 0.5) AS median, list_sort(list(de))[least(count(*), CAST(floor(count(*) * 95e-2) AS INT) + 1)] AS p95, sqrt(avg(gap) FILTER (WHERE grp = 'grayscale')) AS grey_rmse, max(hue) AS hue_max,
  quantile_cont(de, 0.5) FILTER (WHERE grp = 'skin') AS skin FROM al GROUP BY chart),
vd AS (SELECT *, list_filter([CASE WHEN median > 3 THEN 'median' END, CASE WHEN p95 > 6 THEN 'p95' END, CASE WHEN grey_rmse > 2e-2 THEN 'grey' END, CASE WHEN hue_max > 4 THEN 'hue' END, CASE WHEN skin > 2 THEN 'skin' END], lambda f: f IS NOT NULL) AS failed FROM sm JOIN wk USING (chart))"""


@query(f"""WITH {HOLD}, {_MEASURED} SELECT chart, held_out, {s6(median='median', p95='p95', grey_rmse='grey_rmse', hue_max='hue_max', skin='skin')}, coalesce(weak, '') AS weak, array_to_string(failed, ', ') AS failed,
  CASE WHEN median > 3 THEN 'heuristic' WHEN len(failed) = 0 THEN 'calibrated' ELSE 'calibrated-provisional' END AS status FROM vd""")
def cal_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 K6: patches that were not learned from, predicted through tone and colour, and the verdict on each chart."""
    toned, models = _models(spark, sf_dir)
    out = calibration.verdicts(calibration.compared(calibration.predicted(toned.filter("id % 5 = 0"), models)))
    text = lambda c: F.array_join(c, ", ").alias(c)
    return rounded(out.select("chart", "held_out", "median", "p95", "grey_rmse", "hue_max", "skin", text("weak"), text("failed"), "status"), "chart")
