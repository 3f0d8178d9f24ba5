"""Queries over tables of a grade: apply, precision, thresholds from one part of the frames held against the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.functions import colour
from tintmill.operators import grade, lut
from tintmill.plans import sql
from tintmill.plans.frames import rounded, s6
from tintmill.plans.calibrations import _TAIL
from tintmill.plans.regions import LOOK, _chain
from tintmill.plans.registry import query
from tintmill.sources import fixtures


def measured(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Pixels with the grade itself (out_) and its table's answer (lut_)."""
    table = lut.cells(lut.baked(lut.lattice(spark, size), lambda df: grade.with_grade(df, LOOK, 1.0, unrounded=True)), size)
    px = fixtures.scenes(spark, sf_dir).select("frame_id", "idx", "r", "g", "b")
    return lut.applied(grade.with_grade(px, LOOK, 1.0), table, size)


def _applied_sql(size: int) -> str:
    """Eight look-ups by the corners' own numbers, weighted."""
    n = size - 1
    weigh = lambda c, on: f"(p{c} - c{c})" if on else f"(1 - (p{c} - c{c}))"
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    spot = ", ".join(f"{c} / 255e0 * {n} AS p{c}, least({n - 1}, CAST(floor({c} / 255e0 * {n}) AS INT)) AS c{c}" for c in "rgb")
    rows = " UNION ALL ".join(
        f"SELECT frame_id, idx, {weigh('r', i)} * {weigh('g', j)} * {weigh('b', k)} AS wt, (cr + {i}) + (cg + {j}) * {size} + (cb + {k}) * {size * size} AS id FROM spot" for i, j, k in corners
    )
    cube = f"cube AS (SELECT id, (id % {size}) / {n}e0 * 255 AS r, (id // {size} % {size}) / {n}e0 * 255 AS g, (id // {size * size}) / {n}e0 * 255 AS b FROM range({size**3}) t(id))"
    lat = _chain(LOOK, 1.0, "cube")
    for name in ("k0", "k1", "k2", "k3", "k4", "k5", "k6", "graded"):
        lat = lat.replace(f"{name} AS (", f"lat_{name} AS (").replace(f"FROM {name})", f"FROM lat_{name})")
    vals = ", ".join(f"round_even(greatest(0e0, least(1e0, {c}0)) * 255, 0) / 255 AS v{c}" for c in "rgb")
    return f"""{cube}, {lat}, vals AS MATERIALIZED (SELECT id, {vals} FROM lat_k6), spot AS (SELECT frame_id, idx, r, g, b, {spot} FROM px), eight AS ({rows}),
got AS MATERIALIZED (SELECT frame_id, idx, {', '.join(f'CAST(round_even(sum(wt * v{c}) * 255, 0) AS INT) AS {c}' for c in 'rgb')} FROM eight JOIN vals USING (id) GROUP BY frame_id, idx)"""


def _apply_sql(size: int) -> str:
    return f"""WITH {fixtures.SCENES_SQL}, {_applied_sql(size)}, {_chain(LOOK, 1.0)}
SELECT g.frame_id, g.idx::BIGINT AS idx, got.r::BIGINT AS lut_r, got.g::BIGINT AS lut_g, got.b::BIGINT AS lut_b, out_r, out_g, out_b FROM graded g JOIN got USING (frame_id, idx)"""


@query(_apply_sql(17))
def lut_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel through a table of 17 steps, beside the grade that the table was made of."""
    out = measured(spark, sf_dir, 17)
    return rounded(out.select("frame_id", F.col("idx").cast("long"), *[f"{p}_{c}" for p in ("lut", "out") for c in "rgb"]), "frame_id")


def _precision_sql(size: int) -> str:
    return f"""{fixtures.SCENES_SQL}, {_applied_sql(size)}, {_chain(LOOK, 1.0)}, dir AS MATERIALIZED (SELECT frame_id, idx, out_r AS r, out_g AS g, out_b AS b FROM graded),
{sql.linear('dir', 'l1')}, {sql.linear('got', 'l2')}, {_TAIL}, pz AS (SELECT frame_id, count(*) AS pixels, quantile_cont(de, 0.5) AS median, list_sort(list(de)) AS v FROM d5 GROUP BY frame_id),
pm AS (SELECT frame_id, pixels, median, v[CAST(round_even((len(v) - 1) * 95e-2, 0) AS INT) + 1] AS p95 FROM pz)"""


def _differences(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    rows = measured(spark, sf_dir, size)
    rows = colour.with_lab(colour.with_lab(rows, "out_r", "out_g", "out_b", out="a_"), "lut_r", "lut_g", "lut_b", out="b_")
    return colour.with_ciede2000(rows.select("frame_id", *[c for c in rows.columns if c[:2] in ("a_", "b_")]), "a_", "b_")


@query(f"WITH {_precision_sql(17)} SELECT frame_id, pixels, {s6(median='median', p95='p95')} FROM pm")
def lut_precision_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: how far a table of 17 steps lies from its grade, frame by frame."""
    return rounded(lut.precision(_differences(spark, sf_dir, 17)), "frame_id")


@query(f"WITH {_precision_sql(33)} SELECT frame_id, pixels, {s6(median='median', p95='p95')} FROM pm")
def lut_precision_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the same with 33 steps."""
    return rounded(lut.precision(_differences(spark, sf_dir, 33)), "frame_id")


LEARN, HOLD = 28, 12
_FIRST = f"""mk AS (SELECT *, row_number() OVER (ORDER BY sha256(frame_id::VARCHAR)) AS n FROM pm),
th AS (SELECT round(list_sort(list(median))[CAST(round_even((count(*) - 1) * 95e-2, 0) AS INT) + 1], 4) AS most_median, round(list_sort(list(p95))[CAST(round_even((count(*) - 1) * 95e-2, 0) AS INT) + 1], 4) AS most_p95 FROM mk WHERE n <= {LEARN}),
hd AS (SELECT count(*) AS held_out, count(*) FILTER (WHERE median <= most_median AND p95 <= most_p95) AS passed FROM mk, th WHERE n > {LEARN} AND n <= {LEARN + HOLD})"""


@query(f"""WITH {_precision_sql(17)}, {_FIRST} SELECT most_median + 0e0 AS most_median, most_p95 + 0e0 AS most_p95, passed, held_out,
  CASE WHEN (SELECT count(*) FROM pm) < {LEARN + HOLD} THEN 'too few' WHEN passed = {HOLD} THEN 'passed' ELSE 'not met' END AS status FROM th, hd""")
def lut_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: thresholds from the first 28 frames by their hash, held against the next 12."""
    out = lut.split_verdict(lut.precision(_differences(spark, sf_dir, 17)), "frame_id", LEARN, HOLD)
    return out.select((F.col("most_median") + 0.0).alias("most_median"), (F.col("most_p95") + 0.0).alias("most_p95"), "passed", "held_out", "status")
