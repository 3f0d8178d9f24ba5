"""Responses, models and verdicts of hand-made charts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tintmill.operators import calibration

PATCH = "chart long, id long, grp string, r int, g int, b int, mr int, mg int, mb int"


def test_a_response_never_falls(spark):
    greys = [(1, k, "grayscale", v, v, v, m, m, m) for k, (v, m) in enumerate([(0, 5), (60, 80), (120, 70), (180, 190), (255, 250), (60, 60)])]
    few = [(2, k, "grayscale", v, v, v, v, v, v) for k, v in enumerate((0, 80, 160, 255))] + [(2, 9, "scene", 1, 2, 3, 1, 2, 3)]
    got = {r.chart: r.response for r in calibration.grey_response(spark.createDataFrame(greys + few, PATCH)).collect()}
    assert got[2] is None and [(round(p.x * 255), round(p.y * 255)) for p in got[1]] == [(0, 5), (60, 60), (60, 80), (120, 80), (180, 190), (255, 250)]


def test_tone_between_and_beyond_points(spark):
    points = [(0.1, 0.2), (0.3, 0.4), (0.3, 0.6), (0.9, 0.8)]
    wanted = {0.0: 0.2, 0.1: 0.2, 0.2: 0.3, 0.3: 0.4, 0.6: 0.7, 0.9: 0.8, 1.0: 0.8}
    df = spark.createDataFrame([(v, points) for v in wanted], "v double, p array<struct<x: double, y: double>>")
    for r in df.select("v", calibration.toned(F.col("v"), F.col("p")).alias("t")).collect():
        assert r.t == pytest.approx(wanted[r.v])


def test_tone_of_long_responses(spark):
    """The first point that reaches a value, as a plain search finds it, among many with equal x."""
    draw = random.Random(5)
    xs = sorted(round(draw.randrange(20, 236) / 255, 6) for _ in range(700))
    points = list(zip(xs, sorted(draw.random() for _ in xs)))

    def plain(v):
        if v <= xs[0] or v >= xs[-1]:
            return points[0][1] if v <= xs[0] else points[-1][1]
        at = next(k for k in range(1, len(xs)) if v <= xs[k])
        (x0, y0), (x1, y1) = points[at - 1], points[at]
        return y0 + (y1 - y0) * ((v - x0) / (x1 - x0) if x1 > x0 else 0.0)

    df = spark.createDataFrame([(k, points[:n]) for k in range(256) for n in (1, 2, 3, 700)], "k int, p array<struct<x: double, y: double>>")
    got = df.select("k", F.size("p").alias("n"), calibration.toned(F.col("k") / 255.0, F.col("p")).alias("t"), F.get(calibration.tone_table(F.col("p")), F.col("k")).alias("u")).collect()
    assert all(r.t == r.u == plain(r.k / 255) for r in got if r.n == 700) and all(r.t == r.u is not None for r in got)


def test_a_response_is_worked_out_once_a_chart(spark):
    """Pixels look their tone up; before, each searched its chart's whole response, by three channels."""
    rows = spark.createDataFrame(chart(1, 40, 0), PATCH)
    out = calibration.with_tone(rows, calibration.grey_response(rows))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan[:plan.index("Join")] and "lambda" in plan
    whole = {r.id: (r.tr, r.tg, r.tb) for r in out.collect()}
    parts = rows.select("chart", "id", "grp", *[F.col(c).cast("double").alias(c) for c in "rgb"], "mr", "mg", "mb")
    assert {r.id: (r.tr, r.tg, r.tb) for r in calibration.with_tone(parts, calibration.grey_response(parts)).collect()} == whole


def chart(number, size, twist, seed=1):
    draw, rows = random.Random(seed), []
    for k in range(size):
        r, g, b = (draw.randrange(256) for _ in range(3))
        if k % 4 == 0:
            g = b = r
        measured = [0.9 * r + 0.05 * math.sqrt(r * g), 0.95 * g, 0.85 * b + 0.1 * math.sqrt(g * b)]
        measured = [max(0, min(255, round(v) + (twist * draw.choice((-1, 1)) if k % 4 else 0))) for v in measured]
        rows.append((number, k, ("grayscale", "color-steps", "skin", "scene")[k % 4], r, g, b, *measured))
    return rows


def test_coefficients_are_found_again(spark):
    rows = spark.createDataFrame(chart(1, 400, 0) + chart(2, 7, 0), PATCH)
    learned = rows.select("chart", *[(F.col(c) / 255.0).alias(f"t{c}") for c in "rgb"], *[(F.col(f"m{c}") / 255.0).alias(f"y{c}") for c in "rgb"])
    got = {r.chart: r for r in calibration.root_polynomial(learned).collect()}
    want = {"c00": 0.9, "c03": 0.05, "c11": 0.95, "c22": 0.85, "c24": 0.1}
    for k in range(3):
        for i in range(6):
            assert got[1][f"c{k}{i}"] == pytest.approx(want.get(f"c{k}{i}", 0.0), abs=0.02)
    assert got[2].samples == 7 and got[2].c00 is None


def test_verdicts(spark):
    """A model that fits is calibrated; one that few patches break is provisional; one that most break is heuristic."""
    rows = []
    for number, wrong in ((1, 0), (2, 3), (3, 40)):
        for k in range(40):
            v = 40 + 5 * k
            off = 60 if k < wrong else 0
            rows.append((number, k, ("grayscale", "color-steps", "skin", "scene")[k % 4], v, v, v, v, v, v, v, max(0, v - off), v))
    df = spark.createDataFrame(rows, PATCH + ", pr int, pg int, pb int")
    got = {r.chart: r for r in calibration.verdicts(calibration.compared(df)).collect()}
    assert got[1].status == "calibrated" and got[1].failed == [] and got[1].median == 0
    assert got[2].status == "calibrated-provisional" and "p95" in got[2].failed and got[2].weak == []
    assert got[3].status == "heuristic" and got[3].failed[0] == "median" and len(got[3].weak) == 4


def test_no_grey_and_no_skin(spark):
    df = spark.createDataFrame([(1, 0, "scene", 9, 9, 9, 9, 9, 9, 9, 9, 9)], PATCH + ", pr int, pg int, pb int")
    r = calibration.verdicts(calibration.compared(df)).first()
    assert (r.status, r.grey_rmse, r.skin) == ("calibrated", 0.0, None)
