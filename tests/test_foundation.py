"""The foundation's curve, table, picture and gates on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from tintmill.functions import colour
from tintmill.operators import foundation

STATS = {
    "frame_id": 1, "p01": 0.08, "p05": 0.10, "p50": 0.18, "p95": 0.34, "p99": 0.36, "tone_span": 0.24, "colorfulness": 0.05, "chromatic_pixel_ratio": 0.1, "neutral_sample_count": 500, "n": 1000,
    "cast_a": 0.004, "cast_b": 0.02, "cast_magnitude": 0.0204, "local_contrast_region": 0.03,
}


def planned(spark, **changed):
    return foundation.with_plan(spark.createDataFrame([(STATS | changed)])).first()


def test_haze_is_drawn_apart(spark):
    p = planned(spark)
    assert p.tone_mode == "five zones" and p.axes == ["tone_span", "colorfulness", "neutral_cast"]
    xs, ys = [q.x for q in p.points], [q.y for q in p.points]
    assert xs[0] == ys[0] == 0 and xs[-1] == ys[-1] == 1
    for (a, b), (c, d) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        assert c - a >= 0.05 - 1e-9 and 0.15 - 1e-6 <= (d - b) / (c - a) <= 4 + 1e-6
    assert ys[1] < xs[1] and ys[-3] > xs[-3]  # black comes down, light goes up
    assert (p.temperature, p.tint, p.saturation) == (-0.06, -0.01, 1.2)


@pytest.mark.parametrize("changed, mode", [({"p01": 0.001, "tone_span": 0.6, "p95": 0.7, "p99": 0.8}, "healthy"), ({"p95": 0.12, "p99": 0.13, "p50": 0.11}, "degenerate"), ({"p01": 0.001, "p05": 0.005, "p50": 0.01, "p95": 0.5, "p99": 0.6, "tone_span": 0.495}, "healthy")])
def test_what_is_sound_stays(spark, changed, mode):
    p = planned(spark, **changed)
    assert p.tone_mode == mode and [(q.x, q.y) for q in p.points] == [(0, 0), (1, 1)]


def test_narrative_colour_and_thin_evidence_are_kept(spark):
    assert planned(spark, colorfulness=0.2, chromatic_pixel_ratio=0.5).neutral_mode == "narrative"
    p = planned(spark, neutral_sample_count=10)
    assert p.neutral_mode == "unreliable" and p.temperature == p.tint == 0
    assert planned(spark, colorfulness=0.0).saturation == 1.0 and planned(spark, colorfulness=0.01).saturation == 1.0 and planned(spark, colorfulness=0.02).saturation == 1.28


@pytest.mark.parametrize("points", [[(0, 0), (1, 1)], [(0, 0), (0.3, 0.2), (1, 1)], [(0, 0), (0.2, 0.1), (0.5, 0.6), (0.55, 0.61), (0.9, 0.92), (1, 1)], [(0, 0.0), (0.4, 0.4), (0.6, 0.4), (1, 1)], [(0, 0), (0.1, 0.4), (0.2, 0.41), (1, 1)]])
def test_a_row_of_points_gives_the_curve_of_literal_points(spark, points):
    points = [(float(x), float(y)) for x, y in points]
    df = spark.createDataFrame([(points,)], f"points {foundation.POINT}")
    got = df.select(foundation.curve_table(F.col("points"))).first()[0]
    want = [r[0] for r in spark.range(256).orderBy("id").select(colour.curve(F.col("id") / 255.0, points)).collect()]
    assert len(got) == 256 and max(abs(a - b) for a, b in zip(got, want)) < 1e-12


def test_grey_stays_grey_and_highlights_lose_colour(spark):
    plan = foundation.with_plan(spark.createDataFrame([STATS | {"neutral_sample_count": 0}]))
    px = spark.createDataFrame([(1, k, r, g, b) for k, (r, g, b) in enumerate([(0, 0, 0), (128, 128, 128), (255, 255, 255), (120, 100, 90), (250, 240, 180)])], "frame_id long, idx long, r int, g int, b int")
    out = [(r.out_r, r.out_g, r.out_b) for r in foundation.applied(px, plan).orderBy("idx").collect()]
    assert out[0] == (0, 0, 0) and out[2] == (255, 255, 255) and len(set(out[1])) == 1
    assert out[3][0] - out[3][2] > 30 and out[4][0] - out[4][2] < 70


def test_gates(spark):
    before = foundation.with_plan(spark.createDataFrame([STATS | {"frame_id": k} for k in range(6)] + [STATS | {"frame_id": 6, "p01": 0.001, "tone_span": 0.6, "p95": 0.7, "p99": 0.8, "colorfulness": 0.1, "neutral_sample_count": 0}]))
    good = {"tone_span": 0.28, "colorfulness": 0.065, "local_contrast_region": 0.03, "cast_magnitude": 0.02}
    changes = [{}, {"tone_span": 0.26}, {"colorfulness": 0.055}, {"colorfulness": 0.08}, {"local_contrast_region": 0.026}, {"cast_magnitude": 0.023}, {"tone_span": 0.1}]
    after = spark.createDataFrame([good | c | {"frame_id": k} for k, c in enumerate(changes)])
    got = {r.frame_id: (r.status, r.failures) for r in foundation.readiness(before, after).collect()}
    assert got == {0: ("passed", []), 1: ("blocked", ["tone_span"]), 2: ("blocked", ["colorfulness"]), 3: ("blocked", ["colorfulness"]), 4: ("blocked", ["local_contrast"]), 5: ("blocked", ["neutral_cast"]), 6: ("not required", [])}


def test_highlights(spark):
    px = spark.createDataFrame([(f, k, v, v, v) for f in (1, 2) for k, v in enumerate([10] * 8 + [200, 250])], "frame_id long, idx long, r int, g int, b int")
    got = {r.frame_id: r for r in foundation.highlight_policy(px, F.col("frame_id") == 2).collect()}
    assert got[1].mode == "path to white" and got[1].mask_start == pytest.approx(10 / 255, abs=1e-6) and got[1].mask_full > got[1].mask_start and got[1].coverage == 0.2
    assert got[2].mode == "coloured highlight" and got[2].mask_start is None
