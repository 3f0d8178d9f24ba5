"""Samples, neighbourhoods and polygons against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tintmill.operators import sampling


def cells(values, width, height, columns, rows):
    """Means by area in plain loops: {(x, y): mean}."""
    out = {}
    for cy in range(rows):
        for cx in range(columns):
            total = weight = 0.0
            for (x, y), v in values.items():
                wx = min(x + 1, (cx + 1) * width / columns) - max(x, cx * width / columns)
                wy = min(y + 1, (cy + 1) * height / rows) - max(y, cy * height / rows)
                if wx > 1e-9 and wy > 1e-9:
                    total, weight = total + v * wx * wy, weight + wx * wy
            out[cx, cy] = round(total / weight)
    return out


@pytest.mark.parametrize("size, to", [((7, 5), (3, 2)), ((6, 4), (3, 2)), ((3, 2), (5, 4)), ((5, 5), (5, 5)), ((1, 1), (4, 3))])
def test_cells_of_any_ratio(spark, size, to):
    draw = random.Random(str((size, to)))
    values = {(x, y): draw.randrange(256) for x in range(size[0]) for y in range(size[1])}
    px = spark.createDataFrame([(1, x, y, v, v, 255 - v) for (x, y), v in values.items()], "frame_id long, x int, y int, r int, g int, b int")
    got = sampling.grid(px, F.lit(size[0]), F.lit(size[1]), *to).collect()
    assert {(r.x, r.y): r.r for r in got} == cells(values, *size, *to)
    assert all(r.idx == r.y * to[0] + r.x for r in got) and sum(r.area for r in got) == pytest.approx(size[0] * size[1])


def test_frames_of_any_size_are_bounded(spark):
    sizes = [(4000, 3000), (100, 80), (100_000, 10), (10, 10), (1, 1)]
    df = spark.createDataFrame([(k, w, h) for k, (w, h) in enumerate(sizes)], "k long, w int, h int")
    got = {r.k: (r.a, r.b) for r in df.select("k", *[c.alias(n) for c, n in zip(sampling.sampled_size(F.col("w"), F.col("h"), *sampling.DIAGNOSED), "ab")]).collect()}
    assert got[0] == (171, 128) and got[1] == (100, 80) and got[2][1] == 24 and got[3] == (24, 24) and got[4] == (24, 24)


def test_plans_cover_all_of_a_clip(spark):
    clips = spark.createDataFrame([(1, "video", 60.0), (2, "video", 1800.0), (3, "video", 5400.0), (4, "photo", 9.0), (5, "video", 0.0), (6, "video", None), (7, "video", 0.1)], "clip_id long, media string, duration double")
    got = {r.clip_id: r for r in sampling.sampling_plan(clips).collect()}
    assert [got[k].frames for k in range(1, 8)] == [10, 68, 90, 1, 1, 1, 8] and all(got[k].coverage == 1.0 for k in range(1, 7)) and got[7].fps == 30.0
    times = sampling.sampled_times(sampling.sampling_plan(clips)).collect()
    assert len(times) == 10 + 68 + 90 + 1 + 1 + 1 + 8 and max(t.seconds for t in times if t.clip_id == 1) == 54.0


@pytest.mark.parametrize("width, height", [(9, 7), (120, 61), (3, 1)])
def test_neighbourhoods_are_cut_at_edges(spark, width, height):
    import math
    import statistics

    draw = random.Random(width)
    lum = {(x, y): draw.random() for x in range(width) for y in range(height)}
    radius = max(2, round(min(width, height) * 0.05))
    anchors = {p for p in lum if draw.random() < 0.05} | {(0, 0), (width - 1, height - 1)}
    stops = []
    for x, y in anchors:
        near = [lum[a, b] for a in range(max(0, x - radius), min(width, x + radius + 1)) for b in range(max(0, y - radius), min(height, y + radius + 1))]
        stops.append(math.log2(lum[x, y] / (sum(near) / len(near))))
    px = spark.createDataFrame([(1, x, y, v, (x, y) in anchors) for (x, y), v in lum.items()], "frame_id long, x int, y int, lum double, chosen boolean")
    row = sampling.neighbourhood_ev(px, F.lit(width), F.lit(height), F.col("chosen")).first()
    assert row.anchors == len(anchors) and row.ev == pytest.approx(statistics.median(stops), abs=1e-9)


def test_no_anchor_no_ev(spark):
    px = spark.createDataFrame([(1, 0, 0, 0.5)], "frame_id long, x int, y int, lum double")
    assert tuple(sampling.neighbourhood_ev(px, F.lit(1), F.lit(1), F.lit(False)).first()) == (1, 0, None)


def rasterised(points, width, height):
    """Even-odd scan lines with edges inside."""
    out = set()
    for y in range(height):
        for x in range(width):
            odd = on = False
            for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
                if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                    on = True
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    odd = not odd
            if on or odd:
                out.add((x, y))
    return out


SHAPES = [[(1, 1), (8, 1), (8, 6), (1, 6)], [(0, 0), (9, 0), (0, 9)], [(1, 1), (8, 7), (8, 1), (1, 7)], [(4, 0), (9, 4), (4, 9), (0, 4)], [(1, 1), (8, 1), (8, 8), (5, 3), (1, 8)], [(2, 2), (7, 7)], [(3, 3), (3, 3), (3, 3)], [(1, 5), (5, 5), (9, 5), (9, 8), (1, 8)]]


def test_polygons(spark):
    rows = [(k, [(float(x), float(y)) for x, y in s]) for k, s in enumerate(SHAPES)]
    df = spark.createDataFrame(rows, "k long, points array<struct<x: double, y: double>>").crossJoin(spark.range(100).select((F.col("id") % 10).alias("x"), F.expr("id div 10").alias("y")))
    got = {}
    for r in df.filter(sampling.inside(F.col("x"), F.col("y"), F.col("points"))).collect():
        got.setdefault(r.k, set()).add((r.x, r.y))
    for k, s in enumerate(SHAPES):
        assert got.get(k, set()) == (rasterised(s, 10, 10) if len(s) > 2 else set()), s


def test_keyframes(spark):
    frames = spark.createDataFrame([(1, k) for k in range(9)] + [(2, 0)], "clip_id long, frame_no long")
    square = lambda d: [(d, 0.0), (d + 4, 0.0), (d + 4, 4.0)]
    keys = spark.createDataFrame([(1, 2, square(0.0)), (1, 6, square(8.0)), (1, 7, [*square(8.0), (8.0, 4.0)])], "clip_id long, frame_no long, points array<struct<x: double, y: double>>")
    got = {(r.clip_id, r.frame_no): r.points and r.points[0].x for r in sampling.between_keyframes(frames, keys).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 2, (1, 4): 4, (1, 5): 6, (1, 6): 8, (1, 7): 8, (1, 8): 8, (2, 0): None}


def test_an_edge_is_worked_out_once(spark):
    """The polygon's points are read for its edges, not anew in each use of them."""
    df = spark.createDataFrame([(1.0, 1.0, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])], "x double, y double, points array<struct<x: double, y: double>>")
    out = df.select(sampling.inside(F.col("x"), F.col("y"), F.col("points")).alias("inside"))
    assert out.first().inside
    assert out._jdf.queryExecution().analyzed().toString().count("points") < 30
