"""Requests, policies, one-to-one matches and clips against plain Python on small fixtures."""

import random

from pyspark.sql import functions as F

from tintmill.operators import coverage, fields, matching, records, sequence


def test_hits_either_way_and_empty(spark):
    rows = [("Warm, Promo", ["promo", "x", "warmpromonight", "cold"]), ("", ["promo"]), (None, ["a b"]), ("warm", None)]
    df = spark.createDataFrame(rows, "text string, words array<string>")
    got = [list(r[0]) for r in df.select(matching.hits(F.col("text"), F.col("words"))).collect()]
    assert got == [["promo", "warmpromonight"], [], [], []]


def test_policies_keep_their_order(spark):
    rules = matching.Policies((matching.Policy("b", ("x", "y")), matching.Policy("a", ("z", "x"), ("q",))), {"c": "a"})
    df = spark.createDataFrame([("c b",), ("C",), (None,)], "t string")
    assert [list(r[0]) for r in df.select(rules.actions(F.col("t"), "required")).collect()] == [["x", "y", "z"], ["z", "x"], []]
    assert [list(r[0]) for r in df.select(rules.actions(F.col("t"), "forbidden")).collect()] == [["q"], ["q"], []]


def test_one_to_one_against_a_loop(spark):
    draw = random.Random(5)
    rows = [(k, i, f, draw.choice([0.1, 0.15, 0.4, 0.4, 0.7])) for k in range(20) for i in range(4) for f in range(5)]
    want = []
    for k in range(20):
        taken = []
        for o, i, f in sorted((-o, i, f) for kk, i, f, o in rows if kk == k and o >= 0.15):
            if all(i != a and f != b for a, b, _ in taken):
                taken.append((i, f, -o))
        want += [(k, *t) for t in taken]
    df = spark.createDataFrame(rows, "image_id long, instance long, face long, overlap double")
    assert sorted(map(tuple, matching.one_to_one(df).collect())) == sorted(want)
    assert matching.one_to_one(df.limit(0)).count() == 0


def test_dark_frame_keeps_every_row(spark):
    rows = [(1, x, y, 0, 0, 0) for x in range(4) for y in range(3)] + [(2, x, y, *([90] * 3 if y == 1 else [0] * 3)) for x in range(4) for y in range(3)]
    df = spark.createDataFrame(rows, "frame_id long, x int, y int, r int, g int, b int")
    assert sorted(map(tuple, coverage.active_rows(df, 4).collect())) == [(1, 0, 3), (2, 1, 2)]


def test_gaps_only_between_detections(spark):
    seen = [(1, k, k in (2, 5, 6)) for k in range(9)] + [(2, k, False) for k in range(3)] + [(1, 9, None)]
    df = spark.createDataFrame(seen, "clip_id long, frame_no long, detected boolean")
    assert sorted(r.frame_no for r in coverage.isolated_gaps(df).collect()) == [3, 4]


def test_release_weights_rise_and_fall(spark):
    frames = spark.createDataFrame([(1, k) for k in range(40)], "clip_id long, frame_no long")
    segments = spark.createDataFrame([(1, 10, 21, 5), (1, 21, 33, 5), (1, 34, 39, 3)], "clip_id long, start_frame long, end_frame long, transition_frames long")
    clips = spark.createDataFrame([(1, 40)], "clip_id long, frames long")
    checked = coverage.checked_releases(segments, clips, 10.0)
    assert sorted((r.start_frame, r.valid) for r in checked.collect()) == [(10, True), (21, False), (34, False)]
    weight = {r.frame_no: r.weight for r in coverage.release_weights(frames, checked.filter("valid")).collect()}
    assert len(weight) == 40 and weight[9] == weight[22] == 0 and weight[14] == weight[17] == 1
    assert abs(weight[10] - 0.2**2 * (3 - 0.4)) < 1e-12 and weight[10] == weight[21]


def test_opposite_casts_cancel(spark):
    df = spark.createDataFrame([(1, 0, 0.1, 10.0, 0.5), (1, 0, 0.1, 190.0, 0.7)], "clip_id long, shot long, cast_magnitude double, cast_hue double, luma double")
    row = coverage.shot_profile(df, ["luma"]).first()
    assert row.cast_magnitude < 1e-9 and abs(row.luma - 0.6) < 1e-9 and row.samples == 2


def test_ties_do_not_rise(spark):
    df = spark.createDataFrame([(1, 30, 1.0), (1, 55, 2.0), (1, 80, 3.0), (2, 30, 1.0), (2, 55, 1.0), (3, 30, None), (3, 55, 1.0)], "id long, level int, v double")
    assert {r.id: r.strictly_rising for r in coverage.rising(df, ["id"], "level", "v").collect()} == {1: True, 2: False, 3: False}


def test_overlapping_windows_and_their_flanks(spark):
    windows = spark.createDataFrame([(1, 10, 4, 0.9), (1, 12, 8, 0.9), (1, 13, 3, 0.7), (1, 14, 3, 0.8), (2, 0, 4, 0.6)], "clip_id long, start long, length long, coherence double")
    kept = sequence.without_overlaps(windows)
    assert sorted((r.clip_id, r.start, r.length) for r in kept.collect()) == [(1, 10, 4), (1, 14, 3), (2, 0, 4)]

    level, luma = 0.1, []
    for k in range(60):  # drifts over frames 20 to 32, nearly still elsewhere
        luma.append(level)
        level += 0.05 if 20 <= k < 32 else 0.001
    frames = spark.createDataFrame([(1, k, v) for k, v in enumerate(luma)], "clip_id long, frame_no long, luma double")
    found = spark.createDataFrame([(1, 20, 11, 1.0)], "clip_id long, start long, length long, coherence double")
    row = sequence.expanded(found, frames).first()
    assert (row.found_start, row.found_end, row.start, row.end) == (20, 31, 20, 32)


def test_rejected_options_go_last(spark):
    options = spark.createDataFrame([("s", k, 55, k) for k in range(4)] + [("t", 1, 55, 0)], "source_sha string, recipe_id long, strength int, place long")
    book = spark.createDataFrame([("s", 0, 55, "rejected"), ("s", 1, 80, "rejected"), ("u", 1, 55, "rejected"), ("s", 2, 55, "accepted"), ("s", 0, 55, "rejected")], "source_sha string, recipe_id long, strength int, verdict string")
    got = {(r.source_sha, r.recipe_id): (r.new_place, r.rejected) for r in records.demoted(options, book).collect()}
    assert got == {("s", 0): (4, True), ("s", 1): (1, False), ("s", 2): (2, False), ("s", 3): (3, False), ("t", 1): (1, False)}


def test_nearest_ranks_are_values(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(10)] + [(2, 7.0)], "id long, v double")
    for p in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {r.id: (r.t, r.r) for r in df.groupBy("id").agg(records.nearest_rank(F.col("v"), p).alias("t"), records.nearest_rank(F.col("v"), p, "round").alias("r")).collect()}
        assert got == {1: (float(min(9, int(10 * p))), float(round(9 * p))), 2: (7.0, 7.0)}


def test_overrides_never_multiply(spark):
    recipes = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 0.0)], "recipe_id long, saturation double, temperature double")
    over = spark.createDataFrame([(1, "video", 0.5, None), (1, "video", 0.7, None), (1, "photo", 0.1, 0.1), (3, "video", 0.2, None)], "recipe_id long, media string, saturation double, temperature double")
    got = records.overridden(recipes, over, "video", ["saturation", "temperature"])
    assert sorted(map(tuple, got.select("recipe_id", "saturation", "temperature").collect())) == [(1, 0.7, 0.0), (2, 1.0, 0.0)]


def test_zip_names_incomplete_groups(spark):
    a = spark.createDataFrame([(g, k) for g in (1, 2) for k in range(3)], "g long, k long")
    got = records.zipped(a, a.filter("not (g = 2 and k = 1)"), a, ["g", "k"])
    assert sorted(map(tuple, got.collect())) == [(1, 3, True), (2, 2, False)]


def test_a_light_is_found_and_a_plain_frame_has_none(spark):
    rows = [(1, 0.9 if (x, y) in ((2, 3), (3, 3)) else 0.2, x / 10, y / 10) for x in range(10) for y in range(10)] + [(2, 0.5, x / 10, 0.0) for x in range(10)]
    got = {r.frame_id: r for r in fields.light_source(spark.createDataFrame(rows, "frame_id long, luma double, u double, v double")).collect()}
    assert got[1].found and abs(got[1].cx - 0.25) < 1e-9 and abs(got[1].radius - 0.05) < 1e-9 and not got[2].found


def test_detail_that_sinks_only_at_the_cut(spark):
    frames = spark.createDataFrame([(c, k, d) for c, low in ((1, 0.01), (2, 0.04)) for k in range(20) for d in [low if 8 <= k <= 12 else 0.05]] + [(3, k, 0.001) for k in range(20)], "clip_id long, frame_no long, detail double")
    cuts = spark.createDataFrame([(c, 11, "hard_cut") for c in (1, 2, 3)] + [(1, 4, "flash")], "clip_id long, frame_no long, kind string")
    got = {r.clip_id: r for r in sequence.whip_pans(cuts, frames, 9).collect()}
    assert {c: r.suspected for c, r in got.items()} == {1: True, 2: False, 3: False}
    assert abs(got[1].depth - 0.8) < 1e-9 and got[1].frame_no == 11
