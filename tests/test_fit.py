"""Admission, blockers and scores of hand-made frames and recipes."""

import pytest
from pyspark.sql import functions as F

from tintmill.operators import fit

RECIPE = "recipe_id long, midpoint_ev double, tone_span string, colorfulness string, syntax string, texture string, light array<string>, forbidden array<string>, required array<string>, scenes array<string>, narrow boolean, most_warm double"
FRAME = (
    "frame_id long, up double, down double, blown double, crushed double, tone_span double, chromatic double, colorfulness double, hues array<struct<family: string, share: double>>, "
    "cast_hue double, cast_magnitude double, noise double, state string, value string, not_night boolean, families map<string, double>, person boolean"
)
CALM = {"recipe_id": 1, "midpoint_ev": 0.0, "tone_span": None, "colorfulness": None, "syntax": "restrained-neutral", "texture": "clean", "light": ["any"], "forbidden": [], "required": [], "scenes": [], "narrow": False, "most_warm": None}
DAY = {
    "frame_id": 1, "up": 1.0, "down": -0.8, "blown": 0.0, "crushed": 0.0, "tone_span": 0.6, "chromatic": 0.4, "colorfulness": 0.12, "hues": [("绿", 0.7), ("红", 0.3)], "cast_hue": 60.0, "cast_magnitude": 0.01,
    "noise": 0.001, "state": "known", "value": "day", "not_night": None, "families": {"建筑": 0.8}, "person": False,
}


def score(spark, recipe=None, frame=None):
    r, f = CALM | (recipe or {}), DAY | (frame or {})
    recipes = spark.createDataFrame([tuple(r.values())], RECIPE)
    frames = spark.createDataFrame([tuple(f.values())], FRAME)
    return fit.scores(frames, recipes).first().scored[0]


def test_a_calm_recipe_is_usable(spark):
    s = score(spark)
    assert s.score == 39.0 and s.blockers == [] and s.penalties == [] and s.gate == "any"


BLOCKED = [
    ("light", {"light": ["night"]}, {}), ("light", {"light": ["day"]}, {"state": "conflicting", "value": None}), ("light", {"light": ["night", "unknown"]}, {"state": "unknown", "value": None, "not_night": True}),
    ("scene", {"forbidden": ["建筑"]}, {}), ("warm area", {"most_warm": 0.1}, {}), ("blown", {"midpoint_ev": 0.3}, {"blown": 0.03}), ("crushed", {"midpoint_ev": -0.3}, {"crushed": 0.09}),
    ("no green", {"syntax": "green-world"}, {"hues": [("红", 1.0)]}),
]


@pytest.mark.parametrize("name, recipe, frame", BLOCKED)
def test_blocked(spark, name, recipe, frame):
    assert score(spark, recipe, frame).blockers == [name]


@pytest.mark.parametrize("recipe, frame", [({"midpoint_ev": 0.05}, {"blown": 0.03}), ({"midpoint_ev": 0.3}, {"blown": 0.02}), ({"light": ["night", "unknown"]}, {"state": "unknown", "value": None, "not_night": False}), ({"most_warm": 0.13}, {})])
def test_at_the_edge_nothing_blocks(spark, recipe, frame):
    assert score(spark, recipe, frame).blockers == []


SCORES = [
    (39.0 - 15.0, {"midpoint_ev": 1.3}, {}), (9.0, {"midpoint_ev": -2.0}, {}), (55.0, {"tone_span": "increase"}, {"tone_span": 0.5}), (29.0, {"tone_span": "increase"}, {"tone_span": 0.9}), (23.0, {"tone_span": "compress"}, {"tone_span": 0.2}),
    (38.0, {"syntax": "monochrome"}, {}), (44.0, {"syntax": "green-world"}, {}), (41.0, {"syntax": "warm-cool-split"}, {}), (16.0, {"syntax": "warm-cool-split"}, {"hues": []}), (42.0, {"syntax": "warm-analogous"}, {}),
    (32.0, {"syntax": "cool-analogous"}, {}), (37.0, {"syntax": "cool-analogous"}, {"cast_magnitude": 0.001}), (42.0, {"syntax": "cool-analogous"}, {"chromatic": 0.8, "hues": [("蓝", 1.0)]}), (27.0, {"colorfulness": "decrease"}, {"colorfulness": 0.05}),
    (31.0, {"texture": "crisp"}, {"noise": 0.01}), (48.6, {"scenes": ["建筑"]}, {}), (11.0, {"narrow": True, "required": ["海边"]}, {}), (39.0, {"narrow": True, "required": ["海边"]}, {"families": {}}), (47.0, {"scenes": ["人像"]}, {"person": True}),
    (-21.0, {"forbidden": ["建筑"]}, {}),
]


@pytest.mark.parametrize("want, recipe, frame", SCORES)
def test_scores(spark, want, recipe, frame):
    assert score(spark, recipe, frame).score == pytest.approx(want)


def test_only_so_many_are_tried(spark):
    rows = [tuple((CALM | {"recipe_id": k, "midpoint_ev": 0.0 if k < 12 else 2.0, "forbidden": ["建筑"] if k == 3 else [], "syntax": "monochrome" if k == 2 else "restrained-neutral"}).values()) for k in range(20)]
    out = fit.scores(spark.createDataFrame([tuple(DAY.values())], FRAME), spark.createDataFrame(rows, RECIPE))
    tried = fit.examined(F.col("scored"), ("monochrome",), 3)
    row = out.select(tried.alias("tried"), fit.chosen(tried, 3).alias("best"), F.size("scored").alias("n")).first()
    assert row.n == 20 and [s.recipe_id for s in row.tried] == [0, 1, 4, 5, 6, 7, 8, 9] and [s.recipe_id for s in row.best] == [0, 1, 4]


def test_a_catalogue_is_small(spark, monkeypatch):
    monkeypatch.setattr(fit, "MOST", 1)
    rows = [tuple((CALM | {"recipe_id": k}).values()) for k in range(2)]
    with pytest.raises(Exception, match="recipes at most"):
        fit.scores(spark.createDataFrame([tuple(DAY.values())], FRAME), spark.createDataFrame(rows, RECIPE)).collect()


def test_families_need_area_and_confidence(spark):
    labels = spark.createDataFrame([(1, "kitchen", 0.4), (1, "room", 0.7), (1, "nonsense", 0.9)], "frame_id long, label string, confidence double")
    classes = spark.createDataFrame([(1, "vegetation", True, 0.2, 0.9), (1, "building", True, 0.6, 0.44), (2, "building", True, 0.6, 0.5), (2, "sky", False, 0.9, 0.9)], "frame_id long, class string, present boolean, area double, confidence double")
    got = {r.frame_id: r.families for r in fit.scene_families(labels, classes).collect()}
    assert got == {1: {"室内": 0.7, "植被": pytest.approx(0.63)}, 2: {"建筑": 0.5, "城市": 0.5}}
