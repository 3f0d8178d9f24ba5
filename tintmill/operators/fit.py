"""How well a catalogue's recipes suit frames: facts about scenes, hard gates, scores, the best few.

A catalogue is small (MOST recipes; more are an error) and meets frames as one row that holds an array of
all its recipes, so frames are neither multiplied nor sorted: a frame's scores are a transform of that array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Recipes of a catalogue, at most.
MOST = 1000

# The scene families that image labels and segmented classes stand for, the latter from an area on.
LABEL_FAMILIES = {
    "people": "人像", "adult": "人像", "child": "人像", "face": "人像", "crowd": "人像", "sky": "天空", "cloudy": "阴天", "sunset": "日落", "sunrise": "日落", "night": "夜景",
    "outdoor": "户外", "indoor": "室内", "room": "室内", "kitchen": "室内", "building": "建筑", "architecture": "建筑", "skyscraper": "建筑", "house": "建筑",
    "street": "街拍", "road": "街拍", "city": "城市", "urban": "城市", "lamppost": "城市", "plant": "植被", "tree": "植被", "forest": "森林", "grass": "草原", "flower": "植被",
    "beach": "海边", "sea": "海边", "ocean": "海边", "water": "水面", "lake": "湖泊", "mountain": "山川", "snow": "雪景", "desert": "沙漠",
    "food": "美食", "dessert": "美食", "drink": "美食", "meal": "美食", "product": "产品", "consumer_electronics": "产品", "machine": "产品",
    "vehicle": "汽车", "car": "汽车", "clothing": "人像", "rain": "雨夜",
}
CLASS_FAMILIES = (("sky", "天空", 0.10), ("sky", "户外", 0.10), ("vegetation", "植被", 0.12), ("vegetation", "森林", 0.35), ("building", "建筑", 0.15), ("building", "城市", 0.25), ("product", "产品", 0.10))
LEAST_CONFIDENCE = 0.45
WARM, COOL, GREEN = ("红", "橙／肤色带", "黄"), ("青蓝", "蓝", "青绿"), ("绿", "黄绿", "青绿")
PORTRAIT = "人像"
#: Shares of blown and crushed pixels (by luminance) beyond which a recipe must not brighten or darken.
BLOWN, CRUSHED = 0.02, 0.08
#: Share of chromatic pixels from which near-neutral ones no longer stand for the frame.
FEW_NEUTRALS = 0.75


def scene_families(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """frame_id, families: map of scene family to the strongest evidence. labels: frame_id, label, confidence;
    classes: frame_id, class, present, area, confidence."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_FAMILIES.items() for x in pair])
    said = labels.select("frame_id", known[F.col("label")].alias("family"), F.col("confidence").alias("strength"))
    ways = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(f).alias("family"), F.lit(a).alias("least")) for c, f, a in CLASS_FAMILIES])
    fits = F.filter(ways, lambda w: (w["class"] == F.col("class")) & (F.col("area") >= w["least"]))
    seen = classes.filter(F.col("present") & (F.col("confidence") >= LEAST_CONFIDENCE)).withColumn("way", F.explode(fits))
    seen = seen.select("frame_id", "way.family", (F.col("confidence") * F.least(F.lit(1.0), F.col("area") + 0.5)).alias("strength"))
    both = said.filter("family is not null").unionByName(seen).groupBy("frame_id", "family").agg(F.max("strength").alias("strength"))
    return both.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("family", "strength"))).alias("families"))


def admission(allowed: Column, state: Column, value: Column, not_night: Column) -> Column:
    """Why a recipe for the lights `allowed` may be taken (any, unknown, light) or not (conflict, not night,
    no evidence, other light). A gate, no score: nothing makes up for it."""
    night_only = F.size(F.array_except(allowed, F.array(F.lit("night"), F.lit("unknown")))) == 0
    return (
        F.when(F.array_contains(allowed, "any"), "any").when(state == "conflicting", "conflict")
        .when((state == "unknown") & F.coalesce(not_night, F.lit(False)) & night_only, "not night")
        .when((state == "unknown") & F.array_contains(allowed, "unknown"), "unknown").when(state == "unknown", "no evidence")
        .when(F.coalesce(F.array_contains(allowed, value), F.lit(False)), "light").otherwise("other light")
    )


ADMITTED = ("any", "unknown", "light")


def feasible(wanted: Column, up: Column, down: Column) -> Column:
    """How far a wanted change of exposure lies inside what the frame has left: 1 inside, falling over 0.6 EV."""
    over = F.when(wanted > 0, wanted - up).when(wanted < 0, down - wanted).otherwise(0.0)
    return F.when(over <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - over / 0.6))


def _any(names: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(x) for x in wanted]))


def scored(r: Column, f: Callable[[str], Column] = F.col) -> Column:
    """A recipe (struct) against the facts of a frame (columns): recipe_id, score, blockers, penalties.

    Recipe: recipe_id, midpoint_ev, tone_span, colorfulness (increase, decrease, compress or null), syntax, texture, light, forbidden,
    required, scenes (arrays), narrow, most_warm. Frame: up, down, blown, crushed, tone_span,
    chromatic, colorfulness, hues (array of family, share), cast_hue, cast_magnitude, noise, state, value, not_night, families, person."""
    wanted, families = r["midpoint_ev"], F.map_keys(f("families"))
    hues = F.transform(f("hues"), lambda h: h["family"])
    warm, cool, chromatic, vivid = _any(hues, WARM), _any(hues, COOL), f("chromatic"), f("colorfulness")
    gate = admission(r["light"], f("state"), f("value"), f("not_night"))
    forbidden = F.arrays_overlap(r["forbidden"], families)
    warm_share = F.aggregate(F.filter(f("hues"), lambda h: h["family"].isin(*WARM)), F.lit(0.0), lambda a, h: a + h["share"])
    greens = _any(hues, GREEN)
    blockers = {
        "light": ~gate.isin(*ADMITTED), "scene": forbidden, "warm area": F.coalesce(chromatic * warm_share >= r["most_warm"], F.lit(False)),
        "blown": (f("blown") > BLOWN) & (wanted > 0.05), "crushed": (f("crushed") > CRUSHED) & (wanted < -0.05), "no green": (r["syntax"] == "green-world") & ~greens,
    }
    few = chromatic >= FEW_NEUTRALS
    cast = lambda low, high: (f("cast_magnitude") > 0.006) & f("cast_hue").between(low, high)
    warm_cast, cool_cast = F.when(few, warm & ~cool).otherwise(cast(20, 110)), F.when(few, cool & ~warm).otherwise(cast(190, 300))
    to_warm, to_cool = r["syntax"] == "warm-analogous", r["syntax"] == "cool-analogous"
    with_it = (to_warm & warm_cast) | (to_cool & cool_cast)
    against = ((to_warm & cool_cast) | (to_cool & warm_cast)) & ~with_it
    span, ev = f("tone_span"), feasible(wanted, f("up"), f("down"))
    needed = F.array_distinct(F.concat(r["scenes"], r["required"]))
    strongest = F.array_max(F.transform(F.array_intersect(needed, families), lambda s: f("families")[s]))
    astray = r["narrow"] & (F.size(r["required"]) > 0) & (F.size(families) > 0) & ~F.arrays_overlap(r["required"], families)
    increase, compress = r["tone_span"] == "increase", r["tone_span"] == "compress"
    person = F.coalesce(f("person"), F.lit(False))
    syntax = (
        F.when(r["syntax"] == "monochrome", 8.0).when(r["syntax"] == "green-world", F.when(greens, 14.0).otherwise(-22.0))
        .when(r["syntax"] == "warm-cool-split", F.when(warm & cool, 18.0).when(warm | cool, 11.0).otherwise(-14.0))
        .when(to_warm | to_cool, F.when(with_it, 12.0).when(against, 2.0).otherwise(7.0)).when(r["syntax"] == "restrained-neutral", 9.0).otherwise(0.0)
    )
    terms = [
        F.when(forbidden, -60.0), ev * 30.0, F.when(increase & (span < 0.55), 16.0).when(increase & (span > 0.85), -10.0).when(compress & (span > 0.7), 14.0).when(compress & (span < 0.3), -16.0), syntax,
        F.when((r["colorfulness"] == "increase") & (vivid < 0.10), 10.0).when((r["colorfulness"] == "decrease") & (vivid < 0.07), -12.0),
        F.when((r["texture"] == "crisp") & (f("noise") > 0.009), -8.0).when((r["texture"] == "grain") & (f("noise") > 0.012), -6.0),
        strongest * 12.0, F.when(astray, -28.0), F.when(person & F.array_contains(r["scenes"], PORTRAIT), 8.0),
    ]
    penalties = {
        "exposure": ev < 1, "span": (increase & (span > 0.85)) | (compress & (span < 0.3)), "loses colour": (r["syntax"] == "monochrome") & (chromatic >= 0.5),
        "no hue": (r["syntax"] == "warm-cool-split") & ~(warm | cool), "against cast": against, "dull": (r["colorfulness"] == "decrease") & (vivid < 0.07),
        "noise": ((r["texture"] == "crisp") & (f("noise") > 0.009)) | ((r["texture"] == "grain") & (f("noise") > 0.012)), "scene": astray, "scene unknown": r["narrow"] & (F.size(r["required"]) > 0) & (F.size(families) == 0),
        "skin": person & (((r["colorfulness"] == "decrease") & (r["syntax"] != "monochrome")) | (r["syntax"] == "green-world")),
    }
    named = lambda held: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in held.items()]))
    total = F.lit(0.0)
    for t in terms:
        total = total + F.coalesce(t, F.lit(0.0))
    return F.struct(r["recipe_id"].alias("recipe_id"), F.round(total, 2).alias("score"), gate.alias("gate"), named(blockers).alias("blockers"), named(penalties).alias("penalties"), r["syntax"].alias("syntax"))


def beside(frames: DataFrame, catalogue: DataFrame) -> DataFrame:
    """frames with the whole catalogue as an array in `recipes`: one row, broadcast, of MOST recipes at most."""
    own = catalogue.agg(F.sort_array(F.collect_list(F.struct(*catalogue.columns))).alias("recipes"))
    too_many = F.raise_error(F.lit(f"a catalogue has {MOST} recipes at most")).cast(own.schema["recipes"].dataType)
    own = own.select(F.when(F.size("recipes") <= MOST, F.col("recipes")).otherwise(too_many).alias("recipes"))
    return frames.crossJoin(F.broadcast(own))


def scores(frames: DataFrame, catalogue: DataFrame) -> DataFrame:
    """frames with `scored`: every recipe's score, best first, equal scores by recipe_id."""
    out = beside(frames, catalogue).withColumn("scored", F.transform("recipes", lambda r: scored(r))).drop("recipes")
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["recipe_id"] < b["recipe_id"], -1).otherwise(1)
    return out.withColumn("scored", F.array_sort("scored", order))


def examined(ranked: Column, explicit: tuple[str, ...], count: int) -> Column:
    """The recipes that a preview is tried for: best first, without those that must be asked for, max(8,
    count) of them at most."""
    return F.slice(F.filter(ranked, lambda s: ~s["syntax"].isin(*explicit)), 1, max(8, count))


def chosen(tried: Column, count: int) -> Column:
    """The first `count` of the examined recipes that nothing blocks; trying stops there."""
    return F.slice(F.filter(tried, lambda s: F.size(s["blockers"]) == 0), 1, count)
