"""Queries over the fit of recipes to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.functions import colour, labels
from tintmill.operators import diagnosis, fit
from tintmill.plans import frames as own
from tintmill.plans import sql
from tintmill.plans.frames import rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures

COUNT = 3
EXPLICIT = ("monochrome",)
LIGHTS = (("any",), ("day",), ("night",), ("night", "unknown"), ("indoor", "day", "unknown"), ("day", "night"))
SYNTAXES = ("monochrome", "green-world", "warm-cool-split", "warm-analogous", "cool-analogous", "restrained-neutral")
SPANS, VIVID, TEXTURES = ("increase", "compress", None), ("increase", "decrease", None), ("crisp", "grain", "clean")
SCENES = (("人像", "室内"), ("日落", "海边"), ("建筑", "城市"), ("植被",), ())
REQUIRED = ((), ("日落", "天空"), ("建筑",), ())
FORBIDDEN = ((), ("夜景",), ("人像", "美食"))
SEEN = ("people", "sky", "sunset", "night", "indoor", "building", "tree", "beach", "food", "car", "cloudy", "forest")
CLASSES = ("sky", "vegetation", "building", "product")


def _pick(of, key: str, by: int):
    """One of a tuple by key modulo its size; by spreads neighbours."""
    values = F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, tuple) else F.lit(v).cast("string") for v in of])
    return F.element_at(values, ((F.col(key) * by) % len(of) + 1).cast("int"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe for each brand of part: a catalogue as small as real ones are."""
    one = fixtures.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("recipe_id"), F.sum("p_size").alias("k"))
    return one.select(
        "recipe_id", ((F.col("k") % 21 - 10) / 10.0).alias("midpoint_ev"), _pick(SPANS, "k", 1).alias("tone_span"), _pick(VIVID, "recipe_id", 1).alias("colorfulness"), _pick(SYNTAXES, "recipe_id", 1).alias("syntax"),
        _pick(TEXTURES, "k", 2).alias("texture"), _pick(LIGHTS, "k", 1).alias("light"), _pick(FORBIDDEN, "recipe_id", 2).alias("forbidden"), _pick(REQUIRED, "k", 3).alias("required"), _pick(SCENES, "recipe_id", 3).alias("scenes"),
        (F.col("k") % 2 == 0).alias("narrow"), F.when(F.col("recipe_id") % 4 == 0, 0.3).alias("most_warm"),
    )


def seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What image labels and segmentation said of each frame."""
    base = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), "s_nationkey")
    at = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    label = F.element_at(F.array(*[F.lit(x) for x in SEEN]), ((F.col("frame_id") * 5 + F.col("s_nationkey") * 3 + F.col("j") * 7) % len(SEEN) + 1).cast("int"))
    said = at.select("frame_id", label.alias("label"), ((F.col("frame_id") * 17 + F.col("j") * 31) % 100 / 100.0).alias("confidence"))
    at = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1))))
    kind = F.element_at(F.array(*[F.lit(x) for x in CLASSES]), F.col("j") + 1)
    found = at.select("frame_id", kind.alias("class"), ((F.col("frame_id") + F.col("j")) % 3 != 0).alias("present"), ((F.col("frame_id") * 13 + F.col("j") * 29) % 60 / 100.0).alias("area"), ((F.col("frame_id") * 7 + F.col("j") * 11) % 100 / 100.0).alias("confidence"))
    return said.filter("frame_id % 9 != 0"), found.filter("frame_id % 9 != 0")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a recipe is held against, a row a frame."""
    px = fixtures.scenes(spark, sf_dir)
    stats = diagnosis.light_fact(diagnosis.statistics(px, parts=fixtures.frame_parts(spark, sf_dir)), F.expr(own.LABEL), F.expr(own.CONFIDENCE))
    hues = diagnosis.hue_histogram(px).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("rank", "family", "share"))).alias("hues"))
    families = fit.scene_families(*seen(spark, sf_dir))
    none = F.create_map().cast("map<string,double>")
    out = stats.join(hues, "frame_id", "left").join(families, "frame_id", "left").withColumn("families", F.coalesce("families", none))
    return out.select(
        "frame_id", labels.headroom_up(F.col("p50")).alias("up"), labels.headroom_down(F.col("p50")).alias("down"), F.col("luma_blown_ratio").alias("blown"), F.col("luma_crushed_ratio").alias("crushed"), "tone_span",
        F.col("chromatic_pixel_ratio").alias("chromatic"), "colorfulness", F.coalesce("hues", F.array().cast("array<struct<rank:int,family:string,share:double>>")).alias("hues"), "cast_hue", "cast_magnitude",
        F.col("noise_estimate").alias("noise"), "state", "value", "not_night", "families", (F.col("frame_id") % 3 == 0).alias("person"),
    )


def _list(v: tuple) -> str:
    return "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"


def _picked(of, key: str, by: int) -> str:
    values = ", ".join(_list(v) if isinstance(v, tuple) else f"'{v}'" if v else "NULL" for v in of)
    return f"([{values}])[CAST(({key} * {by}) % {len(of)} + 1 AS INT)]"


CATALOGUE = f"""one AS (SELECT min(p_partkey) AS recipe_id, sum(p_size)::BIGINT AS k FROM part GROUP BY p_brand),
cat AS (SELECT recipe_id, (k % 21 - 10) / 10e0 AS ev, {_picked(SPANS, 'k', 1)} AS want_span, {_picked(VIVID, 'recipe_id', 1)} AS want_vivid, {_picked(SYNTAXES, 'recipe_id', 1)} AS syntax,
  {_picked(TEXTURES, 'k', 2)} AS texture, {_picked(LIGHTS, 'k', 1)} AS light, {_picked(FORBIDDEN, 'recipe_id', 2)} AS forbidden, {_picked(REQUIRED, 'k', 3)} AS required,
  {_picked(SCENES, 'recipe_id', 3)} AS scenes, k % 2 = 0 AS narrow, CASE WHEN recipe_id % 4 = 0 THEN 3e-1 END AS most_warm FROM one)"""
_MAP = "CASE label " + " ".join(f"WHEN '{x}' THEN '{fit.LABEL_FAMILIES[x]}'" for x in SEEN) + " END"
_AREAS = ", ".join(f"('{c}', '{f}', {sql.num(a)})" for c, f, a in fit.CLASS_FAMILIES)
FAMILIES = f"""said AS (SELECT s_suppkey AS frame_id, ({_list(SEEN)})[CAST((s_suppkey * 5 + s_nationkey * 3 + j * 7) % {len(SEEN)} + 1 AS INT)] AS label, ((s_suppkey * 17 + j * 31) % 100) / 100e0 AS strength
  FROM supplier, range(3) t(j) WHERE s_suppkey % 9 <> 0),
cls AS (SELECT s_suppkey AS frame_id, ({_list(CLASSES)})[CAST(j + 1 AS INT)] AS class, (s_suppkey + j) % 3 <> 0 AS present, ((s_suppkey * 13 + j * 29) % 60) / 100e0 AS area, ((s_suppkey * 7 + j * 11) % 100) / 100e0 AS conf
  FROM supplier, range(4) t(j) WHERE s_suppkey % 9 <> 0),
fam AS (SELECT frame_id, family, max(strength) AS strength FROM (SELECT frame_id, {_MAP} AS family, strength FROM said
  UNION ALL SELECT frame_id, w.family, conf * least(1e0, 5e-1 + area) FROM cls JOIN (VALUES {_AREAS}) w(class, family, least_area) ON w.class = cls.class AND area >= least_area WHERE present AND conf >= 45e-2)
  WHERE family IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {FAMILIES} SELECT frame_id, family, {s6(strength='strength')} FROM fam")
def fit_scene_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene families of frames, from labels and from segmented areas."""
    found = fit.scene_families(*seen(spark, sf_dir))
    return rounded(found.select("frame_id", F.explode("families").alias("family", "strength")), "frame_id")


_HUES = f"""bins AS (SELECT frame_id, CAST(floor({sql.hue('oka', 'okb')} / 10) AS INT) % 36 AS bin, sum({sql.hypot('oka', 'okb')}) AS w FROM lab WHERE {sql.hypot('oka', 'okb')} >= 28e-3 GROUP BY ALL),
ranked AS (SELECT *, w / sum(w) OVER (PARTITION BY frame_id) AS share, row_number() OVER (PARTITION BY frame_id ORDER BY round(w, 9) DESC, bin) AS rank, bin * 10 + 5 AS centre FROM bins),
hues AS (SELECT frame_id, list(family) AS hues, coalesce(sum(share) FILTER (WHERE family IN ('红', '橙／肤色带', '黄')), 0e0) AS warm_share
  FROM (SELECT *, {sql.cases('centre', labels.HUE_FAMILIES, labels.HUE_FAMILIES[0][1])} AS family FROM ranked WHERE rank <= 3) GROUP BY frame_id)"""
FACTS = f"""{own.POLISHED_SQL}, {own._LIGHT}, said_light AS (SELECT *, CASE WHEN p95 <= 37e-2 THEN 'night' WHEN is_day AND p95 >= 4e-1 THEN 'day' WHEN against THEN NULL WHEN is_in THEN 'indoor' END AS value,
  CASE WHEN p95 <= 37e-2 OR (is_day AND p95 >= 4e-1) THEN 'known' WHEN against THEN 'conflicting' WHEN is_in THEN 'known' ELSE 'unknown' END AS state FROM facts),
{_HUES}, {FAMILIES}, fl AS (SELECT frame_id, list(family) AS fams FROM fam GROUP BY frame_id),
frame AS (SELECT s.frame_id, log2(greatest(2e-2, least(62e-2, s.p50 * 22e-1)) / greatest(5e-3, s.p50)) AS up, s.p50, luma_blown_ratio AS blown, luma_crushed_ratio AS crushed, tone_span AS span, chromatic_pixel_ratio AS chromatic,
  colorfulness AS vivid, coalesce(hues, []) AS hues, coalesce(warm_share, 0e0) AS warm_share, cast_hue, cast_magnitude, noise_estimate AS noise, state, value, CASE WHEN state = 'unknown' THEN s.p95 >= 4e-1 ELSE FALSE END AS not_night, coalesce(fams, []) AS fams, s.frame_id % 3 = 0 AS person
  FROM stats s JOIN said_light USING (frame_id) LEFT JOIN hues USING (frame_id) LEFT JOIN fl USING (frame_id))"""


def _has(names: str, wanted: tuple[str, ...]) -> str:
    return f"list_has_any({names}, {_list(wanted)})"


GATE = """CASE WHEN list_contains(light, 'any') THEN 'any' WHEN state = 'conflicting' THEN 'conflict'
  WHEN state = 'unknown' AND not_night AND len(list_filter(light, lambda x: x NOT IN ('night', 'unknown'))) = 0 THEN 'not night'
  WHEN state = 'unknown' AND list_contains(light, 'unknown') THEN 'unknown' WHEN state = 'unknown' THEN 'no evidence' WHEN list_contains(light, value) THEN 'light' ELSE 'other light' END"""
PAIRED = f"""{FACTS}, {CATALOGUE}, met AS (SELECT *, {GATE} AS gate, {_has('hues', fit.WARM)} AS warm, {_has('hues', fit.COOL)} AS cool, {_has('hues', fit.GREEN)} AS green, list_has_any(forbidden, fams) AS banned,
  len(required) > 0 AND narrow AS picky, list_has_any(required, fams) AS suits FROM frame, cat)"""


@query(f"{PAIRED} SELECT frame_id, recipe_id, gate, gate IN ('any', 'unknown', 'light') AS admitted FROM met")
def fit_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each recipe of the catalogue may be taken for a frame's light, or not."""
    rows = fit.beside(facts(spark, sf_dir), catalogue(spark, sf_dir)).withColumn("r", F.explode("recipes"))
    gate = fit.admission(F.col("r.light"), F.col("state"), F.col("value"), F.col("not_night"))
    return rows.select("frame_id", "r.recipe_id", gate.alias("gate"), gate.isin(*fit.ADMITTED).alias("admitted"))


SCORED = f"""{PAIRED}, down AS (SELECT frame_id, log2(greatest(3e-2, p50 * 55e-2) / greatest(5e-3, p50)) AS down FROM frame), toned AS (SELECT met.*, down,
  CASE WHEN chromatic >= 75e-2 THEN warm AND NOT cool ELSE cast_magnitude > 6e-3 AND cast_hue BETWEEN 20 AND 110 END AS is_warm,
  CASE WHEN chromatic >= 75e-2 THEN cool AND NOT warm ELSE cast_magnitude > 6e-3 AND cast_hue BETWEEN 190 AND 300 END AS is_cool,
  CASE WHEN ev > 0 THEN ev - up WHEN ev < 0 THEN down - ev ELSE 0 END AS over, (SELECT max(strength) FROM fam WHERE fam.frame_id = met.frame_id AND list_contains(scenes || required, family)) AS strongest
  FROM met JOIN down USING (frame_id)),
side AS (SELECT *, (syntax = 'warm-analogous' AND is_warm) OR (syntax = 'cool-analogous' AND is_cool) AS along, (syntax = 'warm-analogous' AND is_cool) OR (syntax = 'cool-analogous' AND is_warm) AS across FROM toned),
terms AS (SELECT *, CASE WHEN banned THEN -60 ELSE 0 END + 30 * CASE WHEN over <= 0 THEN 1 ELSE greatest(0, 1 - over / 6e-1) END
  + CASE WHEN want_span = 'increase' AND span < 55e-2 THEN 16 WHEN want_span = 'increase' AND span > 85e-2 THEN -10 WHEN want_span = 'compress' AND span > 7e-1 THEN 14 WHEN want_span = 'compress' AND span < 3e-1 THEN -16 ELSE 0 END
  + CASE syntax WHEN 'monochrome' THEN 8 WHEN 'green-world' THEN CASE WHEN green THEN 14 ELSE -22 END WHEN 'warm-cool-split' THEN CASE WHEN warm AND cool THEN 18 WHEN warm OR cool THEN 11 ELSE -14 END
      WHEN 'restrained-neutral' THEN 9 ELSE CASE WHEN along THEN 12 WHEN across THEN 2 ELSE 7 END END
  + CASE WHEN want_vivid = 'increase' AND vivid < 1e-1 THEN 10 WHEN want_vivid = 'decrease' AND vivid < 7e-2 THEN -12 ELSE 0 END
  + CASE WHEN texture = 'crisp' AND noise > 9e-3 THEN -8 WHEN texture = 'grain' AND noise > 12e-3 THEN -6 ELSE 0 END
  + coalesce(12 * strongest, 0) + CASE WHEN picky AND len(fams) > 0 AND NOT suits THEN -28 ELSE 0 END + CASE WHEN person AND list_contains(scenes, '人像') THEN 8 ELSE 0 END AS total,
  array_to_string(list_filter([CASE WHEN gate NOT IN ('any', 'unknown', 'light') THEN 'light' END, CASE WHEN banned THEN 'scene' END, CASE WHEN chromatic * warm_share >= most_warm THEN 'warm area' END,
    CASE WHEN blown > 2e-2 AND ev > 5e-2 THEN 'blown' END, CASE WHEN crushed > 8e-2 AND ev < -5e-2 THEN 'crushed' END, CASE WHEN syntax = 'green-world' AND NOT green THEN 'no green' END], lambda x: x IS NOT NULL), ', ') AS blockers,
  array_to_string(list_filter([CASE WHEN over > 0 THEN 'exposure' END, CASE WHEN (want_span = 'increase' AND span > 85e-2) OR (want_span = 'compress' AND span < 3e-1) THEN 'span' END, CASE WHEN syntax = 'monochrome' AND chromatic >= 5e-1 THEN 'loses colour' END,
    CASE WHEN syntax = 'warm-cool-split' AND NOT (warm OR cool) THEN 'no hue' END, CASE WHEN across AND NOT along THEN 'against cast' END, CASE WHEN want_vivid = 'decrease' AND vivid < 7e-2 THEN 'dull' END,
    CASE WHEN (texture = 'crisp' AND noise > 9e-3) OR (texture = 'grain' AND noise > 12e-3) THEN 'noise' END, CASE WHEN picky AND len(fams) > 0 AND NOT suits THEN 'scene' END, CASE WHEN picky AND len(fams) = 0 THEN 'scene unknown' END,
    CASE WHEN person AND ((want_vivid = 'decrease' AND syntax <> 'monochrome') OR syntax = 'green-world') THEN 'skin' END], lambda x: x IS NOT NULL), ', ') AS penalties FROM side)"""


@query(f"{SCORED} SELECT frame_id, recipe_id, round(total, 2) + 0e0 AS score, gate, blockers, penalties FROM terms")
def fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recipe's score for each frame, what blocks it and what speaks against it."""
    rows = fit.scores(facts(spark, sf_dir), catalogue(spark, sf_dir)).select("frame_id", F.explode("scored").alias("s"))
    text = lambda c: F.array_join(F.col(f"s.{c}"), ", ").alias(c)
    return rows.select("frame_id", "s.recipe_id", (F.col("s.score") + 0.0).alias("score"), "s.gate", text("blockers"), text("penalties"))


_TRIED = f"""{SCORED}, tried AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(total, 2) DESC, recipe_id) AS n FROM terms WHERE syntax NOT IN ('monochrome')),
best AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n) AS rank FROM tried WHERE n <= {max(8, COUNT)} AND blockers = '' QUALIFY rank <= {COUNT})"""


@query(f"{_TRIED} SELECT frame_id, rank, recipe_id, round(total, 2) + 0e0 AS score FROM best")
def fit_score_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three recipes of each frame that nothing blocks, among the few that are tried."""
    rows = fit.scores(facts(spark, sf_dir), catalogue(spark, sf_dir))
    best = fit.chosen(fit.examined(F.col("scored"), EXPLICIT, COUNT), COUNT)
    rows = rows.select("frame_id", F.posexplode(best).alias("at", "s"))
    return rows.select("frame_id", (F.col("at") + 1).cast("long").alias("rank"), "s.recipe_id", (F.col("s.score") + 0.0).alias("score"))


@query(f"""{_TRIED}, t AS (SELECT frame_id, count(*) FILTER (WHERE n <= {max(8, COUNT)}) AS tried, count(*) FILTER (WHERE n <= {max(8, COUNT)} AND blockers <> '') AS blocked FROM tried GROUP BY frame_id)
SELECT frame_id, tried, blocked, (SELECT count(*) FROM best b WHERE b.frame_id = t.frame_id) AS offered FROM t""")
def fit_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many recipes are tried for a frame, how many of them are blocked, how many are offered."""
    rows = fit.scores(facts(spark, sf_dir), catalogue(spark, sf_dir)).withColumn("tried", fit.examined(F.col("scored"), EXPLICIT, COUNT))
    count = lambda c: F.size(c).cast("long")
    blocked = F.filter("tried", lambda s: F.size(s["blockers"]) > 0)
    return rows.select("frame_id", count(F.col("tried")).alias("tried"), count(blocked).alias("blocked"), count(fit.chosen(F.col("tried"), COUNT)).alias("offered"))
