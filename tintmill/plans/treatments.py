"""Queries over single pixels and parameters: transfer curves, tone and chroma shaping, film texture, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.functions import colour, labels
from tintmill.operators import grade, records
from tintmill.plans import sql
from tintmill.plans.frames import rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures

SCENES = f"WITH {fixtures.SCENES_SQL}"
SCENES_LAB = f"{SCENES}, {sql.oklab()}, lch AS (SELECT *, {sql.hypot('oka', 'okb')} AS c, {sql.hue('oka', 'okb')} AS hue FROM lab)"


def lch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with lightness, chroma and hue of each pixel."""
    lab = colour.with_oklab(fixtures.scenes(spark, sf_dir))
    angle = F.degrees(F.atan2("ok_b", "ok_a"))
    return lab.select("frame_id", "idx", "x", "y", "h", F.col("ok_L").alias("l"), F.hypot("ok_a", "ok_b").alias("c"), F.when(angle < 0, angle + 360).otherwise(angle).alias("hue"))


@query(f"""{SCENES}, v AS (SELECT frame_id, idx, r / 255e0 AS v FROM px),
e AS (SELECT *, CASE WHEN v < 1.8053968510807e-2 THEN v * 4.5e0 ELSE 1.09929682680944e0 * pow(v, 4.5e-1) - 9.929682680944e-2 END AS e FROM v)
SELECT frame_id, idx, {s6(encoded='e', decoded='CASE WHEN e < 4.5e0 * 1.8053968510807e-2 THEN e / 4.5e0 ELSE pow((e + 9.929682680944e-2) / 1.09929682680944e0, 1e0 / 4.5e-1) END')} FROM e""")
def bt709_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel through the broadcast transfer curve and back."""
    rows = fixtures.scenes(spark, sf_dir).withColumn("encoded", colour.encode_709(F.col("r") / 255.0))
    return rounded(rows.select("frame_id", "idx", "encoded", colour.decode_709(F.col("encoded")).alias("decoded")), "frame_id", "idx")


_ROWS, _SIDES = labels.ROWS, labels.SIDES


@query(f"""{SCENES}, p AS (SELECT frame_id, idx, (x + 5e-1) / {fixtures.WIDTH} AS px, (y + 5e-1) / h AS py, abs(r - b) * 360e0 / 255 AS distance FROM px)
SELECT frame_id, idx, {sql.cases('distance', labels.HUE_TIERS, op='<=')} AS tier,
  (CASE WHEN py < 34e-2 THEN '{_ROWS['top']}' WHEN py > 66e-2 THEN '{_ROWS['bottom']}' ELSE '{_ROWS['middle']}' END) ||
  (CASE WHEN px < 38e-2 THEN '{_SIDES['left']}' WHEN px > 62e-2 THEN '{_SIDES['right']}' ELSE '{_SIDES['centre']}' END) AS position FROM p""")
def tiers_and_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier of a distance on the hue circle, and the ninth of the frame in which a pixel lies."""
    x, y = (F.col("x") + 0.5) / fixtures.WIDTH, (F.col("y") + 0.5) / F.col("h")
    distance = F.abs(F.col("r") - F.col("b")) * 360.0 / 255
    return fixtures.scenes(spark, sf_dir).select("frame_id", "idx", labels.hue_tier(distance).alias("tier"), labels.position_hint(x, y).alias("position"))


@query(f"""{SCENES_LAB} SELECT frame_id, sum(CASE WHEN okl BETWEEN 4e-1 AND 92e-2 AND c BETWEEN 2e-2 AND 115e-3 AND hue BETWEEN 25 AND 85 THEN 1 ELSE 0 END)::BIGINT AS anywhere,
  sum(CASE WHEN okl BETWEEN 8e-2 AND 95e-2 AND c >= 15e-3 AND hue BETWEEN 15 AND 80 THEN 1 ELSE 0 END)::BIGINT AS inside_a_face FROM lch GROUP BY frame_id""")
def skin_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a frame within the strict band of skin, and within the wider one that holds inside a face."""
    own = (F.col("l"), F.col("c"), F.col("hue"))
    return lch(spark, sf_dir).groupBy("frame_id").agg(F.count_if(labels.plausible_skin(*own)).alias("anywhere"), F.count_if(labels.skin_inside_a_face(*own)).alias("inside_a_face"))


TONE_POINTS = [(0.0, 0.02), (0.25, 0.22), (0.6, 0.66), (1.0, 0.98)]


@query(f"""{SCENES}, v AS (SELECT frame_id, idx, g / 255e0 AS v FROM px)
SELECT frame_id, idx, {s6(sloped='v * 12e-1 + 18e-2 * (1 - 12e-1)', toe='CASE WHEN v <= 0 THEN 0e0 ELSE v * v / (v + 4e-2) END', widest='CASE WHEN v <= 0 THEN 0e0 ELSE v * v / (v + 8e-2) END')} FROM v""")
def slope_and_toe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: contrast about a pivot that stays, and a toe that softens black; a toe that is asked too wide is held."""
    v = F.col("g") / 255.0
    return rounded(fixtures.scenes(spark, sf_dir).select("frame_id", "idx", colour.pivot_slope(v, 1.2, 0.18).alias("sloped"), colour.soft_toe(v, 0.04).alias("toe"), colour.soft_toe(v, 0.5).alias("widest")), "frame_id", "idx")


@query(f"""{SCENES_LAB} SELECT frame_id, idx, {s6(gain='CASE WHEN okl <= 5e-1 THEN 13e-1 ELSE 13e-1 * (1 - (okl - 5e-1) / 5e-1 * (1 - 6e-1)) END', held='CASE WHEN c <= 6e-2 THEN c ELSE 6e-2 + (c - 6e-2) / (1 + (c - 6e-2) * (7e-1 / 6e-2)) END')} FROM lch""")
def chroma_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturation that does not grow with lightness, and chroma compressed beyond a start with its hue kept."""
    rows = lch(spark, sf_dir)
    return rounded(rows.select("frame_id", "idx", colour.ramp_weight(F.col("l"), 1.3).alias("gain"), colour.compressed_chroma(F.col("c"), 0.7, 0.06).alias("held")), "frame_id", "idx")


_GLOW = "CASE WHEN v <= 7e-1 THEN 0e0 ELSE pow(v - 7e-1, 15e-1) * {} END"


@query(f"""{SCENES}, v AS (SELECT frame_id, idx, r / 255e0 AS v FROM px)
SELECT frame_id, idx, {s6(glow_r=_GLOW.format('1e0'), glow_g=_GLOW.format('35e-2'), glow_b=_GLOW.format('15e-2'),
  grain='CASE WHEN v <= 15e-2 THEN 8e-2 * (3e-1 + 7e-1 * v / 15e-2) WHEN v <= 5e-1 THEN 8e-2 WHEN v >= 85e-2 THEN 8e-2 * 2e-1 ELSE 8e-2 * (1 - 8e-1 * (v - 5e-1) / 35e-2) END')} FROM v""")
def film_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halation of light parts by channel, and the amplitude of grain by lightness."""
    v = F.col("r") / 255.0
    glow = [colour.halation(v, 0.7, channel=k).alias(f"glow_{k}") for k in "rgb"]
    return rounded(fixtures.scenes(spark, sf_dir).select("frame_id", "idx", *glow, colour.grain(v, 0.08).alias("grain")), "frame_id", "idx")


@query(f"""{SCENES} SELECT frame_id, idx, {s6(merged='r + (b - r) * (x * 8) / 255e0', layered='r / 255e0 + (b / 255e0 - r / 255e0) * (g / 255e0) * (1 - x / 32e0) * 65e-2')}, greatest(x * 8, g)::BIGINT AS either FROM px""")
def mask_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One picture over another through a mask, the stronger of two masks, and a look kept to its target and off what is protected."""
    share = lambda c: F.col(c) / 255.0
    mask = F.col("x") * 8
    layered = grade.local_compose(share("r"), share("b"), share("g"), F.col("x") / 32.0, 0.65)
    return rounded(fixtures.scenes(spark, sf_dir).select("frame_id", "idx", grade.merged(F.col("r"), F.col("b"), mask).alias("merged"), layered.alias("layered"), F.greatest(mask, "g").alias("either")), "frame_id", "idx")


@query(f"{SCENES} SELECT frame_id, idx, {s6(shaded='g / 255e0 * (1 - 15e-2 * least(1e0, sqrt(pow(x / 32e0 - 4e-1, 2) + pow(y / (h * 1e0) - 5e-1, 2)) / 7e-1))')} FROM px")
def radial_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame darkened away from a centre."""
    x, y = F.col("x") / 32.0, F.col("y") / (F.col("h") * 1.0)
    return rounded(fixtures.scenes(spark, sf_dir).select("frame_id", "idx", grade.radial(F.col("g") / 255.0, x, y, (0.4, 0.5), 0.7, 0.15).alias("shaded")), "frame_id", "idx")


_SHARE = "CASE WHEN color_tag = 0 THEN 0e0 ELSE pow((recipe_id % 101) / 100e0, 14e-1) END"


@query(f"""WITH {fixtures.RECIPES_SQL}, s AS (SELECT *, {_SHARE} AS share FROM recipes)
SELECT recipe_id, {s6(share='share', saturation='1 + (saturation - 1) * share', temperature='temperature * share', midpoint_ev='midpoint_ev * share', point_y='25e-2 + (31e-2 - 25e-2) * share')} FROM s""")
def strength_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe's parameters between neutral and its own, at a strength that the eye sees as
    even; a recipe of the foundation alone has no strength."""
    share = grade.strength_of(F.col("color_tag") == 0, (F.col("recipe_id") % 101) / 100.0, 1.4)
    rows = fixtures.recipes(spark, sf_dir).withColumn("share", share)
    own = [grade.towards(neutral, F.col(name), F.col("share")).alias(name) for name, neutral in (("saturation", 1.0), ("temperature", 0.0), ("midpoint_ev", 0.0))]
    return rounded(rows.select("recipe_id", "share", *own, grade.towards(0.25, F.lit(0.31), F.col("share")).alias("point_y")))


@query(f"WITH {fixtures.RECIPES_SQL} SELECT recipe_id, ('0x' || substr(sha256(media || '|' || tone_tag || '|' || color_tag), 1, 8))::BIGINT AS seed FROM recipes")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed from the parts that a choice depends on."""
    return fixtures.recipes(spark, sf_dir).select("recipe_id", records.stable_seed("media", "tone_tag", "color_tag").alias("seed"))
