"""Mask proxies: pixels get the role of the first rule that they meet. Rules are a table of data.

Rules speak of r, g, b (eight bits), luma and chroma (encoded, 0..1) and v (row / last row), as SQL
conditions, so that a rule table can also come from a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintmill.functions import colour

# Bounds of each proxy's classes, in the order in which they are tried.
RULES: dict[str, list[tuple[str, str]]] = {
    "deep_sea": [
        ("anchor", "(luma >= 0.10 AND r - g >= 35 AND r - b >= 25) OR (luma >= 0.48 AND r >= g AND g >= b AND r - b >= 10) OR (luma >= 0.72 AND chroma <= 0.10)"),
        ("environment", "luma BETWEEN 0.055 AND 0.68 AND (b - r >= 4 OR chroma <= 0.12)"),
    ],
    "blue_hour": [
        ("anchor", "(v >= 0.25 AND luma BETWEEN 0.25 AND 0.98 AND r - g >= 14 AND r - b >= 28) OR (v >= 0.45 AND luma >= 0.72 AND chroma <= 0.09)"),
        ("top", "v < 0.30 AND luma BETWEEN 0.055 AND 0.92 AND (b - r >= 6 OR chroma <= 0.18)"),
        ("middle", "v >= 0.30 AND v < 0.58 AND luma BETWEEN 0.055 AND 0.92 AND (b - r >= 6 OR chroma <= 0.18)"),
        ("horizon", "v >= 0.58 AND v < 0.78 AND luma BETWEEN 0.055 AND 0.92 AND (b - r >= 6 OR chroma <= 0.18)"),
    ],
    "sunset": [
        ("protect", "luma <= 0.055 OR (luma >= 0.84 AND chroma <= 0.075)"),
        ("warm", "v <= 0.78 AND luma BETWEEN 0.12 AND 0.84 AND chroma >= 0.075 AND r - b >= 18 AND r - g >= 6 AND g - b >= 6"),
        ("cool", "v <= 0.82 AND luma BETWEEN 0.075 AND 0.80 AND b - r >= 8 AND b - g >= 2"),
    ],
    "food": [
        ("protect", "(luma >= 0.68 AND chroma <= 0.11) OR luma <= 0.055 OR (luma BETWEEN 0.18 AND 0.92 AND r > g AND g > b AND r - g BETWEEN 5 AND 55 AND g - b BETWEEN 3 AND 45 AND chroma BETWEEN 0.06 AND 0.30)"),
        ("food", "(luma BETWEEN 0.08 AND 0.90 AND chroma >= 0.12 AND g - r >= 6 AND g - b >= 3) OR (luma BETWEEN 0.08 AND 0.92 AND chroma >= 0.16 AND r - g >= 22 AND r - b >= 28) OR (luma BETWEEN 0.12 AND 0.94 AND chroma >= 0.15 AND r >= g AND g >= b AND r - b >= 30 AND g - b >= 20)"),
        ("environment", "luma > 0.075 AND luma < 0.94"),
    ],
    "warm_cozy": [
        ("protect", "luma <= 0.045 OR (luma >= 0.68 AND chroma <= 0.10)"),
        ("warm", "luma BETWEEN 0.10 AND 0.86 AND chroma >= 0.105 AND r - b >= 60 AND r - g >= 5 AND g - b >= 8"),
        ("cool", "luma BETWEEN 0.06 AND 0.82 AND chroma >= 0.045 AND b - r >= 10 AND b - g >= 2"),
    ],
    "landscape": [
        ("protect", "luma <= 0.09 OR (luma >= 0.72 AND chroma <= 0.10)"),
        ("green", "luma BETWEEN 0.04 AND 0.62 AND chroma >= 0.025 AND g - r >= 3 AND g - b >= 1"),
        ("cool", "luma BETWEEN 0.04 AND 0.66 AND chroma >= 0.02 AND b - r >= 3"),
        ("earth", "luma BETWEEN 0.04 AND 0.66 AND chroma >= 0.025 AND r - b >= 5 AND g >= b"),
        ("detail", "TRUE"),
    ],
    "rainy": [
        ("warm", "luma BETWEEN 0.25 AND 0.98 AND r - g >= 12 AND r - b >= 30"),
        ("seed", "v >= 0.45 AND luma BETWEEN 0.12 AND 0.90 AND (((g + b) / 2.0 - r >= 8 AND chroma >= 0.05) OR (luma >= 0.55 AND chroma <= 0.08))"),
        ("road", "v >= 0.45 AND luma BETWEEN 0.08 AND 0.90"),
    ],
}
LEAST_SEEDS = 0.002


def measured(px: DataFrame) -> DataFrame:
    """px with luma, chroma (span) and v."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return px.withColumns({"luma": colour.luma(r, g, b), "chroma": colour.span(r, g, b), "v": F.col("y") / F.greatest(F.lit(1), F.col("h") - 1)})


def case(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN '{role}'" for role, condition in rules) + " END"


def assign(px: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds role, null where no rule is met."""
    return measured(px).withColumn("role", F.expr(case(rules)))


def summary(px: DataFrame, *keys: str) -> DataFrame:
    """Of each region: pixels, luma, chroma, warmth and density (chroma in the dark counts more)."""
    return px.groupBy("frame_id", *keys).agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("luma").alias("luma"), F.avg("chroma").alias("chroma"),
        F.avg((F.col("r") - F.col("b")) / 255.0).alias("warmth"), F.avg(F.col("chroma") * (F.lit(1.0) - F.col("luma"))).alias("density"),
    )


def wet_surfaces(px: DataFrame, least: float = LEAST_SEEDS) -> DataFrame:
    """Rainy streets: all road pixels of a frame are wet if reflections cover enough of it, else none.
    The verdict of a frame is one row and joins its pixels by frame."""
    rows = assign(px, RULES["rainy"])
    verdict = rows.groupBy("frame_id").agg(F.avg((F.coalesce("role", F.lit("")) == "seed").cast("double")).alias("seed_coverage"))
    joined = rows.join(verdict, "frame_id")
    wet = F.coalesce(F.col("role").isin("seed", "road"), F.lit(False)) & (F.col("seed_coverage") >= least)
    return joined.withColumn("role", F.when(wet, "wet").when(F.col("role") == "warm", "warm"))


def neutral_white(luma: Column, chroma: Column) -> tuple[Column, Column]:
    """Hard mask, and soft weight 0..1."""
    soft = colour.smoothstep(luma, 0.56, 0.68) * (F.lit(1.0) - colour.smoothstep(chroma, 0.11, 0.17))
    return (luma >= 0.68) & (chroma <= 0.11), soft


def overlap(first: Column, second: Column) -> Column:
    """Intersection over union of two masks in an aggregate; 0 where both are empty."""
    both, either = F.count_if(first & second), F.count_if(first | second)
    return F.when(either > 0, both / either).otherwise(0.0)
