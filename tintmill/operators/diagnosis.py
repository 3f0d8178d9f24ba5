"""Diagnosis of frames: one wide aggregate for each question, a row for each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintmill.functions import colour, labels

CHROMATIC, NEAR_NEUTRAL = 0.028, 0.055


def luminance(profile: str = "srgb", lin: str = "lin_") -> Column:
    return colour.combined(colour.LUMINANCE[colour.profile_of(profile)], *[F.col(lin + k) for k in "rgb"])


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def tone(px: DataFrame, profile: str = "srgb") -> DataFrame:
    """Percentiles of linear luminance, clip ratios by channel and by luminance, classes, headroom."""
    rows = colour.with_linear(px).withColumn("lum", luminance(profile))
    return _tone_done(rows.groupBy("frame_id").agg(*_tone_sums()))


def _tone_sums() -> list[Column]:
    low, high = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    return [
        F.percentile("lum", F.array(*[F.lit(p) for p in (0.01, 0.05, 0.5, 0.75, 0.95, 0.99)])).alias("p"),
        share(low <= 1).alias("shadow_clip_ratio"), share(high >= 254).alias("highlight_clip_ratio"), share(F.col("lum") <= 0.004).alias("luma_crushed_ratio"), share(F.col("lum") >= 0.99).alias("luma_blown_ratio"),
    ]


def _tone_done(out: DataFrame) -> DataFrame:
    return out.select("*", *[F.col("p")[k].alias(n) for k, n in enumerate(("p01", "p05", "p50", "p75", "p95", "p99"))]).drop("p").withColumn("tone_span", F.col("p95") - F.col("p05"))


def colour_stats(px: DataFrame, profile: str = "srgb") -> DataFrame:
    """Colourfulness, mean chroma, chromatic share, cast of near-neutral pixels where there are enough."""
    rows = colour.with_oklab(px, profile=profile).withColumn("chroma", colour.chroma(F.col("ok_a"), F.col("ok_b")))
    return _colour_done(rows.groupBy("frame_id").agg(*_colour_sums()))


def _colour_sums() -> list[Column]:
    rg, yb = (F.col("r") - F.col("g")) / 255.0, ((F.col("r") + F.col("g")) / 2 - F.col("b")) / 255.0
    near = F.col("chroma") < NEAR_NEUTRAL
    return [
        F.count(F.lit(1)).alias("n"), F.stddev_pop(rg).alias("rg_s"), F.stddev_pop(yb).alias("yb_s"), F.avg(rg).alias("rg_m"), F.avg(yb).alias("yb_m"),
        F.avg("chroma").alias("mean_chroma_oklab"), share(F.col("chroma") >= CHROMATIC).alias("chromatic_pixel_ratio"),
        F.count_if(near).alias("neutral_sample_count"), F.avg(F.when(near, F.col("ok_a"))).alias("a"), F.avg(F.when(near, F.col("ok_b"))).alias("b"),
    ]


def _colour_done(sums: DataFrame) -> DataFrame:
    enough = F.col("neutral_sample_count") >= F.greatest(F.lit(40.0), F.col("n") * 0.02)
    sums = sums.withColumns({"cast_a": F.when(enough, F.col("a")).otherwise(0.0), "cast_b": F.when(enough, F.col("b")).otherwise(0.0)})
    sums = sums.withColumn("colorfulness", F.hypot("rg_s", "yb_s") + F.hypot("rg_m", "yb_m") * 0.3)
    sums = sums.withColumns({"cast_magnitude": F.hypot("cast_a", "cast_b"), "cast_hue": F.when(enough, colour.hue(F.col("cast_a"), F.col("cast_b"))).otherwise(0.0)})
    return sums.drop("rg_s", "yb_s", "rg_m", "yb_m", "a", "b")


def hue_histogram(px: DataFrame, top: int = 3, bins: int = 36) -> DataFrame:
    """Each frame's strongest hue bins by summed chroma, with share and family; ties go to the lower bin. Grey pixels are
    left out inside the sum: Spark would copy the whole conversion into a filter."""
    width = 360 // bins
    rows = colour.with_oklab(px).withColumn("chroma", colour.chroma(F.col("ok_a"), F.col("ok_b")))
    rows = rows.select("frame_id", (F.floor(colour.hue(F.col("ok_a"), F.col("ok_b")) / width) % bins).cast("int").alias("bin"), F.when(F.col("chroma") >= CHROMATIC, F.col("chroma")).alias("chroma"))
    sums = rows.groupBy("frame_id", "bin").agg(F.sum("chroma").alias("weight")).filter("weight is not null")
    frame = Window.partitionBy("frame_id")
    ranked = sums.withColumns({"share": F.col("weight") / F.sum("weight").over(frame), "rank": F.row_number().over(frame.orderBy(F.desc(F.round("weight", 9)), "bin"))})
    return ranked.filter(F.col("rank") <= top).select("frame_id", "rank", (F.col("bin") * width + width // 2).alias("hue_center"), "share", labels.hue_family(F.col("bin") * width + width // 2).alias("family"))


def space(px: DataFrame, width: int = 32, profile: str = "srgb") -> DataFrame:
    """Centroid of luminance, centre less edge, top and bottom third (by pixels in row order)."""
    rows = colour.with_linear(px).withColumn("lum", luminance(profile))
    rows = rows.withColumns({"u": F.col("x") / F.lit(float(width)), "v": F.col("y") / F.col("h"), "n": F.col("h") * width})
    centre = (F.col("u") >= 0.25) & (F.col("u") < 0.75) & (F.col("v") >= 0.2) & (F.col("v") < 0.8)
    mean = lambda c: F.avg(F.when(c, F.col("lum")))
    weighted = lambda place, size: F.sum(F.col("lum") * (place / F.greatest(F.lit(1), size - 1))) / F.sum("lum")
    return rows.groupBy("frame_id").agg(
        weighted(F.col("x"), F.lit(width)).alias("luma_centroid_x"), weighted(F.col("y"), F.col("h")).alias("luma_centroid_y"), (mean(centre) - mean(~centre)).alias("center_minus_edge"),
        mean(F.col("idx") < F.floor(F.col("n") / 3)).alias("top_third_luma"), mean(F.col("idx") >= F.floor(F.col("n") * 2 / 3)).alias("bottom_third_luma"),
    )


def box_blur(df: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Mean over a square whose sides shrink at the frame's edges: along rows, then along columns."""
    across = Window.partitionBy("frame_id", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("frame_id", "x").orderBy("y").rowsBetween(-radius, radius)
    return df.withColumn("__h", F.avg(value).over(across)).withColumn(out, F.avg("__h").over(down)).drop("__h")


def dealt(px: DataFrame, parts: int | None) -> DataFrame:
    """px dealt out by frame; to `parts` partitions where given (nothing moves if px already is)."""
    return px.repartition("frame_id") if parts is None else px.repartition(parts, "frame_id")


def texture(px: DataFrame, profile: str = "srgb", parts: int | None = None) -> DataFrame:
    """Local contrast at three scales and noise in flat areas. All rows of a frame are dealt once, by
    frame; every window of the frame works inside that partitioning."""
    rows = dealt(colour.with_linear(px).select("frame_id", "x", "y", luminance(profile).alias("lum")), parts)
    for radius in (1, 4, 12):
        rows = box_blur(rows, "lum", radius, f"b{radius}")
    return rows.groupBy("frame_id").agg(*_texture_sums())


def _texture_sums() -> list[Column]:
    away = lambda r: F.abs(F.col("lum") - F.col(f"b{r}"))
    return [
        F.avg(away(1)).alias("local_contrast_texture"), F.avg(away(4)).alias("local_contrast_modeling"), F.avg(away(12)).alias("local_contrast_region"),
        F.coalesce(F.avg(F.when(F.abs(F.col("b1") - F.col("b4")) < 0.01, away(1))), F.lit(0.0)).alias("noise_estimate"),
    ]


def statistics(px: DataFrame, profile: str = "srgb", parts: int | None = None) -> DataFrame:
    """Tone, colour and texture of each frame in one pass: all sums stand in one aggregate, so there is
    one exchange, by frame, and no join."""
    rows = dealt(px.select("frame_id", "x", "y", "r", "g", "b"), parts)
    rows = colour.with_linear(rows).withColumn("lum", luminance(profile)).drop("lin_r", "lin_g", "lin_b")
    for radius in (1, 4, 12):
        rows = box_blur(rows, "lum", radius, f"b{radius}")
    rows = colour.with_oklab(rows, profile=profile).withColumn("chroma", colour.chroma(F.col("ok_a"), F.col("ok_b")))
    return _colour_done(_tone_done(rows.groupBy("frame_id").agg(*_tone_sums(), *_colour_sums(), *_texture_sums())))


# Bounds of a frame whose technique already looks finished.
POLISHED = {"p01": (None, 0.04), "p50": (0.08, 0.62), "tone_span": (0.35, 0.75), "colorfulness": (0.16, None), "chromatic_pixel_ratio": (0.65, None), "local_contrast_modeling": (0.025, 0.06), "noise_estimate": (None, 0.0045)}


def already_polished(stats: DataFrame) -> DataFrame:
    """frame_id, failed_checks, candidate: a conjunction of nine checks over tone, colour and texture."""
    within = lambda c, low, high: (F.col(c) >= low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True))
    coherent = (F.col("chromatic_pixel_ratio") >= 0.85) & (F.col("colorfulness") >= 0.16)
    names = ("black_point", "exposure", "tone_span", "colorfulness", "chromatic_coverage", "local_contrast", "clean_texture")
    checks = {n: within(c, *POLISHED[c]) for n, c in zip(names, POLISHED)}
    checks["white_balance_or_coherent_palette"] = (F.col("cast_magnitude") <= 0.03) | coherent
    checks["luma_clipping"] = (F.col("luma_blown_ratio") <= 0.01) & (F.col("luma_crushed_ratio") <= 0.01)
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return stats.select("frame_id", F.array_join(failed, ",").alias("failed_checks"), (F.size(failed) == 0).alias("candidate"))


NIGHT_P95, DAY_P95, LEAST_CONFIDENCE = 0.37, 0.40, 0.25


def light_fact(stats: DataFrame, label: Column | None = None, confidence: Column | None = None) -> DataFrame:
    """Adds state, value, not_night: measured pixels veto labels, they do not vote with them."""
    label = F.lit(None).cast("string") if label is None else label
    sure = F.coalesce(confidence, F.lit(0.0)) >= LEAST_CONFIDENCE if confidence is not None else F.lit(False)
    dark, bright = F.col("p95") <= NIGHT_P95, F.col("p95") >= DAY_P95
    is_ = lambda name: sure & F.coalesce(label == name, F.lit(False))
    against = is_("night") & bright & (F.col("p50") >= 0.09)
    value = F.when(dark, "night").when(is_("day") & bright, "day").when(against, None).when(is_("indoor"), "indoor")
    state = F.when(dark | (is_("day") & bright), "known").when(against, "conflicting").when(is_("indoor"), "known").otherwise("unknown")
    return stats.withColumns({"state": state, "value": value, "not_night": F.when(state == "unknown", bright)})
