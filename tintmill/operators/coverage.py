"""Masks and clips over time: active areas, mask statistics, gaps, release weights, shot profiles, light fall-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the measurements.
ACTIVE_ROW_MIN_LUMA = 0.012
HARD, SOFT, JUMP, GRID = 200, 60, 90, 48
LUMA = {"r": 0.2126, "g": 0.7152, "b": 0.0722}


def active_rows(pixels: DataFrame, width: int) -> DataFrame:
    """frame_id, first_row, end_row (exclusive): rows between dark bars; a frame that is all dark keeps every row.

    A row is judged by the mean luma of every max(1, width // 64)-th pixel.
    """
    luma = sum(F.col(c) * w for c, w in LUMA.items()) / 255.0
    rows = pixels.filter(F.col("x") % max(1, width // 64) == 0).groupBy("frame_id", "y").agg(F.avg(luma).alias("luma"))
    lit = F.when(F.col("luma") >= ACTIVE_ROW_MIN_LUMA, F.col("y"))
    frame = rows.groupBy("frame_id").agg(F.min(lit).alias("first"), F.max(lit).alias("last"), F.max("y").alias("bottom"))
    return frame.select("frame_id", F.coalesce("first", F.lit(0)).cast("long").alias("first_row"), (F.coalesce("last", "bottom") + 1).cast("long").alias("end_row"))


def mask_stats(masks: DataFrame, width: int, grid: int = GRID) -> DataFrame:
    """frame_id, coverage, soft_edge_ratio, boundary_activity, mean over a lattice of about grid x grid.

    masks: frame_id, x, y, h, value (0 to 255). Activity: jumps over 90 from one lattice row to the next.
    """
    down = F.greatest(F.lit(1), F.floor(F.col("h") / grid))
    lattice = masks.filter((F.col("x") % max(1, width // grid) == 0) & (F.col("y") % down == 0))
    above = F.lag("value").over(Window.partitionBy("frame_id", "x").orderBy("y"))
    rows = lattice.select("frame_id", "value", (F.abs(F.col("value") - above) > JUMP).alias("jump"))
    v, n = F.col("value"), F.count(F.lit(1))
    return rows.groupBy("frame_id").agg(
        (F.count_if(v >= HARD) / n).alias("coverage"),
        (F.count_if((v >= SOFT) & (v < HARD)) / n).alias("soft_edge_ratio"),
        (F.count_if("jump") / n).alias("boundary_activity"),
        (F.avg(v) / 255.0).alias("mean"),
    )


def edge_ratio(*channels: str) -> Column:
    """Aggregate: the share of values at 0 or 255 over all channels."""
    at_edge = [F.count_if(F.col(c).isin(0, 255)) for c in channels]
    return sum(at_edge[1:], at_edge[0]) / (F.count(F.lit(1)) * len(channels))


def isolated_gaps(frames: DataFrame) -> DataFrame:
    """clip_id, frame_no of frames without a detection between the first and the last that have one.

    Bounds are an aggregate of one row a clip, so a long clip is not held in one window.
    """
    seen = frames.filter("detected").groupBy("clip_id").agg(F.min("frame_no").alias("first"), F.max("frame_no").alias("last"))
    missing = frames.filter(~F.coalesce("detected", F.lit(False))).join(seen, "clip_id")
    return missing.filter(F.col("frame_no").between(F.col("first"), F.col("last"))).select("clip_id", "frame_no")


def checked_releases(segments: DataFrame, clips: DataFrame, fps: float) -> DataFrame:
    """Segments with `valid`: at least a second of holding back before and of release within, transitions of at
    least half a second that fit twice, inside the clip and after the segment before it."""
    second, half = round(fps), fps * 0.5
    start, end, ramp = (F.col(c) for c in ("start_frame", "end_frame", "transition_frames"))
    before = F.coalesce(F.lag("end_frame").over(Window.partitionBy("clip_id").orderBy("start_frame", "end_frame")), F.lit(-1))
    length = end - start + 1
    held = (start > before) & (start >= second) & (end < F.col("frames")) & (length >= second) & (ramp >= half) & (ramp * 2 <= length)
    return segments.join(clips, "clip_id").withColumn("valid", F.coalesce(held, F.lit(False))).drop("frames")


def release_weights(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """clip_id, frame_no, weight: a smooth rise to 1 and fall to 0 in each segment, 0 outside.

    segments: clip_id, start_frame, end_frame, transition_frames, which do not overlap.
    """
    inside = segments.withColumn("frame_no", F.explode(F.sequence("start_frame", "end_frame")))
    at, ramp = F.col("frame_no"), F.col("transition_frames")
    x = F.least(F.lit(1.0), (at - F.col("start_frame") + 1) / ramp, (F.col("end_frame") - at + 1) / ramp)
    weights = inside.select("clip_id", "frame_no", x.alias("x")).select("clip_id", "frame_no", (F.col("x") * F.col("x") * (3 - 2 * F.col("x"))).alias("weight"))
    return frames.select("clip_id", "frame_no").join(weights, ["clip_id", "frame_no"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def shot_profile(samples: DataFrame, measures: list[str]) -> DataFrame:
    """Means of a shot's samples; casts are averaged as vectors, so that opposite ones cancel.

    samples: clip_id, shot, cast_magnitude, cast_hue (degrees) and the measures.
    """
    turn = F.radians("cast_hue")
    rows = samples.groupBy("clip_id", "shot").agg(
        F.count(F.lit(1)).alias("samples"), *[F.avg(m).alias(m) for m in measures],
        F.avg(F.col("cast_magnitude") * F.cos(turn)).alias("cast_a"), F.avg(F.col("cast_magnitude") * F.sin(turn)).alias("cast_b"),
    )
    return rows.withColumns({"cast_magnitude": F.hypot("cast_a", "cast_b"), "cast_hue": F.pmod(F.degrees(F.atan2("cast_b", "cast_a")), F.lit(360.0))})


def rising(measured: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """Whether a value grows strictly with every level; one level alone does, a missing value does not."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(level))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(level)) == 1
    grows = F.when(first, F.col(value).isNotNull()).otherwise(F.coalesce(F.col(value) > before, F.lit(False)))
    return measured.withColumn("__grows", grows).groupBy(*keys).agg(F.count(F.lit(1)).alias("levels"), F.every("__grows").alias("strictly_rising"))


def forced_rising(table: DataFrame, key: str, x: str, value: str) -> DataFrame:
    """A look-up table whose value never falls: each point gets the highest so far. Some hundred points a key."""
    so_far = Window.partitionBy(key).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("monotone", F.max(value).over(so_far))


def remapped(value: Column, kind: str) -> Column:
    """A mask's byte stretched for use as a weight. The three affine maps."""
    maps = {"lift": (value - 16) * 3, "gain": value * 1.5, "invert": (F.lit(140) - value) * 2}
    return F.least(F.greatest(maps[kind].cast("double"), F.lit(0.0)), F.lit(255.0))


def warmed(u: Column, v: Column, centre: tuple[Column, Column], core: Column, warmth: float, reach: float = 2.5) -> dict[str, Column]:
    """r, g, b (0 to 255) near a light at `centre`, u and v being a pixel's place from 0 to 1; nothing beyond its reach."""
    away = F.least(F.lit(1.0), F.hypot(u - centre[0], v - centre[1]) / F.greatest(F.lit(0.05), core * reach))
    warm = (F.lit(1.0) - away) * warmth
    gains = {"r": warm + 1, "g": warm * 0.35 + 1, "b": F.lit(1.0) - warm * 0.55}
    return {c: F.least(F.greatest(F.col(c) * gain, F.lit(0.0)), F.lit(255.0)) for c, gain in gains.items()}
