"""Neighbourhoods and places in a frame, skin before and after a grade, and colour fits by moments.

Everything about a frame is dealt by frame_id once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintmill.functions import colour
from tintmill.operators.diagnosis import dealt
from tintmill.operators.records import nearest_rank

# Bounds of the checks.
CORE_SHARE, LEAST_AREA, MOST_AREA, LEAST_CONTRAST = 0.92, 0.0008, 0.35, 1.6
NEAR, FAR, LEAST_FALL, LEAST_EACH = 0.35, 0.75, 0.004, 20
CORRIDOR, LEAST_SKIN, MOST_SHIFT, MOST_RETREAT, CHROMA_GAIN = (30.0, 50.0), 12, 3.0, 2.0, 1.1


def _across() -> Window:
    return Window.partitionBy("frame_id", "y").orderBy("x")


def _down() -> Window:
    return Window.partitionBy("frame_id", "x").orderBy("y")


def edge_energy(rows: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """Mean difference to the left and to the upper neighbour."""
    rows = dealt(rows, parts).withColumns({"h_step": F.abs(F.col(value) - F.lag(value).over(_across())), "v_step": F.abs(F.col(value) - F.lag(value).over(_down()))})
    return rows.groupBy("frame_id").agg(F.avg("h_step").alias("horizontal"), F.avg("v_step").alias("vertical"))


def eroded(rows: DataFrame, mask: str, radius: int, parts: int | None = None) -> DataFrame:
    """mask (boolean) shrunk: true where it holds within radius, rows first, then columns; the window shrinks at the edges."""
    kept = F.min(mask).over(_across().rowsBetween(-radius, radius))
    rows = dealt(rows, parts).withColumn(mask, kept)
    return rows.withColumn(mask, F.min(mask).over(_down().rowsBetween(-radius, radius)))


def light_core(rows: DataFrame) -> DataFrame:
    """The brightest part of a frame, its weighted centre and radius; found only if small and bright enough. rows: lum, u, v."""
    frame = Window.partitionBy("frame_id")
    rows = rows.withColumn("core", F.col("lum") >= F.max("lum").over(frame) * CORE_SHARE)
    weight = F.when(F.col("core"), F.col("lum")).otherwise(0.0)
    rows = rows.withColumns({"cx": F.sum(F.col("u") * weight).over(frame) / F.sum(weight).over(frame), "cy": F.sum(F.col("v") * weight).over(frame) / F.sum(weight).over(frame)})
    away = F.when(F.col("core"), F.hypot(F.col("u") - F.col("cx"), F.col("v") - F.col("cy")))
    inside, outside = F.avg(F.when(F.col("core"), F.col("lum"))), F.avg(F.when(~F.col("core"), F.col("lum")))
    out = rows.groupBy("frame_id").agg(F.avg(F.col("core").cast("double")).alias("area"), F.coalesce(F.try_divide(inside, outside), F.lit(0.0)).alias("contrast"), F.max("cx").alias("cx"), F.max("cy").alias("cy"), F.percentile(away, 0.9).alias("radius"))
    return out.withColumn("found", F.col("area").between(LEAST_AREA, MOST_AREA) & (F.col("contrast") >= LEAST_CONTRAST))


def light_source(rows: DataFrame) -> DataFrame:
    """A frame's light in encoded luma: bright against the middle value of the frame, small, and not a mere speck.

    rows: frame_id, luma (0 to 1), u, v. The radius is the distance at place int(n * 0.9) in the core, 0.02 at least.
    A frame is bounded, so its values may be listed.
    """
    frame = rows.groupBy("frame_id").agg(F.max("luma").alias("peak"), nearest_rank(F.col("luma"), 0.5).alias("middle"), F.count(F.lit(1)).alias("n"))
    core = rows.join(frame, "frame_id").filter(F.col("luma") >= F.col("peak") * CORE_SHARE)
    weight, total = F.col("luma"), F.sum("luma")
    centre = core.groupBy("frame_id", "peak", "middle", "n").agg(
        F.count(F.lit(1)).alias("inside"), F.avg("luma").alias("mean"), F.try_divide(F.sum(F.col("u") * weight), total).alias("cx"), F.try_divide(F.sum(F.col("v") * weight), total).alias("cy"),
        F.collect_list(F.struct("u", "v")).alias("places"),
    )
    away = F.array_sort(F.transform("places", lambda p: F.hypot(p["u"] - F.col("cx"), p["v"] - F.col("cy"))))
    radius = F.greatest(F.get(away, F.floor(F.size("places") * 0.9).cast("int")), F.lit(0.02))
    out = centre.select("frame_id", (F.col("inside") / F.col("n")).alias("area"), (F.col("mean") / F.greatest(F.lit(1e-6), "middle")).alias("contrast"), "peak", "cx", "cy", radius.alias("radius"))
    return out.withColumn("found", F.col("area").between(LEAST_AREA, MOST_AREA) & (F.col("contrast") >= LEAST_CONTRAST))


def warm_falloff(rows: DataFrame) -> DataFrame:
    """Warmth added near the centre less that added far off. rows: warmer, away. Null where too few pixels say anything."""
    near, far = F.col("away") < NEAR, F.col("away") > FAR
    out = rows.groupBy("frame_id").agg(F.count_if(near).alias("near"), F.count_if(far).alias("far"), (F.avg(F.when(near, F.col("warmer"))) - F.avg(F.when(far, F.col("warmer")))).alias("fall"))
    enough = (F.col("near") >= LEAST_EACH) & (F.col("far") >= LEAST_EACH)
    return out.withColumns({"fall": F.when(enough, F.col("fall")), "passed": F.when(enough, F.col("fall") > LEAST_FALL)})


def outside_corridor(hue: Column) -> Column:
    """Degrees between a hue and the nearer end of the corridor of skin; 0 inside."""
    ends = F.least(*[colour.hue_distance(hue, F.lit(end)) for end in CORRIDOR])
    return F.when(hue.between(*CORRIDOR), 0.0).otherwise(ends)


def skin_verdict(rows: DataFrame) -> DataFrame:
    """rows: hue and chroma of skin pixels (null: no skin), before_ and after_. Inside the corridor before: inside it
    after; else a small shift, hardly further off. Under 12 pixels: skipped, which is not passed."""
    median = lambda c: F.percentile(c, 0.5).alias(c)
    s = rows.groupBy("frame_id").agg(F.count("before_hue").alias("samples"), *[median(c) for c in ("before_hue", "after_hue", "before_chroma", "after_chroma")]).filter("samples > 0")
    s = s.withColumns({"was": outside_corridor(F.col("before_hue")), "is": outside_corridor(F.col("after_hue")), "shift": colour.hue_distance(F.col("before_hue"), F.col("after_hue"))})
    astray = F.when(F.col("was") == 0, F.col("is") > 0).otherwise((F.col("shift") > MOST_SHIFT) | (F.col("is") > F.col("was") + MOST_RETREAT))
    garish = F.col("after_chroma") > F.col("before_chroma") * CHROMA_GAIN
    return s.withColumn("passed", F.when(F.col("samples") >= LEAST_SKIN, ~astray & ~garish))


def moments(rows: DataFrame, group: str) -> DataFrame:
    """The 15 sums of a least-squares fit of y = M x, one pass with partial sums. rows: x0..x2, y0..y2."""
    x, y = [f"x{k}" for k in range(3)], [f"y{k}" for k in range(3)]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for k, a in enumerate(x) for b in x[k:]] + [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in x for b in y]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), *sums)


def determinant(m) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solved(sums: DataFrame, group: str) -> DataFrame:
    """m<row><column> of the fitted matrix by Cramer's rule; null where the colours do not span space."""
    left = [[F.col(f"x{min(j, k)}x{max(j, k)}") for k in range(3)] for j in range(3)]
    sums = sums.withColumn("det", determinant(left))
    out = {}
    for row in range(3):
        right = [F.col(f"x{j}y{row}") for j in range(3)]
        for column in range(3):
            put = [[right[j] if k == column else left[j][k] for k in range(3)] for j in range(3)]
            out[f"m{row}{column}"] = F.when(F.abs("det") > 1e-9, determinant(put) / F.col("det"))
    return sums.select(group, "samples", *[c.alias(n) for n, c in out.items()])
