"""Samples of frames by area and in time, neighbourhoods by area, and polygons as masks.

A frame of any size becomes a bounded one here, before any window or exact percentile: each source pixel
adds to the cells that it covers, with the area that it shares with each, in one aggregate by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pixels of a diagnosed frame, about, and of a palette's; least side of either.
DIAGNOSED, PALETTE = (22_000, 24), (26_000, 16)
RADIUS = 1_000_000


def sampled_size(width: Column, height: Column, pixels: int, least: int) -> tuple[Column, Column]:
    """Sides of a sample of so many pixels that keeps the frame's shape, never larger than the frame."""
    scale = F.sqrt(F.lit(float(pixels)) / F.greatest(F.lit(1), width * height))
    side = lambda n: F.greatest(F.lit(least), F.least(n, F.rint(n * scale).cast("int"))).cast("int")
    return side(width), side(height)


def _cells(at: Column, source: Column, target: Column) -> Column:
    """The cells of one side that a pixel lies in, with the share of a cell's width that it fills."""
    begin, end = at * target / source, (at + 1) * target / source
    first, last = F.floor(begin).cast("int"), (F.ceil(end) - 1).cast("int")
    last = F.greatest(first, F.least(last, target - 1))
    # An end that lies on a border may be rounded beyond it: such a cell has no area and is left out.
    share = lambda k: F.least(end, k + 1.0) - F.greatest(begin, k.cast("double"))
    cells = F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("at"), share(k).alias("share")))
    return F.filter(cells, lambda c: c["share"] > 1e-9)


def area_scaled(px: DataFrame, width: Column, height: Column, to: tuple[Column, Column]) -> DataFrame:
    """px (frame_id, x, y, r, g, b: RGB before it is scaled) to a grid of to = (columns, rows): frame_id, idx, x, y, w, h,
    rounded r, g, b, and area (source pixels that a cell holds). Cells without a source pixel are missing."""
    rows = px.withColumns({"__w": to[0], "__h": to[1], "__sw": width, "__sh": height})
    rows = rows.withColumns({"__cx": _cells(F.col("x"), F.col("__sw"), F.col("__w")), "__cy": _cells(F.col("y"), F.col("__sh"), F.col("__h"))})
    rows = rows.select("frame_id", "__w", "__h", "__sw", "__sh", "r", "g", "b", "__cy", F.explode("__cx").alias("cx")).withColumn("cy", F.explode("__cy"))
    weight = F.col("cx.share") * F.col("cy.share")
    # To six decimals first: whether a mean is just a half must not depend on the order of a sum.
    mean = lambda c: F.rint(F.round(F.sum(F.col(c) * weight) / F.sum(weight), 6)).cast("int").alias(c)
    size = F.first("__sw") * F.first("__sh") / (F.first("__w") * F.first("__h"))
    cells = rows.groupBy("frame_id", F.col("cx.at").alias("x"), F.col("cy.at").alias("y")).agg(F.first("__w").alias("w"), F.first("__h").alias("h"), *[mean(c) for c in "rgb"], (F.sum(weight) * size).alias("area"))
    return cells.select("frame_id", (F.col("y") * F.col("w") + F.col("x")).alias("idx"), "x", "y", "w", "h", "r", "g", "b", "area")


def sample(px: DataFrame, width: Column, height: Column, pixels: int = DIAGNOSED[0], least: int = DIAGNOSED[1]) -> DataFrame:
    """Frames of any size as frames of about so many pixels."""
    return area_scaled(px, width, height, sampled_size(width, height, pixels, least))


def grid(px: DataFrame, width: Column, height: Column, columns: int, rows: int) -> DataFrame:
    """Frames as a fixed grid of area means."""
    return area_scaled(px, width, height, (F.lit(columns), F.lit(rows)))


def sampling_plan(clips: DataFrame) -> DataFrame:
    """clips (clip_id, media, duration in seconds) with frames, fps, covered, coverage: a clip gets more
    frames the longer it is, 8 to 90, and they cover all of it."""
    still = (F.col("media") == "photo") | (F.coalesce(F.col("duration"), F.lit(0.0)) <= 0)
    frames = F.greatest(F.lit(8), F.least(F.lit(90), F.floor(F.col("duration") / 30).cast("int") + 8))
    fps = F.greatest(F.lit(1e-4), F.least(F.lit(30.0), frames / F.col("duration")))
    covered = F.least(F.col("duration"), frames / fps)
    return clips.select(
        "*", F.when(still, 1).otherwise(frames).alias("frames"), F.when(~still, F.round(fps, 6)).alias("fps"),
        F.when(still, 0.0).otherwise(F.round(covered, 3)).alias("covered"), F.when(still, 1.0).otherwise(F.round(covered / F.col("duration"), 4)).alias("coverage"),
    )


def sampled_times(plan: DataFrame) -> DataFrame:
    """plan (of `sampling_plan`) to clip_id, n, seconds: the times that are looked at."""
    each = plan.select("clip_id", "duration", "frames", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("n"))
    return each.select("clip_id", "n", F.when(F.col("frames") == 1, 0.0).otherwise(F.col("n") * F.col("duration") / F.col("frames")).alias("seconds"))


def completed(px: DataFrame, width: int) -> DataFrame:
    """px (frame_id, idx, x, y, h, lum) with rows for what the last row of a frame lacks, their lum null."""
    short = px.groupBy("frame_id", "h").agg((F.max("idx") + 1).alias("n")).filter(F.col("n") < F.col("h") * width)
    more = short.withColumn("idx", F.explode(F.sequence("n", F.col("h") * width - 1)))
    more = more.select("frame_id", "idx", (F.col("idx") % width).alias("x"), F.expr(f"cast(idx div {width} as int)").alias("y"), "h")
    return px.unionByName(more, allowMissingColumns=True)


def neighbourhood_ev(px: DataFrame, width: Column, height: Column, chosen: Column) -> DataFrame:
    """frame_id, anchors, ev: the median of how many stops an anchor pixel lies above the mean of the square
    around it; px has frame_id, x, y, lum. The square's radius is a twentieth of the shorter side, 2 at least; at the frame's
    edges it is cut off. A pixel that a frame lacks is a row with a null lum (`completed`). Sums along rows, then along columns, over ranges that follow each frame's radius."""
    radius = F.greatest(F.lit(2), F.rint(F.least(width, height) * 0.05).cast("int"))
    rows = px.withColumns({"__radius": radius, "__chosen": chosen})
    # Places in millionths of the radius, rounded down: within a million of each other if no further apart than it.
    placed = lambda c: F.floor(F.col(c) * RADIUS / F.col("__radius"))
    rows = rows.withColumns({"__x": placed("x"), "__y": placed("y")})
    across = Window.partitionBy("frame_id", "y").orderBy("__x").rangeBetween(-RADIUS, RADIUS)
    down = Window.partitionBy("frame_id", "x").orderBy("__y").rangeBetween(-RADIUS, RADIUS)
    rows = rows.withColumns({"__s": F.sum("lum").over(across), "__n": F.count("lum").over(across)})
    rows = rows.withColumn("__mean", F.sum("__s").over(down) / F.sum("__n").over(down))
    stops = F.log2(F.greatest(F.col("lum"), F.lit(1e-6)) / F.greatest(F.col("__mean"), F.lit(1e-6)))
    return rows.groupBy("frame_id").agg(F.count_if("__chosen").alias("anchors"), F.percentile(F.when(F.col("__chosen"), stops), 0.5).alias("ev"))


def inside(x: Column, y: Column, points: Column) -> Column:
    """Whether (x, y) lies in the polygon of an array of points (x, y), by the even-odd rule; what lies on an
    edge is inside. Fewer than three points hold nothing."""
    n = F.size(points)

    def seen(e: Column) -> Column:
        a, b = e["a"], e["b"]
        # Twice the area of the triangle with the edge: its sign tells the side.
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        within = lambda v, p, q: (v >= F.least(p, q)) & (v <= F.greatest(p, q))
        near = within(x, a["x"], b["x"]) & within(y, a["y"], b["y"])
        return F.struct(turn.alias("turn"), near.alias("near"), ((a["y"] > y) != (b["y"] > y)).alias("spans"), (b["y"] > a["y"]).alias("up"))

    def step(acc: Column, s: Column) -> Column:
        crosses = s["spans"] & ((s["turn"] > 0) == s["up"]) & (s["turn"] != 0)
        return F.struct((acc["odd"] != crosses).alias("odd"), (acc["on"] | ((s["turn"] == 0) & s["near"])).alias("on"))

    # Each step is a list, so that what an edge gives is worked out once and not in each use.
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(points[k].alias("a"), points[(k + 1) % n].alias("b")))
    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))
    found = F.aggregate(F.transform(edges, seen), start, step)
    return F.when(n >= 3, found["odd"] | found["on"]).otherwise(False)


def between_keyframes(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """frames (clip_id, frame_no) with points: the polygon of the keyframe (clip_id, frame_no, points) at or before each, moved
    towards the next one by the share of the time passed; the last one stays. Both of a pair have equally many
    points, or the earlier one stays too. Frames before the first keyframe have none."""
    order = Window.partitionBy("clip_id").orderBy("frame_no")
    pairs = keys.withColumns({"to": F.lead("frame_no").over(order), "next": F.lead("points").over(order)})
    both = frames.withColumn("__key", F.lit(None).cast("struct<at:bigint,to:bigint,points:array<struct<x:double,y:double>>,next:array<struct<x:double,y:double>>>"))
    key = F.struct(F.col("frame_no").cast("long").alias("at"), F.col("to").cast("long").alias("to"), "points", "next")
    both = both.select("clip_id", "frame_no", F.lit(1).alias("kind"), "__key").unionByName(pairs.select("clip_id", "frame_no", F.lit(0).alias("kind"), key.alias("__key")))
    last = Window.partitionBy("clip_id").orderBy("frame_no", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("k", F.last("__key", ignorenulls=True).over(last)).filter("kind = 1")
    share = (F.col("frame_no") - F.col("k.at")) / (F.col("k.to") - F.col("k.at"))
    moved = F.zip_with("k.points", "k.next", lambda a, b: F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["y"] + (b["y"] - a["y"]) * share).alias("y")))
    still = F.col("k.next").isNull() | (F.size("k.next") != F.size("k.points"))
    return rows.select("clip_id", "frame_no", F.when(still, F.col("k.points")).otherwise(moved).alias("points"))
