"""Clips as sequences of frames: steps, transitions, cuts, shots and what is measured in them.

Input: clip_id, frame_no (gapless from 0 in a clip), luma. Everything is dealt by clip_id once; a clip
holds some thousand frames, so windows over a clip are bounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the segmentation.
SCALES_S = (0.4, 0.8, 1.4, 2.2)
LEAST_DIRECT, LEAST_COHERENCE, PEAK_SHARE, LEAST_RATIO = 0.08, 0.5, 0.5, 2.5
SCENE_STEP, FLASH_RETURN, REVIEW_BELOW, LEAST_SHOT_S = 0.10, 0.35, 0.60, 0.6
STEP_DELTA, FEWEST_STEPS, MOST_STEPS = 0.04, 6, 48
WHIP_DEPTH, WHIP_SHOULDER, FEWEST_NEAR = 0.45, 0.010, 8

# Weights of a shot's health, for blown and crushed pixels, tone span up to a most, distance of the median
# from a middle, black above and white beyond a bound, and seconds up to a most.
HEALTH_BLOWN, HEALTH_CRUSHED = 260.0, 90.0
HEALTH_SPAN, HEALTH_MIDDLE, HEALTH_BLACK, HEALTH_WHITE, HEALTH_LENGTH = (26.0, 0.75), (55.0, 0.22), (60.0, 0.05), (120.0, 0.97), (1.0, 8.0)

#: Steps on either side that a cut is compared with.
AROUND = 5


def clip_order() -> Window:
    return Window.partitionBy("clip_id").orderBy("frame_no")


def with_step(frames: DataFrame) -> DataFrame:
    """step: distance to the next frame; null for a clip's last."""
    return frames.withColumn("step", F.abs(F.lead("luma").over(clip_order()) - F.col("luma")))


def window_lengths(fps: float) -> list[int]:
    return sorted({max(3, round(fps * s)) for s in SCALES_S})


def gradual_windows(frames: DataFrame, fps: float) -> DataFrame:
    """Windows whose ends differ, with how straight the drift is; accepted: a gradual transition."""
    order = clip_order()
    rows = with_step(frames).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("clip_id")))
    measured = []
    for w in window_lengths(fps):
        inside, before, after = order.rowsBetween(0, w - 1), order.rowsBetween(-w, -1), order.rowsBetween(w, 2 * w - 1)
        median = lambda spec: F.percentile("step", 0.5).over(spec)
        names = {
            f"direct_{w}": F.abs(F.lead("luma", w).over(order) - F.col("luma")), f"travelled_{w}": F.sum("step").over(inside), f"peak_{w}": F.max("step").over(inside),
            f"inside_{w}": median(inside), f"base_{w}": F.least(median(before), median(after)),
        }
        rows = rows.withColumns(names)
        starts = (F.col("frame_no") % max(1, w // 3) == 0) & (F.col("frame_no") < F.col("n") - 1 - w)
        own = F.struct(F.lit(w).cast("long").alias("length"), *[F.col(n).alias(n.rsplit("_", 1)[0]) for n in names])
        measured.append(F.when(starts, own))
    seen = rows.select("clip_id", F.col("frame_no").alias("start"), F.explode(F.array_compact(F.array(*measured))).alias("m")).select("clip_id", "start", "m.*")
    seen = seen.filter((F.col("direct") >= LEAST_DIRECT) & (F.col("travelled") > 0) & F.col("base").isNotNull())
    straight = F.col("direct") / F.col("travelled")
    faster = (F.col("base") <= 0) | (F.col("inside") >= F.col("base") * LEAST_RATIO)
    return seen.withColumns({"coherence": straight, "accepted": (straight >= LEAST_COHERENCE) & (F.col("peak") < F.col("direct") * PEAK_SHARE) & faster})


def without_overlaps(windows: DataFrame) -> DataFrame:
    """Of windows of a clip that overlap, the straightest stay, then the shortest, then the earliest.

    A clip has some dozens of accepted windows, so its list is small; it is folded without Python.
    """
    key = F.struct((-F.col("coherence")).alias("bent"), "length", "start")
    lists = windows.groupBy("clip_id").agg(F.array_sort(F.collect_list(key)).alias("found"))

    def take(kept: Column, w: Column) -> Column:
        meets = F.exists(kept, lambda k: (w["start"] < k["start"] + k["length"]) & (k["start"] < w["start"] + w["length"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(w)))

    kept = F.aggregate("found", F.slice("found", 1, 0), take)
    rows = lists.select("clip_id", F.explode(kept).alias("w"))
    return rows.select("clip_id", "w.start", "w.length", (-F.col("w.bent")).alias("coherence"))


def expanded(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """Windows widened on either side while steps stay above twice that side's median, by two lengths at most.

    Each window meets its own few neighbouring steps by an equi-join; a side without steps is not widened.
    """
    steps = with_step(frames).filter(F.col("step").isNotNull()).select("clip_id", F.col("frame_no").alias("k"), "step")
    counts = steps.groupBy("clip_id").agg(F.count(F.lit(1)).alias("steps"))
    rows = windows.join(counts, "clip_id").withColumn("end", F.col("start") + F.col("length"))
    rows = rows.withColumns({"low": F.greatest(F.lit(0), F.col("start") - 2 * F.col("length")), "high": F.least("steps", F.col("end") + 2 * F.col("length"))})
    near = rows.withColumn("k", F.explode(F.sequence("low", "high"))).join(steps, ["clip_id", "k"], "left")
    k, d, w = F.col("k"), F.col("step"), F.col("length")
    own = ["clip_id", "start", "length", "end", "low", "high", "coherence"]
    left = F.when((k >= F.col("start") - w) & (k < F.col("start")), d)
    right = F.when((k >= F.col("end")) & (k < F.col("end") + w), d)
    step = F.struct(k.alias("k"), d.alias("d"))
    sums = near.groupBy(*own).agg(
        (F.percentile(left, 0.5) * 2).alias("left_floor"), (F.percentile(right, 0.5) * 2).alias("right_floor"),
        F.collect_list(F.when(k < F.col("start"), step)).alias("before"), F.collect_list(F.when((k >= F.col("end")) & (k < F.col("high")), step)).alias("after"),
    )
    calm_before = F.array_max(F.transform(F.filter("before", lambda s: s["d"] <= F.col("left_floor")), lambda s: s["k"] + 1))
    calm_after = F.array_min(F.transform(F.filter("after", lambda s: s["d"] <= F.col("right_floor")), lambda s: s["k"]))
    start = F.when(F.col("left_floor").isNull(), F.col("start")).otherwise(F.coalesce(calm_before, "low"))
    end = F.when(F.col("right_floor").isNull(), F.col("end")).otherwise(F.coalesce(calm_after, "high"))
    return sums.select("clip_id", F.col("start").alias("found_start"), F.col("end").alias("found_end"), start.alias("start"), end.alias("end"), "coherence")


def _middle(values: Column) -> Column:
    """Median of a sorted array without nulls."""
    n = F.size(values)
    return F.when(n == 0, 0.0).otherwise((F.get(values, ((n - 1) / 2).cast("int")) + F.get(values, (n / 2).cast("int"))) / 2)


def boundaries(frames: DataFrame) -> DataFrame:
    """clip_id, frame_no (first frame after the cut; a flash: of its start), kind, confidence.

    A step is a boundary if it is large and the largest (of equals the first) among its neighbours; it
    is a flash if the picture soon returns to what it was, seen from either edge.
    """
    order = clip_order()
    rows = with_step(frames)
    near = [f("step", k).over(order) for f in (F.lag, F.lead) for k in range(1, AROUND + 1)]
    rows = rows.withColumn("near", F.sort_array(F.array_compact(F.array(*near))))
    earlier = F.coalesce(F.max("step").over(order.rowsBetween(-AROUND, -1)), F.lit(-1.0))
    later = F.coalesce(F.max("step").over(order.rowsBetween(1, AROUND)), F.lit(-1.0))
    back = F.col("step") * FLASH_RETURN
    luma_at = {k: (F.lag("luma", -k) if k < 0 else F.lead("luma", k)).over(order) for k in range(-4, 5)}
    rises = F.lit(False)
    for k in (1, 2, 3):
        rises = rises | F.coalesce(F.abs(luma_at[-1] - luma_at[1 + k]) < back, F.lit(False))
    falls = F.coalesce(*[F.when(F.abs(luma_at[-1 - k] - luma_at[1]) < back, F.lit(k)) for k in (1, 2, 3)])
    rows = rows.withColumns({"earlier": earlier, "later": later, "rises": rises, "falls": falls})
    rows = rows.filter((F.col("step") >= SCENE_STEP) & (F.col("step") > F.col("earlier")) & (F.col("step") >= F.col("later")))
    flash = F.col("rises") | F.col("falls").isNotNull()
    at = F.when(F.col("rises") | F.col("falls").isNull(), F.col("frame_no")).otherwise(F.col("frame_no") - 1 - F.col("falls"))
    sure = F.least(F.col("step") / (F.col("step") + _middle(F.col("near")) * 3), F.lit(0.99))
    return rows.select("clip_id", (at + 1).cast("long").alias("frame_no"), F.when(flash, "flash").otherwise("hard_cut").alias("kind"), F.round(sure, 6).alias("confidence"))


def _keep_surer(gap: int):
    def fold(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_no", "confidence", "kind"], kind="stable")
        kept: list[int] = []
        at, sure = rows["frame_no"].tolist(), rows["confidence"].tolist()
        for k in range(len(rows)):
            if kept and at[k] - at[kept[-1]] < gap:
                if sure[k] > sure[kept[-1]]:
                    kept[-1] = k
                continue
            kept.append(k)
        return rows.iloc[kept]

    return fold


def whip_pans(cuts: DataFrame, frames: DataFrame, around: int) -> DataFrame:
    """Hard cuts with shoulder, trough and depth of the detail about them; suspected: detail sinks at the cut alone.

    frames: clip_id, frame_no, detail. Each cut meets the `around` frames on either side by an equi-join.
    """
    hard = cuts.filter("kind = 'hard_cut'").select("clip_id", (F.col("frame_no") - 1).alias("peak"))
    near = hard.withColumn("frame_no", F.explode(F.sequence(F.col("peak") - around, F.col("peak") + around)))
    near = near.join(frames.select("clip_id", "frame_no", "detail"), ["clip_id", "frame_no"])
    off, detail = F.col("frame_no") - F.col("peak"), F.col("detail")
    sides = near.groupBy("clip_id", "peak").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(off < -1, detail)), F.lit(0.0)).alias("left"), F.coalesce(F.max(F.when(off >= 2, detail)), F.lit(0.0)).alias("right"),
        F.min(F.when(off.between(-2, 3), detail)).alias("trough"),
    )
    shoulder = F.least("left", "right")
    depth = F.when(shoulder > 0, 1 - F.col("trough") / shoulder).otherwise(0.0)
    rows = sides.select("clip_id", (F.col("peak") + 1).alias("frame_no"), "n", shoulder.alias("shoulder"), "trough", depth.alias("depth"))
    return rows.withColumn("suspected", (F.col("n") >= FEWEST_NEAR) & (F.col("depth") >= WHIP_DEPTH) & (F.col("shoulder") >= WHIP_SHOULDER))


def over_time(frames: DataFrame, measures: list[str]) -> DataFrame:
    """A clip's mean and spread of each measure, and its largest change from one frame to the next."""
    order = clip_order()
    rows = frames.withColumns({"jump_" + m: F.abs(F.col(m) - F.lag(m).over(order)) for m in measures})
    kinds = [(F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}"), F.coalesce(F.max(f"jump_{m}"), F.lit(0.0)).alias(f"jump_{m}")) for m in measures]
    return rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), *[c for k in kinds for c in k])


def deduplicated(found: DataFrame, fps: float) -> DataFrame:
    """Boundaries closer than the shortest shot: the surer one stays; each is held against the last kept."""
    return found.groupBy("clip_id").applyInPandas(_keep_surer(round(LEAST_SHOT_S * fps)), found.schema)


def shots(cuts: DataFrame, lengths: DataFrame, fps: float) -> DataFrame:
    """clip_id, shot, start, end (exclusive), ends_with. lengths: clip_id, n. Flashes do not end a shot;
    a piece under half the shortest shot is no shot, unless it ends the clip."""
    ends = cuts.filter("kind <> 'flash'").select("clip_id", F.col("frame_no").alias("end"), F.col("kind").alias("ends_with"))
    ends = ends.unionByName(lengths.select("clip_id", F.col("n").alias("end"), F.lit("end-of-file").alias("ends_with")))
    order = Window.partitionBy("clip_id").orderBy("end", F.col("ends_with") == "end-of-file")
    pieces = ends.withColumn("start", F.lag("end", 1, 0).over(order))
    pieces = pieces.filter((F.col("ends_with") == "end-of-file") | (F.col("end") - F.col("start") >= LEAST_SHOT_S * fps / 2))
    return pieces.select("clip_id", (F.row_number().over(order) - 1).cast("long").alias("shot"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "ends_with")


def with_shot(frames: DataFrame, found: DataFrame) -> DataFrame:
    """Frames beside their shot: each start is met once and carried on, so work grows with frames alone."""
    marks = found.select("clip_id", F.col("start").alias("frame_no"), F.struct("shot", "end").alias("mark")).filter("mark.end > frame_no")
    rows = frames.join(marks, ["clip_id", "frame_no"], "left")
    rows = rows.withColumn("mark", F.last("mark", ignorenulls=True).over(clip_order().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("frame_no") < F.col("mark.end")).withColumn("shot", F.col("mark.shot")).drop("mark")


def representatives(rows: DataFrame) -> DataFrame:
    """The frame nearest the upper median of its shot; of equals the first."""
    one = Window.partitionBy("clip_id", "shot")
    rows = rows.withColumns({"rank": F.row_number().over(one.orderBy("luma", "frame_no")) - 1, "n": F.count(F.lit(1)).over(one)})
    rows = rows.withColumn("middle", F.max(F.when(F.col("rank") == F.expr("n div 2"), F.col("luma"))).over(one))
    near = F.min(F.struct(F.abs(F.col("luma") - F.col("middle")).alias("gap"), "frame_no"))
    return rows.groupBy("clip_id", "shot").agg(F.max("middle").alias("middle"), near["frame_no"].alias("representative"))


def dissolve_steps(first: list[Column], second: list[Column]) -> Column:
    """How many steps a dissolve between two grades needs, from the parameter that moves most."""
    worst = F.greatest(*[F.abs(b - a) for a, b in zip(first, second)])
    return F.least(F.greatest(F.ceil(F.round(worst / STEP_DELTA, 6)), F.lit(FEWEST_STEPS)), F.lit(MOST_STEPS)).cast("long")


def off_beat(pts: Column, frame_no: Column, fps: int, timescale: int) -> Column:
    """Time stamp over half a tick from where the frame rate puts it, in whole numbers of 64 bits."""
    pts, frame_no = pts.cast("long"), frame_no.cast("long")
    return F.abs(pts * fps - frame_no * timescale) * 2 > fps


def health(span: Column, p01: Column, p50: Column, p99: Column, blown: Column, crushed: Column, seconds: Column) -> Column:
    """Score of a shot as the one that others are matched to."""
    beyond = lambda v, limit: F.greatest(F.lit(0.0), v - limit)
    (per_span, most_span), (per_gap, middle), (per_black, black), (per_white, white), (per_second, most_seconds) = HEALTH_SPAN, HEALTH_MIDDLE, HEALTH_BLACK, HEALTH_WHITE, HEALTH_LENGTH
    lost = blown * HEALTH_BLOWN + crushed * HEALTH_CRUSHED + F.abs(p50 - middle) * per_gap + beyond(p01, black) * per_black + beyond(p99, white) * per_white
    return F.least(span, F.lit(most_span)) * per_span + F.least(seconds, F.lit(most_seconds)) * per_second - lost


def alike(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b, F.lit(1e-6))


def differences(mine: str, anchor: str) -> Column:
    """Names of the statistics in which a shot is too far from its anchor to be matched."""
    m, a = (lambda n: F.col(f"{mine}.{n}")), (lambda n: F.col(f"{anchor}.{n}"))
    tests = {"chromatic_pixel_ratio": F.abs(m("chromatic_pixel_ratio") - a("chromatic_pixel_ratio")) > 0.30}
    tests |= {n: alike(m(n), a(n)) < least for n, least in (("colorfulness", 0.65), ("tone_span", 0.45), ("local_contrast_region", 0.45))}
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()])), ",")
