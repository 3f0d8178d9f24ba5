"""The foundation of a frame: what its own statistics ask for before any look, and whether that worked.

A frame's tone curve is planned by row, as an array of points; its cubic pieces and a table of its 256
values are columns too, so a picture is graded by looking its channels up. Nothing is worked out on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintmill.functions import colour
from tintmill.operators.grade import clamped

# Fixed values of the plan: the tone span under which a frame is flat; bounds of the corrections.
FLAT, LEAST_STRUCTURE, GAP, LEAST_SLOPE, MOST_SLOPE = 0.42, 0.04, 0.05, 0.15, 4.0
MOST_WARM, MOST_TINT, MOST_SATURATION = 0.06, 0.025, 1.28
#: Saturation grows in the middle tones alone; highlights lose some afterwards.
BELL = [(0.0, 0.0), (0.12, 0.0), (0.24, 1.0), (0.58, 1.0), (0.76, 0.0), (1.0, 0.0)]
HIGHLIGHTS, HIGHLIGHT_SATURATION = [(0.0, 0.0), (0.68, 0.0), (0.84, 1.0), (1.0, 1.0)], 0.72
POINT = "array<struct<x: double, y: double>>"


def _held(v: Column, low, high) -> Column:
    to = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.greatest(to(low), F.least(to(high), v))


def _point(x, y) -> Column:
    to = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(to(x).alias("x"), to(y).alias("y"))


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once for a row, wherever the body names it."""
    return F.transform(F.array(value), body)[0]


def _safe(points: Column) -> Column:
    """Points in order, without those too near to the last one that was taken; slopes held within bounds."""
    none = F.array().cast(POINT)

    def held(last: Column, x: Column, y: Column) -> Column:
        gap, rest = x - last["x"], F.lit(1.0) - x
        rising = F.when(last.isNotNull(), F.least(F.greatest(last["y"] + gap * LEAST_SLOPE, y), last["y"] + gap * MOST_SLOPE)).otherwise(y)
        ending = lambda v: F.when(x < 1, F.least(F.greatest(F.lit(1.0) - rest * MOST_SLOPE, v), F.lit(1.0) - rest * LEAST_SLOPE)).otherwise(v)
        return F.round(F.least(F.lit(1.0), _let(rising, ending)), 6)

    def take(acc: Column, p: Column) -> Column:
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1))
        near = lambda s: F.coalesce(s["x"] - s["last"]["x"] < GAP, F.lit(False))
        added = lambda s: F.concat(acc, F.array(_point(s["x"], held(s["last"], s["x"], s["y"]))))
        state = F.struct(last.alias("last"), F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))
        return _let(state, lambda s: F.when(near(s), acc).otherwise(added(s)))

    def closed(taken: Column) -> Column:
        left = F.lit(1.0) - F.element_at(taken, -1)["x"]
        kept = F.when(left < GAP, F.slice(taken, F.lit(1), F.size(taken) - 1)).otherwise(taken)
        return F.when(left > 0, F.concat(kept, F.array(_point(1.0, 1.0)))).otherwise(taken)

    return _let(F.aggregate(points, none, take), closed)


def with_plan(stats: DataFrame) -> DataFrame:
    """stats (of `diagnosis.statistics`) with points, tone_mode; temperature, tint, neutral_mode; saturation, colour_mode; axes."""
    out, low = stats, F.lit(0.0)
    for name, before in (("p01", None), ("p05", "q01"), ("p50", "q05"), ("p95", "q50"), ("p99", "q95")):
        least = F.col(before) + 1e-6 if before else low
        out = out.withColumn("q" + name[1:], F.greatest(least, F.least(F.lit(1.0), F.greatest(low, F.col(name)))))
    q = {k: F.col(f"q{k}") for k in ("01", "05", "50", "95", "99")}
    flat, raised = F.col("tone_span") < FLAT, (q["01"] > 0.04) & (q["50"] < 0.65) & (q["95"] < 0.90)
    least_gain = F.greatest(F.lit(0.03), (q["95"] - q["05"]) * 0.10)
    # Two steps of eight bits above the aim, so that rounding on the way cannot miss it.
    aim = colour.decode(F.rint(F.least(F.lit(1.0), colour.encode(q["95"] + least_gain) + 2 / 255) * 255) / 255.0)
    out = out.withColumn("__gain", F.when(flat, F.greatest(least_gain, aim - q["95"])).otherwise(0.0))
    gain = F.col("__gain")
    to = {
        "01": F.when(raised, F.greatest(F.lit(0.06), q["01"] - F.least(F.lit(0.04), (q["01"] - 0.04) * 0.40))).otherwise(q["01"]),
        "05": F.when(raised, F.greatest(F.lit(0.11), q["05"] - F.least(F.lit(0.035), (q["05"] - 0.05) * 0.20))).otherwise(q["05"]),
        "50": F.when(flat & (q["50"] < 0.24), F.greatest(q["50"], F.least(F.lit(0.24), q["50"] * 1.20))).otherwise(q["50"]),
        "95": F.when(flat, F.greatest(q["95"], F.least(F.lit(0.68), q["95"] + gain))).otherwise(q["95"]),
        "99": F.when(flat, F.greatest(q["99"], F.least(F.lit(0.82), q["99"] + gain * 1.5))).otherwise(q["99"]),
    }
    inner = [_point(colour.encode(q[k]), colour.encode(to[k])) for k in ("01", "05", "50", "95")]
    raw = F.array(_point(0.0, 0.0), *inner, _point(0.90, F.greatest(F.lit(0.90), colour.encode(to["99"]))), _point(1.0, 1.0))
    mode = F.when(q["95"] - q["05"] < LEAST_STRUCTURE, "degenerate").when(~flat & ~raised, "healthy").otherwise("five zones")
    out = out.withColumns({"tone_mode": mode, "__raw": raw})
    identity = F.array(_point(0.0, 0.0), _point(1.0, 1.0))
    out = out.withColumn("points", F.when(F.col("tone_mode") == "five zones", _safe(F.col("__raw"))).otherwise(identity))
    share, vivid, chromatic = F.col("neutral_sample_count") / F.col("n"), F.col("colorfulness"), F.col("chromatic_pixel_ratio")
    narrative = ((vivid >= 0.16) & (chromatic >= 0.40)) | ((vivid >= 0.12) & (chromatic >= 0.65))
    reliable = (share >= 0.02) & (F.col("cast_magnitude") >= 0.006) & ~narrative
    pale = (vivid < 0.08) & (chromatic < 0.20)
    aim_vivid = F.greatest(vivid + 0.01, vivid * 1.20)
    out = out.withColumns({
        "neutral_mode": F.when(reliable, "limited").when(narrative, "narrative").otherwise("unreliable"),
        "temperature": F.when(reliable, F.round(_held(F.col("cast_b") * -3.5, -MOST_WARM, MOST_WARM), 6)).otherwise(0.0),
        "tint": F.when(reliable, F.round(_held(F.col("cast_a") * -2.5, -MOST_TINT, MOST_TINT), 6)).otherwise(0.0),
        "colour_mode": F.when(pale, "midtones").otherwise("preserve"),
        "saturation": F.when(pale, F.round(_held(aim_vivid / F.greatest(vivid, F.lit(0.02)), 1.0, MOST_SATURATION), 6)).otherwise(1.0),
    })
    axes = F.array(F.when(F.col("tone_mode") == "five zones", "tone_span"), F.when(pale, "colorfulness"), F.when(reliable, "neutral_cast"))
    return out.withColumn("axes", F.array_compact(axes)).drop(*[f"q{k}" for k in q], "__gain", "__raw")


def pieces(points: Column) -> Column:
    """Monotone cubic pieces through an array of points: array of x0, x1, c0..c3, by the same rule as `colour.pchip`."""

    def steps(pts: Column) -> Column:
        one = lambda k: F.struct((pts[k + 1]["x"] - pts[k]["x"]).alias("h"), ((pts[k + 1]["y"] - pts[k]["y"]) / (pts[k + 1]["x"] - pts[k]["x"])).alias("d"))
        return F.transform(F.sequence(F.lit(0), F.size(pts) - 2), one)

    def end(near: Column, far: Column) -> Column:
        slope = ((near["h"] * 2 + far["h"]) * near["d"] - near["h"] * far["d"]) / (near["h"] + far["h"])
        held = lambda v: F.when(v * near["d"] <= 0, 0.0).when((near["d"] * far["d"] <= 0) & (F.abs(v) > F.abs(near["d"]) * 3), near["d"] * 3).otherwise(v)
        return _let(slope, held)

    def slopes(own: Column) -> Column:
        n = F.size(own)

        def one(k: Column) -> Column:
            a, b = F.get(own, k - 1), F.get(own, k)
            w0, w1 = b["h"] * 2 + a["h"], b["h"] + a["h"] * 2
            inner = F.when(a["d"] * b["d"] > 0, (w0 + w1) / (w0 / a["d"] + w1 / b["d"])).otherwise(0.0)
            return F.when(n == 1, own[0]["d"]).when(k == 0, end(own[0], F.get(own, F.lit(1)))).when(k == n, end(F.get(own, n - 1), F.get(own, n - 2))).otherwise(inner)

        return F.transform(F.sequence(F.lit(0), n), one)

    def piece(pts: Column, own: Column, m: Column, k: Column) -> Column:
        h, d, m0, m1 = own[k]["h"], own[k]["d"], m[k], m[k + 1]
        names = {"x0": pts[k]["x"], "x1": pts[k + 1]["x"], "c0": pts[k]["y"], "c1": m0, "c2": (d * 3 - m0 * 2 - m1) / h, "c3": (m0 + m1 - d * 2) / (h * h)}
        return F.struct(*[v.alias(name) for name, v in names.items()])

    every = lambda pts, own, m: F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: piece(pts, own, m, k))
    return _let(points, lambda pts: _let(steps(pts), lambda own: _let(slopes(own), lambda m: every(pts, own, m))))


def curve_table(points: Column) -> Column:
    """A curve's 256 values (0..1), one for each encoded level."""

    def value(own: Column, v: Column) -> Column:
        at = lambda p: _let(v - p["x0"], lambda t: clamped(((t * p["c3"] + p["c2"]) * t + p["c1"]) * t + p["c0"]))
        return _let(F.filter(own, lambda p: v <= p["x1"])[0], at)

    return _let(pieces(points), lambda own: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda level: value(own, level / 255.0)))


def with_table(plans: DataFrame) -> DataFrame:
    return plans.withColumn("table", curve_table(F.col("points")))


def _saturated(cs: list[Column], s: Column) -> list[Column]:
    grey = colour.combined(colour.LUMINANCE["srgb"], *cs)
    return [clamped(grey + (c - grey) * s) for c in cs]


def applied(px: DataFrame, plans: DataFrame) -> DataFrame:
    """px with eight-bit out_r, out_g, out_b after its frame's plan: curve, saturation of the middle tones, neutral
    gains, and highlights drawn to white where colour was touched."""
    plan = with_table(plans).select("frame_id", "table", "temperature", "tint", "saturation")
    out = px.join(plan, "frame_id").withColumns({f"__{c}": F.element_at("table", F.col(c) + 1) for c in "rgb"}).drop("table")
    names = [f"__{c}" for c in "rgb"]
    step = lambda df, of: df.withColumns(dict(zip(names, of([F.col(n) for n in names]))))
    luma = lambda: colour.combined(colour.LUMINANCE["srgb"], *[F.col(n) for n in names])
    out = out.withColumn("__mask", F.when(F.col("saturation") > 1, colour.curve(luma(), BELL)).otherwise(0.0))
    out = step(out, lambda cs: [c + (s - c) * F.col("__mask") for c, s in zip(cs, _saturated(cs, F.col("saturation")))])
    gains = [F.col("temperature") * 0.6 + 1.0, F.lit(1.0) - F.col("tint") * 0.35, F.lit(1.0) - F.col("temperature") * 0.6]
    out = step(out, lambda cs: [clamped(c * F.round(g, 6)) for c, g in zip(cs, gains)])
    touched = (F.col("saturation") > 1) | (F.col("temperature") != 0) | (F.col("tint") != 0)
    out = out.withColumn("__mask", F.when(touched, colour.curve(luma(), HIGHLIGHTS)).otherwise(0.0))
    out = step(out, lambda cs: [c + (s - c) * F.col("__mask") for c, s in zip(cs, _saturated(cs, F.lit(HIGHLIGHT_SATURATION)))])
    whole = {f"out_{c}": F.rint(F.col(f"__{c}") * 255).cast("int") for c in "rgb"}
    return out.withColumns(whole).drop(*names, "__mask", "temperature", "tint", "saturation")


def readiness(before: DataFrame, after: DataFrame) -> DataFrame:
    """before (`with_plan`) and after (`diagnosis.statistics` of the applied picture) to status and failed checks:
    each asked axis must have moved far enough, and nothing else may have got worse."""
    own = ("tone_span", "colorfulness", "local_contrast_region", "cast_magnitude")
    both = before.join(after.select("frame_id", *[F.col(c).alias("after_" + c) for c in own]), "frame_id")
    asked = lambda axis: F.array_contains("axes", axis)
    span, vivid, local, cast = (F.col(c) for c in own)
    low_span = (span < FLAT) & asked("tone_span")
    low_vivid = asked("colorfulness") & (vivid < 0.08) & (F.col("chromatic_pixel_ratio") < 0.20)
    least_vivid = F.when(low_vivid, vivid + F.greatest(F.lit(0.01), vivid * 0.20)).otherwise(vivid * 0.90)
    both = both.withColumns({
        "least_span": F.when(low_span, span + F.greatest(F.lit(0.03), span * 0.10)).otherwise(span * 0.90), "least_vivid": least_vivid,
        "most_vivid": F.when(low_vivid, F.greatest(least_vivid + 0.015, vivid * 1.50)).otherwise(vivid * 1.15 + 0.01),
        "least_local": local - F.greatest(F.lit(0.002), local * 0.10), "most_cast": cast + 0.002,
    })
    now = {c: F.col("after_" + c) for c in own}
    failed = {
        "tone_span": asked("tone_span") & (now["tone_span"] < F.col("least_span")), "colorfulness": ~now["colorfulness"].between(F.col("least_vivid"), F.col("most_vivid")),
        "local_contrast": now["local_contrast_region"] < F.col("least_local"), "neutral_cast": now["cast_magnitude"] > F.col("most_cast"),
    }
    names = F.array_compact(F.array(*[F.when(c, n) for n, c in failed.items()]))
    names = F.when(F.size("axes") == 0, F.array().cast("array<string>")).otherwise(names)
    status = F.when(F.size("axes") == 0, "not required").when(F.size(names) > 0, "blocked").otherwise("passed")
    return both.withColumns({"failures": names, "status": status})


def highlight_policy(px: DataFrame, coloured: Column) -> DataFrame:
    """frame_id, mode, mask_start, mask_full, coverage: from which encoded luma highlights are drawn to
    white, and the share of pixels beyond it. coloured: the style keeps its highlights' colour; a hue gate stands
    in for the mask, and nothing is covered. Exact percentiles of a frame: it is bounded (sampled)."""
    luma = colour.luma(F.col("r"), F.col("g"), F.col("b"))
    own = px.select("frame_id", luma.alias("luma")).groupBy("frame_id").agg(F.percentile("luma", F.array(F.lit(0.75), F.lit(0.95))).alias("p"), F.collect_list("luma").alias("lumas"))
    start = _held(F.col("p")[0], 0.0, 0.94)
    full = F.greatest(start + 0.02, F.least(F.lit(0.99), F.col("p")[1]))
    beyond = F.size(F.filter("lumas", lambda v: v > F.round(start, 6))) / F.size("lumas")
    none = F.lit(None).cast("double")
    return own.select(
        "frame_id", F.when(coloured, "coloured highlight").otherwise("path to white").alias("mode"), F.when(coloured, none).otherwise(F.round(start, 6)).alias("mask_start"),
        F.when(coloured, none).otherwise(F.round(full, 6)).alias("mask_full"), F.when(coloured, none).otherwise(F.round(beyond, 6)).alias("coverage"),
    )
