"""Calibration of an unknown editor by charts: grey response, root polynomial, prediction, hold-out verdict.

A chart is a bounded group of patches. Its grey response is an array of points, its colour model 18
coefficients from 39 sums by a Cholesky factorisation in columns, so any number of charts is fitted in one
aggregate without a driver-side solve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tintmill.functions import colour

#: Least grey patches of a response, and least patches of a colour model.
LEAST_GREYS, LEAST_PATCHES = 5, 8
TERMS, RIDGE = 6, 1e-7
# The gate of the specification, and the stricter ones.
MEDIAN, P95, GREY, HUE, SKIN = 3.0, 6.0, 0.02, 4.0, 2.0


def grey_response(patches: DataFrame) -> DataFrame:
    """patches (chart, grp, r, g, b, mr, mg, mb; 0..255) to chart, response: points (x, y) of the grey patches in order of x,
    y never falling; null for fewer than LEAST_GREYS."""
    point = F.struct((F.col("r") / 255.0).alias("x"), ((F.col("mr") + F.col("mg") + F.col("mb")) / 3 / 255).alias("y"))
    own = F.sort_array(F.collect_list(F.when(F.col("grp") == "grayscale", point)))
    out = patches.groupBy("chart").agg(own.alias("points"))
    none = F.array().cast("array<struct<x: double, y: double>>")

    def rising(acc: Column, p: Column) -> Column:
        top = F.coalesce(F.element_at(acc, -1)["y"], F.lit(0.0))
        y = F.when(F.size(acc) > 0, F.greatest(top, F.round(p["y"], 6))).otherwise(F.round(p["y"], 6))
        return F.concat(acc, F.array(F.struct(F.round(p["x"], 6).alias("x"), y.alias("y"))))

    folded = F.aggregate("points", none, lambda acc, p: F.when(F.size(acc) > 0, rising(acc, p)).otherwise(F.array(F.struct(F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y")))))
    return out.select("chart", F.when(F.size("points") >= LEAST_GREYS, folded).alias("response"))


def toned(v: Column, response: Column) -> Column:
    """A response at v: straight lines between its points, its ends beyond them."""
    n = F.size(response)
    first, last = response[0], F.element_at(response, -1)

    def halved(reach: Column, _: Column) -> Column:
        middle = F.shiftright(reach["low"] + reach["high"], 1)
        below = v <= response[middle]["x"]
        return F.struct(F.when(below, reach["low"]).otherwise(F.least(middle + 1, reach["high"])).alias("low"), F.when(below, middle).otherwise(reach["high"]).alias("high"))

    # The first point from the second on whose x reaches v: points are in order, so each step halves where it may be.
    reach = F.struct(F.lit(1).alias("low"), (n - 1).alias("high"))
    at = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n))), reach, halved)["high"]

    def line(i: Column) -> Column:
        a, b = response[i - 1], response[i]
        span = b["x"] - a["x"]
        return a["y"] + (b["y"] - a["y"]) * F.when(span > 0, (v - a["x"]) / span).otherwise(0.0)

    found = F.transform(F.array(at), line)[0]
    return F.when(v <= first["x"], first["y"]).when(v >= last["x"], last["y"]).otherwise(found)


def tone_table(response: Column) -> Column:
    """A response at the 256 values of eight bits; null without a response."""
    return F.when(response.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: toned(k / 255.0, response)))


def terms(r: Column, g: Column, b: Column) -> list[Column]:
    """Terms that all scale with exposure: the channels, and the roots of their products."""
    root = lambda a, c: F.sqrt(F.greatest(F.lit(0.0), a * c))
    return [r, g, b, root(r, g), root(g, b), root(r, b)]


def root_polynomial(patches: DataFrame) -> DataFrame:
    """patches (chart, toned channels tr, tg, tb and measured yr, yg, yb, all 0..1) to chart, samples and
    coefficients c<channel><term>; null where there are too few."""
    rows = patches.select("chart", *[t.alias(f"t{k}") for k, t in enumerate(terms(*[F.col(f"t{c}") for c in "rgb"]))], *[F.col(f"y{c}").alias(f"y{k}") for k, c in enumerate("rgb")])
    pairs = [(i, j) for i in range(TERMS) for j in range(i, TERMS)]
    left = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"a{i}{j}") for i, j in pairs]
    right = [F.sum(F.col(f"t{i}") * F.col(f"y{k}")).alias(f"b{i}{k}") for i in range(TERMS) for k in range(3)]
    out = rows.groupBy("chart").agg(F.count(F.lit(1)).alias("samples"), *left, *right)
    # L: lower triangle of the sums' factor, a row at a time; the ridge keeps every root above zero.
    for i in range(TERMS):
        for j in range(i + 1):
            rest = F.col(f"a{j}{i}") + (RIDGE if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for k in range(3):
        for i in range(TERMS):
            rest = F.col(f"b{i}{k}")
            for j in range(i):
                rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}{k}")
            out = out.withColumn(f"z{i}{k}", rest / F.col(f"l{i}{i}"))
        for i in reversed(range(TERMS)):
            rest = F.col(f"z{i}{k}")
            for j in range(i + 1, TERMS):
                rest = rest - F.col(f"l{j}{i}") * F.col(f"c{k}{j}")
            out = out.withColumn(f"c{k}{i}", rest / F.col(f"l{i}{i}"))
    enough = F.col("samples") >= LEAST_PATCHES
    return out.select("chart", "samples", *[F.when(enough, F.round(f"c{k}{i}", 8)).alias(f"c{k}{i}") for k in range(3) for i in range(TERMS)])


def with_tone(patches: DataFrame, responses: DataFrame) -> DataFrame:
    """patches with t<channel>: their channels through their chart's response (charts without one have null).
    A response is worked out once a chart, at the values of eight bits; channels that are no whole numbers ask it each."""
    if not all(isinstance(patches.schema[c].dataType, IntegralType) for c in "rgb"):
        out = patches.join(responses, "chart")
        return out.withColumns({f"t{c}": toned(F.col(c) / 255.0, F.col("response")) for c in "rgb"}).drop("response")
    out = patches.join(responses.select("chart", tone_table(F.col("response")).alias("__tone")), "chart")
    return out.withColumns({f"t{c}": F.get("__tone", F.least(F.lit(255), F.greatest(F.lit(0), F.col(c).cast("int")))) for c in "rgb"}).drop("__tone")


def predicted(patches: DataFrame, models: DataFrame) -> DataFrame:
    """patches (with t<channel>) with pr, pg, pb: tone first, rounded to eight bits, then colour."""
    held = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v * 255)))
    out = patches.join(models.drop("samples"), "chart").withColumns({f"e{c}": held(F.col(f"t{c}")) / 255 for c in "rgb"})
    own = terms(*[F.col(f"e{c}") for c in "rgb"])
    channel = lambda k: held(sum((F.col(f"c{k}{i}") * t for i, t in enumerate(own)), F.lit(0.0))).cast("int")
    out = out.withColumns({f"p{c}": channel(k) for k, c in enumerate("rgb")})
    return out.drop(*[f"c{k}{i}" for k in range(3) for i in range(TERMS)], "er", "eg", "eb")


def compared(patches: DataFrame) -> DataFrame:
    """patches with de00 and hue_error between measured and predicted colours."""
    out = colour.with_lab(colour.with_lab(patches, "mr", "mg", "mb", out="m_"), "pr", "pg", "pb", out="p_")
    return colour.with_ciede2000(out, "m_", "p_", "de00").withColumn("hue_error", colour.hue_angle_error("m_", "p_"))


def verdicts(patches: DataFrame) -> DataFrame:
    """patches (of `compared`, held out) to a row for each chart: median, p95 (the value at place int(n * 0.95)), grey_rmse, hue_max, skin,
    status (heuristic, calibrated-provisional, calibrated) and failed gates, groups beyond the median's gate included."""
    grey, skin = F.col("grp") == "grayscale", F.col("grp") == "skin"
    gap = (F.col("mr") + F.col("mg") + F.col("mb") - F.col("pr") - F.col("pg") - F.col("pb")) / 3 / 255
    ordered = F.array_sort(F.collect_list("de00"))
    p95 = F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * 0.95).cast("int")))
    group = patches.groupBy("chart", "grp").agg(F.percentile("de00", 0.5).alias("own")).groupBy("chart")
    group = group.agg(F.sort_array(F.collect_list(F.when(F.col("own") > MEDIAN, F.col("grp")))).alias("weak"))
    out = patches.groupBy("chart").agg(
        F.count(F.lit(1)).alias("held_out"), F.percentile("de00", 0.5).alias("median"), p95.alias("p95"), F.coalesce(F.sqrt(F.avg(F.when(grey, gap * gap))), F.lit(0.0)).alias("grey_rmse"),
        F.max("hue_error").alias("hue_max"), F.percentile(F.when(skin, F.col("de00")), 0.5).alias("skin"),
    )
    out = out.join(group, "chart")
    gates = {"median": F.col("median") > MEDIAN, "p95": F.col("p95") > P95, "grey": F.col("grey_rmse") > GREY, "hue": F.col("hue_max") > HUE, "skin": F.coalesce(F.col("skin") > SKIN, F.lit(False))}
    failed = F.array_compact(F.array(*[F.when(c, n) for n, c in gates.items()]))
    status = F.when(gates["median"], "heuristic").when(F.size(failed) == 0, "calibrated").otherwise("calibrated-provisional")
    return out.withColumns({"failed": failed, "status": status})
