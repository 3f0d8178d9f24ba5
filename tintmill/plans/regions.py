"""Queries over grades and regions: the grade chain, its gates, masks and what they measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.functions import colour
from tintmill.operators import grade, regions
from tintmill.operators.records import nearest_rank
from tintmill.plans import sql
from tintmill.plans.frames import r6, rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures

LOOK = grade.Look(brightness=0.02, contrast=1.08, gamma=1.05, saturation=1.2, temperature=0.1, tint=0.05, points=((0.0, 0.0), (0.25, 0.22), (0.5, 0.52), (0.75, 0.8), (1.0, 1.0)))
STRENGTH = 0.55


def _clamp(v: str) -> str:
    return f"least(greatest({v}, 0e0), 1e0)"


def _curve(v: str, points) -> str:
    v = f"least(greatest({v}, {sql.num(points[0][0])}), {sql.num(points[-1][0])})"
    cubic = lambda x0, c0, c1, c2, c3: f"(({sql.num(c3)} * ({v} - {sql.num(x0)}) + {sql.num(c2)}) * ({v} - {sql.num(x0)}) + {sql.num(c1)}) * ({v} - {sql.num(x0)}) + {sql.num(c0)}"
    return _clamp("CASE " + " ".join(f"WHEN {v} <= {sql.num(x1)} THEN {cubic(x0, *c)}" for x0, x1, *c in colour.pchip(list(points))) + f" ELSE {sql.num(points[-1][1])} END")


def _chain(look: grade.Look, strength: float, source: str = "px") -> str:
    """CTEs from source to graded, which adds out_r, out_g, out_b."""
    sat = lambda s: [_clamp(sql.dot(row, "r0", "g0", "b0")) for row in colour.equal_luma_matrix(s)]
    names = ("r0", "g0", "b0")
    put = lambda values: "* REPLACE (" + ", ".join(f"{v} AS {n}" for v, n in zip(values, names)) + ")"
    tone = lambda n: f"pow({_clamp(f'({n} - 5e-1) * {sql.num(look.contrast)} + 5e-1 + {sql.num(look.brightness)}')}, {sql.num(1 / look.gamma)})"
    steps = [[tone(n) for n in names], sat(look.saturation), [_curve(n, look.points) for n in names], [_clamp(f"{n} * {sql.num(g)}") for n, g in zip(names, look.gains())]]
    out = [f"k0 AS (SELECT *, r / 255e0 AS r0, g / 255e0 AS g0, b / 255e0 AS b0 FROM {source})"]
    for k, values in enumerate(steps):
        out.append(f"k{k + 1} AS (SELECT {put(values)} FROM k{k})")
    out.append(f"k5 AS (SELECT *, {_curve(sql.dot(colour.LUMINANCE['srgb'], *names), look.mask_points())} AS mask FROM k4)")
    out.append(f"k6 AS (SELECT {put([f'{n} + ({p} - {n}) * mask' for n, p in zip(names, sat(look.pull()))])} FROM k5)")
    mixed = ", ".join(f"CAST(round_even(({k} / 255e0 * {sql.num(1 - strength)} + {n} * {sql.num(strength)}) * 255, 0) AS BIGINT) AS out_{k}" for k, n in zip("rgb", names))
    out.append(f"graded AS (SELECT *, {mixed} FROM k6)")
    return ", ".join(out)


GRADED = f"WITH {fixtures.SCENES_SQL}, {_chain(LOOK, STRENGTH)}"


def graded(spark: SparkSession, sf_dir: str, strength: float = STRENGTH) -> DataFrame:
    return grade.with_grade(fixtures.scenes(spark, sf_dir), LOOK, strength)


@query(f"""{GRADED} SELECT frame_id, {s6(mean_r='avg(out_r)', mean_g='avg(out_g)', mean_b='avg(out_b)', moved='avg(abs(out_r - r) + abs(out_g - g) + abs(out_b - b))')} FROM graded GROUP BY frame_id""")
def grade_eq_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from tone to strength, summed up by frame."""
    away = sum((F.abs(F.col("out_" + k) - F.col(k)) for k in "rgb"), F.lit(0))
    return rounded(graded(spark, sf_dir).groupBy("frame_id").agg(*[F.avg("out_" + k).alias("mean_" + k) for k in "rgb"], F.avg(away).alias("moved")))


@query(f"""WITH {fixtures.PIXELS_SQL}, {_chain(grade.Look(saturation=1.4), 1.0)} SELECT frame_id, count(*) FILTER (WHERE r = g AND g = b) AS neutrals, count(*) FILTER (WHERE r = g AND g = b AND NOT (abs(out_r - out_g) <= 0 AND abs(out_g - out_b) <= 0)) AS tinted, {s6(mean_r='avg(out_r)')} FROM graded GROUP BY frame_id""")
def sat_matrix_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More saturation leaves neutral pixels neutral."""
    rows = grade.with_grade(fixtures.pixels(spark, sf_dir), grade.Look(saturation=1.4))
    grey = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    same = (F.col("out_r") == F.col("out_g")) & (F.col("out_g") == F.col("out_b"))
    return rounded(rows.groupBy("frame_id").agg(F.count_if(grey).alias("neutrals"), F.count_if(grey & ~same).alias("tinted"), F.avg("out_r").alias("mean_r")))


OUT_LAB = f"{GRADED}, res AS (SELECT frame_id, idx, x, y, h, out_r AS r, out_g AS g, out_b AS b FROM graded), {sql.oklab('res')}"
#: Chroma may rise a little with lightness in the highlights; from here on it looks like neon.
NEON_SLOPE, LEAST_HIGHLIGHTS, LEAST_GRAIN = 0.03, 12, 20


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("frame_id", "idx", "x", "y", "h", *[F.col("out_" + k).alias(k) for k in "rgb"])


@query(f"""{OUT_LAB}, s AS (SELECT frame_id, count(*) FILTER (WHERE okl > 8e-1) AS samples, regr_slope({sql.hypot('oka', 'okb')}, okl) FILTER (WHERE okl > 8e-1) AS slope FROM lab GROUP BY frame_id)
SELECT frame_id, samples, CASE WHEN samples >= 12 THEN round(coalesce(slope, 0e0), 6) + 0e0 END AS slope, CASE WHEN samples >= 12 THEN coalesce(slope, 0e0) < {sql.num(NEON_SLOPE)} END AS passed FROM s""")
def gate_ptw_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of chroma over lightness in the highlights; null where too few pixels say anything."""
    rows = colour.with_oklab(results(spark, sf_dir))
    bright = F.col("ok_L") > 0.8
    c, light = F.when(bright, colour.chroma(F.col("ok_a"), F.col("ok_b"))), F.when(bright, F.col("ok_L"))
    sums = rows.groupBy("frame_id").agg(F.count_if(bright).alias("samples"), F.coalesce(F.regr_slope(c, light), F.lit(0.0)).alias("slope"))
    enough = F.col("samples") >= LEAST_HIGHLIGHTS
    return sums.select("frame_id", "samples", F.when(enough, r6("slope")).alias("slope"), F.when(enough, F.col("slope") < NEON_SLOPE).alias("passed"))


_AROUND = "(abs(lag(l) OVER (PARTITION BY frame_id, y ORDER BY x) - l) + abs(lead(l) OVER (PARTITION BY frame_id, y ORDER BY x) - l) + abs(lag(l) OVER (PARTITION BY frame_id, x ORDER BY y) - l) + abs(lead(l) OVER (PARTITION BY frame_id, x ORDER BY y) - l)) / 4"


@query(f"""{OUT_LAB}, lu AS (SELECT *, {sql.luma()} AS l FROM lab), amp AS (SELECT *, {_AROUND} AS amplitude FROM lu),
s AS (SELECT frame_id, count(*) AS samples, corr(l, amplitude) AS correlation FROM amp WHERE y >= 2 AND x >= 2 AND y < h - 2 AND x < 30 AND (y - 2) % 3 = 0 AND (x - 2) % 3 = 0 GROUP BY frame_id)
SELECT frame_id, samples, CASE WHEN samples >= 20 THEN round(coalesce(correlation, 0e0), 6) + 0e0 END AS correlation, CASE WHEN samples >= 20 THEN abs(coalesce(correlation, 0e0)) >= 2e-1 END AS passed FROM s""")
def gate_grain_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grain follows lightness, or it is uniform noise."""
    from pyspark.sql import Window

    rows = results(spark, sf_dir).select("frame_id", "x", "y", "h", colour.luma(F.col("r"), F.col("g"), F.col("b")).alias("l")).repartition(fixtures.frame_parts(spark, sf_dir), "frame_id")
    across, down = Window.partitionBy("frame_id", "y").orderBy("x"), Window.partitionBy("frame_id", "x").orderBy("y")
    near = sum((F.abs(f("l").over(w) - F.col("l")) for w in (across, down) for f in (F.lag, F.lead)), F.lit(0.0)) / 4
    rows = rows.withColumn("amplitude", near).filter("y >= 2 and x >= 2 and y < h - 2 and x < 30 and (y - 2) % 3 = 0 and (x - 2) % 3 = 0")
    sums = rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.corr("l", "amplitude"), F.lit(0.0)).alias("correlation"))
    enough = F.col("samples") >= LEAST_GRAIN
    return sums.select("frame_id", "samples", F.when(enough, r6("correlation")).alias("correlation"), F.when(enough, F.abs("correlation") >= 0.2).alias("passed"))


_L1, _L2 = sql.luma(), sql.luma("out_r", "out_g", "out_b")


@query(f"""{GRADED}, lu AS (SELECT *, {_L1} AS l1, {_L2} AS l2, sqrt(pow((x - 16) / 16e0, 2) + pow((y - h / 2e0) / (h / 2e0), 2)) AS rad FROM graded),
s AS (SELECT frame_id, avg(l1) AS m1, avg(l2) AS m2, list_sort(list(l2))[CAST(floor(count(*) * 0.05) AS BIGINT) + 1] - list_sort(list(l1))[CAST(floor(count(*) * 0.05) AS BIGINT) + 1] AS lift, list_sort(list(l2))[CAST(floor(count(*) * 0.01) AS BIGINT) + 1] AS black,
  avg(CASE WHEN greatest(out_r, out_g, out_b) >= 253 AND least(out_r, out_g, out_b) < 200 THEN 1e0 ELSE 0e0 END) - avg(CASE WHEN greatest(r, g, b) >= 253 AND least(r, g, b) < 200 THEN 1e0 ELSE 0e0 END) AS clip,
  avg(CASE WHEN greatest(out_r, out_g, out_b) < 2 THEN 1e0 ELSE 0e0 END) - avg(CASE WHEN greatest(r, g, b) < 2 THEN 1e0 ELSE 0e0 END) AS near_black,
  avg(CASE WHEN l2 >= 9.9e-1 THEN 1e0 ELSE 0e0 END) - avg(CASE WHEN l1 >= 9.9e-1 THEN 1e0 ELSE 0e0 END) AS near_clip,
  coalesce(avg(l2 - l1) FILTER (WHERE rad < 4e-1) - avg(l2 - l1) FILTER (WHERE rad > 8.5e-1), 0e0) AS ring FROM lu GROUP BY frame_id)
SELECT frame_id, {s6(lift='lift', clip_gain='clip', near_black_gain='near_black', near_clip_gain='near_clip', mean_shift='m2 - m1', vignette_gap='ring')}, lift > 1e-2 AND black > 8 / 255e0 AS black_lifted, clip > 1e-2 AS hue_clipped, near_black > 3e-2 AS crushed, near_clip > 1e-2 AS cut_flat, ring > 5e-2 AS ringed FROM s""")
def failure_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known failures that pixels can show, source against result in one aggregate by frame."""
    r, g, b = (F.col(k) for k in "rgb")
    p, q, s = (F.col("out_" + k) for k in "rgb")
    rows = graded(spark, sf_dir).withColumns({"l1": colour.luma(r, g, b), "l2": colour.luma(p, q, s), "rad": F.sqrt(F.pow((F.col("x") - 16) / 16.0, 2) + F.pow((F.col("y") - F.col("h") / 2.0) / (F.col("h") / 2.0), 2))})
    share = lambda c: F.avg(c.cast("double"))
    cut = lambda *c: (F.greatest(*c) >= 253) & (F.least(*c) < 200)
    moved = F.col("l2") - F.col("l1")
    sums = rows.groupBy("frame_id").agg(
        (nearest_rank(F.col("l2"), 0.05) - nearest_rank(F.col("l1"), 0.05)).alias("lift"), nearest_rank(F.col("l2"), 0.01).alias("black"), (share(cut(p, q, s)) - share(cut(r, g, b))).alias("clip_gain"),
        (share(F.greatest(p, q, s) < 2) - share(F.greatest(r, g, b) < 2)).alias("near_black_gain"), (share(F.col("l2") >= 0.99) - share(F.col("l1") >= 0.99)).alias("near_clip_gain"), (F.avg("l2") - F.avg("l1")).alias("mean_shift"),
        F.coalesce(F.avg(F.when(F.col("rad") < 0.4, moved)) - F.avg(F.when(F.col("rad") > 0.85, moved)), F.lit(0.0)).alias("vignette_gap"),
    )
    verdicts = {"black_lifted": (F.col("lift") > 0.01) & (F.col("black") > 8 / 255), "hue_clipped": F.col("clip_gain") > 0.01, "crushed": F.col("near_black_gain") > 0.03, "cut_flat": F.col("near_clip_gain") > 0.01, "ringed": F.col("vignette_gap") > 0.05}
    return rounded(sums.withColumns(verdicts).drop("black"))


_DE = "sqrt(pow(a.okl - c.okl, 2) + pow(a.oka - c.oka, 2) + pow(a.okb - c.okb, 2))"


@query(f"""{OUT_LAB}, {sql.oklab('px', 'src')}, d AS (SELECT frame_id, {_DE} AS de FROM src a JOIN lab c USING (frame_id, idx)) SELECT frame_id, {s6(mean_de='avg(de)', min_de='min(de)', max_de='max(de)', p95_de='quantile_cont(de, 0.95)')}, avg(de) BETWEEN 4e-3 AND 2.5e-1 AS passed FROM d GROUP BY frame_id""")
def acceptance_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a result moved from its source, and whether that lies in bounds."""
    rows = colour.with_oklab(colour.with_oklab(graded(spark, sf_dir), out="a_"), "out_r", "out_g", "out_b", out="c_")
    rows = rows.select("frame_id", colour.delta_e_ok("a_", "c_").alias("de"))
    return rounded(rows.groupBy("frame_id").agg(F.avg("de").alias("mean_de"), F.min("de").alias("min_de"), F.max("de").alias("max_de"), F.percentile("de", 0.95).alias("p95_de"), F.avg("de").between(0.004, 0.25).alias("passed")))


MEASURED = f"me AS (SELECT *, {sql.luma()} AS luma, (greatest(r, g, b) - least(r, g, b)) / 255e0 AS chroma, y / CAST(greatest(1, h - 1) AS DOUBLE) AS v FROM px)"
SUMMARY = f"count(*) AS pixels, {s6(luma='avg(luma)', chroma='avg(chroma)', warmth='avg((r - b) / 255e0)', density='avg(chroma * (1 - luma))')}"


def _mask_query(name: str) -> None:
    rules = regions.RULES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(regions.summary(regions.assign(fixtures.scenes(spark, sf_dir), rules), "role"))

    run.__name__, run.__doc__ = f"mask_{name}", f"M3-M10 A25: regions of the {name} proxy."
    query(f"WITH {fixtures.SCENES_SQL}, {MEASURED}, ro AS (SELECT *, {regions.case(rules)} AS role FROM me) SELECT frame_id, role, {SUMMARY} FROM ro GROUP BY ALL")(run)


for _name in regions.RULES:
    if _name != "rainy":
        _mask_query(_name)


@query(f"""WITH {fixtures.SCENES_SQL}, {MEASURED}, ro AS (SELECT *, {regions.case(regions.RULES['rainy'])} AS seen FROM me), cov AS (SELECT *, avg(CASE WHEN seen = 'seed' THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY frame_id) AS cover FROM ro),
fin AS (SELECT *, CASE WHEN seen IN ('seed', 'road') AND cover >= 2e-3 THEN 'wet' WHEN seen = 'warm' THEN 'warm' END AS role FROM cov) SELECT frame_id, role, {SUMMARY} FROM fin GROUP BY ALL""")
def mask_rainy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wet streets, decided for a frame as a whole."""
    return rounded(regions.summary(regions.wet_surfaces(fixtures.scenes(spark, sf_dir)), "role"))


def _ramp(v: str, low: float, high: float) -> str:
    t = f"least(greatest(({v} - {sql.num(low)}) / {sql.num(high - low)}, 0e0), 1e0)"
    return f"({t} * {t} * (3 - {t} * 2))"


_SOFT = f"{_ramp('luma', 0.56, 0.68)} * (1 - {_ramp('chroma', 0.11, 0.17)})"


@query(f"""WITH {fixtures.SCENES_SQL}, {MEASURED}, w AS (SELECT *, luma >= 6.8e-1 AND chroma <= 1.1e-1 AS hard, {_SOFT} AS soft FROM me)
SELECT frame_id, count(*) FILTER (WHERE hard) AS hard, {s6(soft='avg(soft)', luma_inside='coalesce(sum(luma * soft) / nullif(sum(soft), 0), 0e0)', luma_outside='sum(luma * (1 - soft)) / sum(1 - soft)')} FROM w GROUP BY frame_id""")
def mask_neutral_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral white, as a mask and as a weight, and means inside and outside."""
    hard, soft = regions.neutral_white(F.col("luma"), F.col("chroma"))
    rows = regions.measured(fixtures.scenes(spark, sf_dir)).withColumns({"hard": hard, "soft": soft})
    inside = F.coalesce(F.try_divide(F.sum(F.col("luma") * F.col("soft")), F.sum("soft")), F.lit(0.0))
    rest = F.lit(1.0) - F.col("soft")
    return rounded(rows.groupBy("frame_id").agg(F.count_if("hard").alias("hard"), F.avg("soft").alias("soft"), inside.alias("luma_inside"), (F.sum(F.col("luma") * rest) / F.sum(rest)).alias("luma_outside")))


_A, _B, _P = (f"coalesce(({dict(regions.RULES[n])[r]}), FALSE)" for n, r in (("deep_sea", "environment"), ("warm_cozy", "cool"), ("landscape", "protect")))


@query(f"""WITH {fixtures.SCENES_SQL}, {MEASURED}, m AS (SELECT frame_id, {_A} AS one, {_B} AS two, {_P} AS guard FROM me)
SELECT frame_id, count(*) FILTER (WHERE one OR two) AS in_union, count(*) FILTER (WHERE one AND two) AS in_both, count(*) FILTER (WHERE one AND NOT guard) AS in_difference, {s6(iou='CASE WHEN count(*) FILTER (WHERE one OR two) > 0 THEN count(*) FILTER (WHERE one AND two) / CAST(count(*) FILTER (WHERE one OR two) AS DOUBLE) ELSE 0e0 END')} FROM m GROUP BY frame_id""")
def mask_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, difference and overlap of masks."""
    rows = regions.measured(fixtures.scenes(spark, sf_dir)).select("frame_id", F.expr(_A).alias("one"), F.expr(_B).alias("two"), F.expr(_P).alias("guard"))
    one, two, guard = F.col("one"), F.col("two"), F.col("guard")
    return rounded(rows.groupBy("frame_id").agg(F.count_if(one | two).alias("in_union"), F.count_if(one & two).alias("in_both"), F.count_if(one & ~guard).alias("in_difference"), regions.overlap(one, two).alias("iou")))


def _named_regions(luma: Column, chroma: Column, soft: Column) -> Column:
    """Regions overlap; each pixel is in all that it meets."""
    tests = {"world": soft <= 0.05, "core": soft >= 0.95, "white": (luma >= 0.75) & (chroma <= 0.10), "black": luma <= 0.15}
    return F.array_compact(F.array(F.lit("whole"), *[F.when(c, F.lit(n)) for n, c in tests.items()]))


@query(f"""WITH {fixtures.SCENES_SQL}, {MEASURED}, w AS (SELECT *, {_SOFT} AS soft FROM me), reg AS (
  SELECT *, 'whole' AS region FROM w UNION ALL SELECT *, 'world' FROM w WHERE soft <= 5e-2 UNION ALL SELECT *, 'core' FROM w WHERE soft >= 9.5e-1 UNION ALL SELECT *, 'white' FROM w WHERE luma >= 7.5e-1 AND chroma <= 1e-1 UNION ALL SELECT *, 'black' FROM w WHERE luma <= 1.5e-1)
SELECT frame_id, region, {SUMMARY} FROM reg GROUP BY ALL""")
def region_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping regions, fixed on the source."""
    rows = regions.measured(fixtures.scenes(spark, sf_dir))
    soft = regions.neutral_white(F.col("luma"), F.col("chroma"))[1]
    named = rows.withColumn("soft", soft).withColumn("region", F.explode(_named_regions(F.col("luma"), F.col("chroma"), F.col("soft"))))
    return rounded(regions.summary(named, "region"))


@query(f"""WITH {fixtures.SCENES_SQL}, {sql.oklab()}, c AS (SELECT frame_id, {sql.hypot('oka', 'okb')} AS c, radians({sql.hue('oka', 'okb')}) AS t FROM lab)
SELECT frame_id, {s6(circular_variance='1 - sqrt(pow(sum(c * cos(t)), 2) + pow(sum(c * sin(t)), 2)) / sum(c)', chroma_p10='quantile_cont(c, 0.1)', chroma_p90='quantile_cont(c, 0.9)')} FROM c GROUP BY frame_id""")
def hue_circular_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of hue, weighted by chroma, and quantiles of chroma."""
    rows = colour.with_oklab(fixtures.scenes(spark, sf_dir)).select("frame_id", colour.chroma(F.col("ok_a"), F.col("ok_b")).alias("c"), F.radians(colour.hue(F.col("ok_a"), F.col("ok_b"))).alias("t"))
    spread = F.lit(1.0) - F.hypot(F.sum(F.col("c") * F.cos("t")), F.sum(F.col("c") * F.sin("t"))) / F.sum("c")
    return rounded(rows.groupBy("frame_id").agg(spread.alias("circular_variance"), F.percentile("c", 0.1).alias("chroma_p10"), F.percentile("c", 0.9).alias("chroma_p90")))


@query(f"""WITH {fixtures.SCENES_SQL} SELECT frame_id, r // 8 AS br, g // 8 AS bg, b // 8 AS bb, count(*) AS n, {s6(mean_r='avg(r)', mean_g='avg(g)', mean_b='avg(b)', mean_x='avg(x / 32e0)', mean_y='avg(y / CAST(h AS DOUBLE))')} FROM px GROUP BY ALL""")
def palette_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by five bits a channel, with the mean colour and place of each bin."""
    rows = fixtures.scenes(spark, sf_dir)
    bins = rows.groupBy("frame_id", *[F.expr(f"{k} div 8").alias("b" + k) for k in "rgb"]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias("mean_" + k) for k in "rgb"], F.avg(F.col("x") / 32.0).alias("mean_x"), F.avg(F.col("y") / F.col("h")).alias("mean_y"))
    return rounded(bins)


@query(f"""WITH cube AS (SELECT CAST(i AS BIGINT) AS idx, i % 17 AS x, (i // 17) % 17 AS y, i // 289 AS z FROM range(4913) t(i)), px AS (SELECT idx, x / 16e0 * 255 AS r, y / 16e0 * 255 AS g, z / 16e0 * 255 AS b FROM cube), {_chain(LOOK, 1.0)}
SELECT idx, {s6(r='r0', g='g0', b='b0')} FROM graded""")
def lut_bake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the chain over a 17-step cube, red fastest."""
    size = 17
    cube = spark.range(size**3).select(F.col("id").alias("idx"), *[((F.expr(f"id div {size**k}") % size) / (size - 1.0) * 255).alias(c) for k, c in enumerate("rgb")])
    return baked(cube)


def baked(cube: DataFrame) -> DataFrame:
    """The full look as doubles 0..1: what a table holds before it is written as text."""
    own = grade.with_grade(cube, LOOK, 1.0, unrounded=True)
    return own.select("idx", *[r6("out_" + k).alias(k) for k in "rgb"])
