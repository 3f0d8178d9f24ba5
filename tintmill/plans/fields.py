"""Queries over places in a frame, skin, and colour fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.functions import colour, labels
from tintmill.operators import diagnosis as diag
from tintmill.operators import fields
from tintmill.plans import sql
from tintmill.plans.frames import SCENE_LUM, rounded, s6
from tintmill.plans.regions import GRADED, graded
from tintmill.plans.registry import query
from tintmill.sources import fixtures


def lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = colour.with_linear(fixtures.scenes(spark, sf_dir))
    return rows.select("frame_id", "idx", "x", "y", "h", diag.luminance().alias("lum"))


@query(f"""{SCENE_LUM}, e AS (SELECT frame_id, abs(lum - lag(lum) OVER (PARTITION BY frame_id, y ORDER BY x)) AS hs, abs(lum - lag(lum) OVER (PARTITION BY frame_id, x ORDER BY y)) AS vs FROM lum)
SELECT frame_id, {s6(horizontal='avg(hs)', vertical='avg(vs)')} FROM e GROUP BY frame_id""")
def edge_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to neighbours, across and down."""
    return rounded(fields.edge_energy(lit(spark, sf_dir), "lum", fixtures.frame_parts(spark, sf_dir)))


@query(f"""{SCENE_LUM}, m AS (SELECT *, lum >= 1e-1 AS keep FROM lum), a AS (SELECT *, min(keep) OVER (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS k1 FROM m),
b AS (SELECT *, min(k1) OVER (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS k2 FROM a)
SELECT frame_id, count(*) FILTER (WHERE k2) AS pixels, {s6(p99='quantile_cont(lum, 0.99) FILTER (WHERE k2)')} FROM b GROUP BY frame_id""")
def erode_protect_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bright end inside a protected region, its rim left out; null where nothing is left."""
    rows = fields.eroded(lit(spark, sf_dir).withColumn("keep", F.col("lum") >= 0.1), "keep", 1, fixtures.frame_parts(spark, sf_dir))
    return rounded(rows.groupBy("frame_id").agg(F.count_if("keep").alias("pixels"), F.percentile(F.when(F.col("keep"), F.col("lum")), 0.99).alias("p99")))


@query(f"""{SCENE_LUM}, p AS (SELECT frame_id, lum, x / 32e0 AS u, y / CAST(h AS DOUBLE) AS v, lum >= max(lum) OVER (PARTITION BY frame_id) * 9.2e-1 AS core FROM lum),
c AS (SELECT frame_id, sum(u * lum) / sum(lum) AS cx, sum(v * lum) / sum(lum) AS cy FROM p WHERE core GROUP BY frame_id),
s AS (SELECT frame_id, avg(CASE WHEN core THEN 1e0 ELSE 0e0 END) AS area, coalesce(avg(lum) FILTER (WHERE core) / avg(lum) FILTER (WHERE NOT core), 0e0) AS contrast, any_value(cx) AS cx, any_value(cy) AS cy, quantile_cont(sqrt(pow(u - cx, 2) + pow(v - cy, 2)), 0.9) FILTER (WHERE core) AS radius FROM p JOIN c USING (frame_id) GROUP BY frame_id)
SELECT frame_id, {s6(area='area', contrast='contrast', cx='cx', cy='cy', radius='radius')}, area BETWEEN 8e-4 AND 3.5e-1 AND contrast >= 1.6e0 AS found FROM s""")
def light_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the light of a frame comes from."""
    rows = lit(spark, sf_dir).withColumns({"u": F.col("x") / 32.0, "v": F.col("y") / F.col("h")})
    return rounded(fields.light_core(rows))


@query(f"""WITH {fixtures.SCENES_SQL}, p AS (SELECT frame_id, {sql.luma()} AS luma, x / 32e0 AS u, y / CAST(h AS DOUBLE) AS v FROM px), f AS (SELECT frame_id, max(luma) AS peak, list_sort(list(luma))[count(*) // 2 + 1] AS middle, count(*) AS n FROM p GROUP BY frame_id),
c AS (SELECT p.*, peak, middle, n FROM p JOIN f USING (frame_id) WHERE luma >= peak * 9.2e-1), z AS (SELECT frame_id, sum(u * luma) / sum(luma) AS cx, sum(v * luma) / sum(luma) AS cy FROM c GROUP BY frame_id),
s AS (SELECT frame_id, count(*) / CAST(any_value(n) AS DOUBLE) AS area, avg(luma) / greatest(1e-6, any_value(middle)) AS contrast, any_value(peak) AS peak, any_value(cx) AS cx, any_value(cy) AS cy,
  greatest(list_sort(list(sqrt(pow(u - cx, 2) + pow(v - cy, 2))))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1], 2e-2) AS radius FROM c JOIN z USING (frame_id) GROUP BY frame_id)
SELECT frame_id, {s6(area='area', contrast='contrast', peak='peak', cx='cx', cy='cy', radius='radius')}, area BETWEEN 8e-4 AND 3.5e-1 AND contrast >= 1.6e0 AS found FROM s""")
def light_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light of a frame in encoded luma, against the frame's middle value."""
    rows = fixtures.scenes(spark, sf_dir)
    return rounded(fields.light_source(rows.select("frame_id", colour.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"), (F.col("x") / 32.0).alias("u"), (F.col("y") / F.col("h")).alias("v"))))


_BOTH = f"""{GRADED}, sr AS (SELECT frame_id, idx, x, y, h, r, g, b FROM graded), re AS (SELECT frame_id, idx, out_r AS r, out_g AS g, out_b AS b FROM graded)"""


@query(f"""{_BOTH}, {sql.oklab('sr', 'sl')}, {sql.oklab('re', 'rl')}, d AS (SELECT s.frame_id, t.okb - s.okb AS warmer, sqrt(pow((x - 16) / 16e0, 2) + pow((y - h / 2e0) / (h / 2e0), 2)) AS away FROM sl s JOIN rl t USING (frame_id, idx)),
f AS (SELECT frame_id, count(*) FILTER (WHERE away < 3.5e-1) AS near, count(*) FILTER (WHERE away > 7.5e-1) AS far, avg(warmer) FILTER (WHERE away < 3.5e-1) - avg(warmer) FILTER (WHERE away > 7.5e-1) AS fall FROM d GROUP BY frame_id)
SELECT frame_id, near, far, CASE WHEN near >= 20 AND far >= 20 THEN round(fall, 6) + 0e0 END AS fall, CASE WHEN near >= 20 AND far >= 20 THEN fall > 4e-3 END AS passed FROM f""")
def warm_falloff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a grade warms the middle more than the edge."""
    rows = colour.with_oklab(colour.with_oklab(graded(spark, sf_dir), out="a_"), "out_r", "out_g", "out_b", out="c_")
    away = F.sqrt(F.pow((F.col("x") - 16) / 16.0, 2) + F.pow((F.col("y") - F.col("h") / 2.0) / (F.col("h") / 2.0), 2))
    return rounded(fields.warm_falloff(rows.select("frame_id", (F.col("c_b") - F.col("a_b")).alias("warmer"), away.alias("away"))))


def _off(h: str) -> str:
    ends = ", ".join(f"least(abs({h} - {e}), 360 - abs({h} - {e}))" for e in (30, 50))
    return f"CASE WHEN {h} BETWEEN 30 AND 50 THEN 0e0 ELSE least({ends}) END"


def _polar(t: str, out: str) -> str:
    a, b = f"(500 * ({t}_f0 - {t}_f1))", f"(200 * ({t}_f1 - {t}_f2))"
    return f"{sql.hue(a, b)} AS {out}_hue, {sql.hypot(a, b)} AS {out}_chroma"


@query(f"""{_BOTH}, {sql.oklab('sr', 'sl')}, sk AS (SELECT frame_id, idx, lr, lg, lb FROM sl WHERE okl BETWEEN 4e-1 AND 9.2e-1 AND {sql.hypot('oka', 'okb')} BETWEEN 2e-2 AND 1.15e-1 AND {sql.hue('oka', 'okb')} BETWEEN 25 AND 85), {sql.linear('re', 'rn')},
f AS (SELECT sk.frame_id, {sql.cielab('sk.lr', 'sk.lg', 'sk.lb', 'p')}, {sql.cielab('rn.lr', 'rn.lg', 'rn.lb', 's')} FROM sk JOIN rn USING (frame_id, idx)), t AS (SELECT frame_id, {_polar('p', 'before')}, {_polar('s', 'after')} FROM f),
m AS (SELECT frame_id, count(*) AS samples, quantile_cont(before_hue, 0.5) AS before_hue, quantile_cont(after_hue, 0.5) AS after_hue, quantile_cont(before_chroma, 0.5) AS before_chroma, quantile_cont(after_chroma, 0.5) AS after_chroma FROM t GROUP BY frame_id),
o AS (SELECT *, {_off('before_hue')} AS was, {_off('after_hue')} AS now, least(abs(before_hue - after_hue), 360 - abs(before_hue - after_hue)) AS shift FROM m)
SELECT frame_id, samples, {s6(before_hue='before_hue', after_hue='after_hue', shift='shift')}, CASE WHEN samples >= 12 THEN NOT (CASE WHEN was = 0 THEN now > 0 ELSE shift > 3 OR now > was + 2 END) AND NOT after_chroma > before_chroma * 1.1e0 END AS passed FROM o""")
def gate_skin_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skin stays in its corridor of hue, or hardly moves where it lay outside."""
    rows = colour.with_oklab(graded(spark, sf_dir))
    rows = rows.withColumn("skin", labels.plausible_skin(F.col("ok_L"), colour.chroma(F.col("ok_a"), F.col("ok_b")), colour.hue(F.col("ok_a"), F.col("ok_b"))))
    rows = colour.with_lab(colour.with_lab(rows, out="p_"), "out_r", "out_g", "out_b", out="s_")
    named = {"before": "p_", "after": "s_"}
    polar = [F.when(F.col("skin"), f(F.col(p + "a"), F.col(p + "b"))).alias(f"{n}_{what}") for n, p in named.items() for what, f in (("hue", colour.hue), ("chroma", colour.chroma))]
    return rounded(fields.skin_verdict(rows.select("frame_id", *polar)).select("frame_id", "samples", "before_hue", "after_hue", "shift", "passed"))


#: A camera that mixes its channels: what the fit has to find again.
MIXED = ((0.92, 0.05, 0.03), (0.04, 0.9, 0.06), (0.02, 0.08, 0.88))
_X = ", ".join(f"{c} / 255e0 AS x{k}" for k, c in enumerate("rgb"))
_Y = ", ".join(f"{sql.dot(row, 'x0', 'x1', 'x2')} AS y{k}" for k, row in enumerate(MIXED))
_PAIRS = [f"x{j}x{k}" for j in range(3) for k in range(j, 3)] + [f"x{j}y{k}" for j in range(3) for k in range(3)]
_SUMS = {p: f"sum({p[:2]} * {p[2:]})" for p in _PAIRS}


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.pixels(spark, sf_dir).select("frame_id", *[(F.col(c) / 255.0).alias(f"x{k}") for k, c in enumerate("rgb")])
    return rows.withColumns({f"y{k}": colour.combined(row, *[F.col(f"x{j}") for j in range(3)]) for k, row in enumerate(MIXED)})


@query(f"WITH {fixtures.PIXELS_SQL}, cx AS (SELECT frame_id, {_X} FROM px), cy AS (SELECT *, {_Y} FROM cx) SELECT frame_id, count(*) AS samples, {s6(**_SUMS)} FROM cy GROUP BY frame_id")
def cal_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the sums of a colour fit."""
    return rounded(fields.moments(chart(spark, sf_dir), "frame_id"))


@query(f"WITH {fixtures.PIXELS_SQL}, fr AS (SELECT frame_id, count(*) AS samples FROM px GROUP BY frame_id) SELECT frame_id, samples, {s6(**{f'm{j}{k}': sql.num(MIXED[j][k]) for j in range(3) for k in range(3)})} FROM fr")
def cal_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the fitted matrix, which must be the one that mixed the channels."""
    return rounded(fields.solved(fields.moments(chart(spark, sf_dir), "frame_id"), "frame_id"))


# Families of hue that speak for a season, and the seasons' names.
WARM, GREEN, COOL = ("红", "橙／肤色带", "黄"), ("黄绿", "绿", "青绿"), ("青绿", "青蓝", "蓝")
AUTUMN, GROWING, WINTER = "秋", "春／夏", "冬"


def _weight(families) -> str:
    return "coalesce(sum(share) FILTER (WHERE family IN (" + ", ".join(f"'{f}'" for f in families) + ")), 0e0)"


_SCENE_CHROMA = f"WITH {fixtures.SCENES_SQL}, {sql.oklab()}, chr AS (SELECT *, {sql.hypot('oka', 'okb')} AS chroma FROM lab)"


@query(f"""{_SCENE_CHROMA}, st AS (SELECT frame_id, avg(chroma) AS mean_chroma, avg(CASE WHEN chroma >= 2.8e-2 THEN 1e0 ELSE 0e0 END) AS chromatic FROM chr GROUP BY frame_id),
bins AS (SELECT frame_id, CAST(floor(({sql.hue('oka', 'okb')}) / 10) AS BIGINT) % 36 AS bin, sum(chroma) AS weight FROM chr WHERE chroma >= 2.8e-2 GROUP BY ALL),
ranked AS (SELECT *, weight / sum(weight) OVER (PARTITION BY frame_id) AS share, row_number() OVER (PARTITION BY frame_id ORDER BY round(weight, 9) DESC, bin) AS rank FROM bins),
top AS (SELECT frame_id, share, {sql.cases('bin * 10 + 5', labels.HUE_FAMILIES, labels.HUE_FAMILIES[0][1])} AS family FROM ranked WHERE rank <= 3),
w AS (SELECT frame_id, {_weight(WARM)} AS warm, {_weight(GREEN)} AS green, {_weight(COOL)} AS cool FROM top GROUP BY frame_id), j AS (SELECT frame_id, mean_chroma, chromatic, coalesce(warm, 0e0) AS warm, coalesce(green, 0e0) AS green, coalesce(cool, 0e0) AS cool FROM st LEFT JOIN w USING (frame_id)),
v AS (SELECT *, CASE WHEN chromatic >= 2.2e-1 AND warm >= 5.8e-1 THEN '{AUTUMN}' WHEN chromatic >= 2e-1 AND green >= 5.8e-1 THEN '{GROWING}' WHEN cool >= 6.2e-1 AND mean_chroma <= 1e-1 THEN '{WINTER}' ELSE 'unknown' END AS season FROM j)
SELECT frame_id, {s6(warm='warm', green='green', cool='cool')}, season, CASE season WHEN '{AUTUMN}' THEN round(least(8.8e-1, warm * chromatic + 4.5e-1), 3) WHEN '{GROWING}' THEN round(least(8.4e-1, green * chromatic + 4.2e-1), 3) WHEN '{WINTER}' THEN round(least(8.2e-1, cool * 7.2e-1), 3) ELSE 0e0 END AS confidence FROM v""")
def season_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season suggested by the strongest hues alone; unknown where they say too little."""
    c, rows = F.col, fixtures.scenes(spark, sf_dir)
    weight = lambda families: F.sum(F.when(c("family").isin(*families), c("share")).otherwise(0.0))
    hues = diag.hue_histogram(rows).groupBy("frame_id").agg(weight(WARM).alias("warm"), weight(GREEN).alias("green"), weight(COOL).alias("cool"))
    seen = diag.colour_stats(rows).select("frame_id", c("mean_chroma_oklab").alias("mean_chroma"), c("chromatic_pixel_ratio").alias("chromatic")).join(hues, "frame_id", "left").fillna(0.0, ["warm", "green", "cool"])
    autumn, growing, winter = (c("chromatic") >= 0.22) & (c("warm") >= 0.58), (c("chromatic") >= 0.20) & (c("green") >= 0.58), (c("cool") >= 0.62) & (c("mean_chroma") <= 0.10)
    season = F.when(autumn, AUTUMN).when(growing, GROWING).when(winter, WINTER).otherwise("unknown")
    sure = F.when(autumn, F.least(F.lit(0.88), c("warm") * c("chromatic") + 0.45)).when(growing, F.least(F.lit(0.84), c("green") * c("chromatic") + 0.42)).when(winter, F.least(F.lit(0.82), c("cool") * 0.72)).otherwise(0.0)
    return rounded(seen.select("frame_id", "warm", "green", "cool", season.alias("season"), F.round(sure, 3).alias("confidence")))
