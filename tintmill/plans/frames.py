"""Queries over frames: diagnosis, colour conversions and differences, light."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.functions import colour, hues, labels
from tintmill.operators import diagnosis as diag
from tintmill.plans import sql
from tintmill.plans.registry import query
from tintmill.sources import fixtures


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero. Like SQL's, a half is one of the value times a million, as a double; Spark's own
    `round` to six decimals looks for it in the shortest decimal number that stands for the value."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6 + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles of a result to six decimals, integers as longs; `keep` and strings as they are."""
    kinds = {"double": r6, "int": lambda c: F.col(c).cast("long")}
    return df.select(*[kinds[t](c).alias(c) if t in kinds and c not in keep else F.col(c) for c, t in df.dtypes])


S6 = "round({}, 6) + 0e0 AS {}"


def s6(**named: str) -> str:
    return ", ".join(S6.format(v, k) for k, v in named.items())


LUM = f"lum AS (SELECT *, {sql.dot(colour.LUMINANCE['srgb'], 'lr', 'lg', 'lb')} AS lum FROM lin)"
PX_LUM = f"WITH {fixtures.PIXELS_SQL}, {sql.linear('px')}, {LUM}"
SCENE_LUM = f"WITH {fixtures.SCENES_SQL}, {sql.linear('px')}, {LUM}"
TONE = f"""tone AS (SELECT frame_id, {', '.join(f"quantile_cont(lum, {p}) AS p{n}" for n, p in (('01', .01), ('05', .05), ('50', .5), ('75', .75), ('95', .95), ('99', .99)))},
  avg(CASE WHEN least(r, g, b) <= 1 THEN 1e0 ELSE 0e0 END) AS shadow_clip_ratio, avg(CASE WHEN greatest(r, g, b) >= 254 THEN 1e0 ELSE 0e0 END) AS highlight_clip_ratio,
  avg(CASE WHEN lum <= 4e-3 THEN 1e0 ELSE 0e0 END) AS luma_crushed_ratio, avg(CASE WHEN lum >= 9.9e-1 THEN 1e0 ELSE 0e0 END) AS luma_blown_ratio FROM lum GROUP BY frame_id)"""
E = labels.EXPOSURE
EXPOSURE = f"""CASE WHEN p50 < 8e-2 THEN '{E['deep']}' WHEN p50 < 1.6e-1 THEN '{E['dark']}' WHEN p50 > 6.2e-1 AND p05 > 2.2e-1 THEN '{E['high']}'
  WHEN p50 > 5e-1 THEN '{E['bright']}' WHEN p95 < 4.5e-1 AND p50 < 2.5e-1 THEN '{E['low']}' ELSE '{E['usable']}' END"""
BLACK = f"CASE WHEN p01 <= 1.2e-2 THEN '{labels.BLACK_POINT['real']}' WHEN p01 > 4e-2 THEN '{labels.BLACK_POINT['high']}' ELSE '{labels.BLACK_POINT['soft']}' END"
WHITE = f"CASE WHEN p99 < 9.3e-1 THEN '{labels.WHITE_POINT['room']}' ELSE '{labels.WHITE_POINT['full']}' END"


@query(f"""{PX_LUM}, {TONE} SELECT frame_id, {s6(**{c: c for c in ('p01', 'p05', 'p50', 'p75', 'p95', 'p99', 'shadow_clip_ratio', 'highlight_clip_ratio', 'luma_crushed_ratio', 'luma_blown_ratio')})},
  {s6(tone_span='p95 - p05', headroom_up='log2(greatest(2e-2, least(6.2e-1, p50 * 2.2e0)) / greatest(5e-3, p50))', headroom_down='log2(greatest(3e-2, p50 * 5.5e-1) / greatest(5e-3, p50))')},
  {EXPOSURE} AS exposure_class, {BLACK} AS black_point, {WHITE} AS white_point FROM tone""")
def diag_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, clip ratios, headroom and classes of each frame."""
    rows = diag.tone(fixtures.pixels(spark, sf_dir))
    p = F.col
    named = rows.withColumns({"headroom_up": labels.headroom_up(p("p50")), "headroom_down": labels.headroom_down(p("p50")), "exposure_class": labels.exposure_class(p("p05"), p("p50"), p("p95")), "black_point": labels.black_point(p("p01")), "white_point": labels.white_point(p("p99"))})
    return rounded(named)


PX_LAB = f"WITH {fixtures.PIXELS_SQL}, {sql.oklab()}, chr AS (SELECT *, {sql.hypot('oka', 'okb')} AS chroma FROM lab)"
COLOUR = f"""sums AS (SELECT frame_id, count(*) AS n, stddev_pop((r - g) / 255e0) AS rgs, stddev_pop(((r + g) / 2e0 - b) / 255e0) AS ybs, avg((r - g) / 255e0) AS rgm, avg(((r + g) / 2e0 - b) / 255e0) AS ybm,
  avg(chroma) AS mean_chroma_oklab, avg(CASE WHEN chroma >= 2.8e-2 THEN 1e0 ELSE 0e0 END) AS chromatic_pixel_ratio, count(*) FILTER (WHERE chroma < 5.5e-2) AS neutral_sample_count,
  avg(oka) FILTER (WHERE chroma < 5.5e-2) AS na, avg(okb) FILTER (WHERE chroma < 5.5e-2) AS nb FROM chr GROUP BY frame_id),
cast_of AS (SELECT *, CASE WHEN neutral_sample_count >= greatest(40e0, n * 2e-2) THEN na ELSE 0e0 END AS cast_a, CASE WHEN neutral_sample_count >= greatest(40e0, n * 2e-2) THEN nb ELSE 0e0 END AS cast_b FROM sums),
colours AS (SELECT *, {sql.hypot('cast_a', 'cast_b')} AS cast_magnitude, {sql.hypot('rgs', 'ybs')} + {sql.hypot('rgm', 'ybm')} * 3e-1 AS colorfulness,
  CASE WHEN neutral_sample_count >= greatest(40e0, n * 2e-2) THEN {sql.hue('cast_a', 'cast_b')} ELSE 0e0 END AS cast_hue FROM cast_of)"""
A = labels.CAST_AXES
CAST = f"""CASE WHEN cast_magnitude < 6e-3 THEN '{labels.NEUTRAL_CAST}' ELSE {sql.cases('cast_magnitude', labels.CAST_STRENGTHS)} ||
  CASE WHEN cast_hue BETWEEN 20 AND 110 THEN '{A['warm']}' WHEN cast_hue BETWEEN 190 AND 300 THEN '{A['cold']}' WHEN cast_hue > 110 AND cast_hue < 190 THEN '{A['green']}' ELSE '{A['magenta']}' END END"""


@query(f"""{PX_LAB}, {COLOUR} SELECT frame_id, n, neutral_sample_count, {s6(**{c: c for c in ('colorfulness', 'mean_chroma_oklab', 'chromatic_pixel_ratio', 'cast_a', 'cast_b', 'cast_magnitude', 'cast_hue')})}, {CAST} AS cast_label FROM colours""")
def diag_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colourfulness, chroma and white-balance cast of each frame."""
    rows = diag.colour_stats(fixtures.pixels(spark, sf_dir))
    return rounded(rows.withColumn("cast_label", labels.cast_label(F.col("cast_magnitude"), F.col("cast_hue"))))


@query(f"""{PX_LAB}, bins AS (SELECT frame_id, CAST(floor(({sql.hue('oka', 'okb')}) / 10) AS BIGINT) % 36 AS bin, sum(chroma) AS weight FROM chr WHERE chroma >= 2.8e-2 GROUP BY ALL),
ranked AS (SELECT *, weight / sum(weight) OVER (PARTITION BY frame_id) AS share, row_number() OVER (PARTITION BY frame_id ORDER BY round(weight, 9) DESC, bin) AS rank FROM bins)
SELECT frame_id, rank, bin * 10 + 5 AS hue_center, {s6(share='share')}, {sql.cases('bin * 10 + 5', labels.HUE_FAMILIES, labels.HUE_FAMILIES[0][1])} AS family FROM ranked WHERE rank <= 3""")
def diag_hue_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest of 36 hue bins of each frame."""
    return rounded(diag.hue_histogram(fixtures.pixels(spark, sf_dir)))


@query(f"""{SCENE_LUM}, uv AS (SELECT *, x / 32e0 AS u, y / CAST(h AS DOUBLE) AS v, h * 32 AS n FROM lum), c AS (SELECT *, u >= 2.5e-1 AND u < 7.5e-1 AND v >= 2e-1 AND v < 8e-1 AS centre FROM uv)
SELECT frame_id, {s6(luma_centroid_x='sum(lum * (x / 31e0)) / sum(lum)', luma_centroid_y='sum(lum * (y / CAST(greatest(1, h - 1) AS DOUBLE))) / sum(lum)',
  center_minus_edge='avg(lum) FILTER (WHERE centre) - avg(lum) FILTER (WHERE NOT centre)', top_third_luma='avg(lum) FILTER (WHERE idx < n // 3)', bottom_third_luma='avg(lum) FILTER (WHERE idx >= n * 2 // 3)')} FROM c GROUP BY frame_id""")
def diag_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the light of a frame lies."""
    return rounded(diag.space(fixtures.scenes(spark, sf_dir)))


def blurs(source: str, radii=(1, 4, 12), value: str = "lum") -> str:
    """CTEs that add b<r> for each radius: rows first, then columns."""
    out, last = [], source
    for r in radii:
        out.append(f"h{r} AS (SELECT *, avg({value}) OVER (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS hb{r} FROM {last})")
        out.append(f"v{r} AS (SELECT *, avg(hb{r}) OVER (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS b{r} FROM h{r})")
        last = f"v{r}"
    return ", ".join(out)


TEXTURE = """texture AS (SELECT frame_id, avg(abs(lum - b1)) AS local_contrast_texture, avg(abs(lum - b4)) AS local_contrast_modeling, avg(abs(lum - b12)) AS local_contrast_region,
  coalesce(avg(abs(lum - b1)) FILTER (WHERE abs(b1 - b4) < 1e-2), 0e0) AS noise_estimate FROM v12 GROUP BY frame_id)"""


@query(f"""{SCENE_LUM}, {blurs('lum')}, {TEXTURE} SELECT frame_id, {s6(**{c: c for c in ('local_contrast_texture', 'local_contrast_modeling', 'local_contrast_region', 'noise_estimate')})}, {sql.cases('noise_estimate', labels.NOISE)} AS noise FROM texture""")
def box_blur_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local contrast at three scales, noise in flat areas."""
    return rounded(diag.texture(fixtures.scenes(spark, sf_dir), parts=fixtures.frame_parts(spark, sf_dir)).withColumn("noise", labels.noise_label(F.col("noise_estimate"))))


def _bound(c: str) -> str:
    low, high = diag.POLISHED[c]
    return " AND ".join([f"{c} >= {sql.num(low)}"] * (low is not None) + [f"{c} <= {sql.num(high)}"] * (high is not None))


_CHECKS = dict(zip(("black_point", "exposure", "tone_span", "colorfulness", "chromatic_coverage", "local_contrast", "clean_texture"), map(_bound, diag.POLISHED)))
_CHECKS["white_balance_or_coherent_palette"] = "cast_magnitude <= 3e-2 OR (chromatic_pixel_ratio >= 8.5e-1 AND colorfulness >= 1.6e-1)"
_CHECKS["luma_clipping"] = "luma_blown_ratio <= 1e-2 AND luma_crushed_ratio <= 1e-2"
_FAILED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN NULL ELSE '{n}' END" for n, c in _CHECKS.items()) + "], lambda x: x IS NOT NULL), ',')"
POLISHED_SQL = f"""WITH {fixtures.SCENES_SQL}, {sql.oklab()}, lum AS (SELECT *, {sql.dot(colour.LUMINANCE['srgb'], 'lr', 'lg', 'lb')} AS lum FROM lab), chr AS (SELECT *, {sql.hypot('oka', 'okb')} AS chroma FROM lab),
{TONE}, {COLOUR}, {blurs('lum')}, {TEXTURE}, stats AS (SELECT *, p95 - p05 AS tone_span FROM tone JOIN colours USING (frame_id) JOIN texture USING (frame_id))"""


@query(f"{POLISHED_SQL}, done AS (SELECT frame_id, {_FAILED} AS failed_checks FROM stats) SELECT frame_id, failed_checks, failed_checks = '' AS candidate FROM done")
def already_polished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine checks, all of which a finished frame passes."""
    return diag.already_polished(diag.statistics(fixtures.scenes(spark, sf_dir), parts=fixtures.frame_parts(spark, sf_dir)))


LABEL = "CASE frame_id % 4 WHEN 0 THEN 'night' WHEN 1 THEN 'day' WHEN 2 THEN 'indoor' END"
CONFIDENCE = "(frame_id % 10) / 10e0"
SURE = f"({CONFIDENCE} >= 2.5e-1)"
_LIGHT = f"""facts AS (SELECT frame_id, p95, p50, {SURE} AND coalesce(lbl = 'day', FALSE) AS is_day, {SURE} AND coalesce(lbl = 'indoor', FALSE) AS is_in, {SURE} AND coalesce(lbl = 'night', FALSE) AND p95 >= 4e-1 AND p50 >= 9e-2 AS against
  FROM (SELECT *, {LABEL} AS lbl FROM tone))"""


@query(f"""{SCENE_LUM}, {TONE}, {_LIGHT}, said AS (SELECT *, CASE WHEN p95 <= 3.7e-1 THEN 'night' WHEN is_day AND p95 >= 4e-1 THEN 'day' WHEN against THEN NULL WHEN is_in THEN 'indoor' END AS value,
  CASE WHEN p95 <= 3.7e-1 OR (is_day AND p95 >= 4e-1) THEN 'known' WHEN against THEN 'conflicting' WHEN is_in THEN 'known' ELSE 'unknown' END AS state FROM facts)
SELECT frame_id, {s6(p50='p50', p95='p95')}, state, value, CASE WHEN state = 'unknown' THEN p95 >= 4e-1 END AS not_night FROM said""")
def light_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured light against labels with confidence; three states."""
    rows = diag.light_fact(diag.tone(fixtures.scenes(spark, sf_dir)), F.expr(LABEL), F.expr(CONFIDENCE))
    return rounded(rows.select("frame_id", "p50", "p95", "state", "value", "not_night"))


_M = colour.LINEAR_FROM_LMS["srgb"]
_BACK = f"""lms AS (SELECT *, {', '.join(f"{sql.dot(row, 'okl', 'oka', 'okb')} AS q{k}" for k, row in enumerate(colour.LMS_FROM_LAB))} FROM lab), cubed AS (SELECT *, {', '.join(f'q{k} * q{k} * q{k} AS u{k}' for k in range(3))} FROM lms),
back AS (SELECT *, {', '.join(f"{sql.dot(row, 'u0', 'u1', 'u2')} AS back_{k}" for k, row in zip('rgb', _M))} FROM cubed)"""


def eight_bit(linear: str) -> str:
    return f"CAST(least(greatest(round_even(({sql.encode(linear)}) * 255, 0), 0e0), 255e0) AS BIGINT)"


_CLOSE = " AND ".join(f"abs({eight_bit('back_' + k)} - {k}) <= 1" for k in "rgb")


@query(f"""WITH {fixtures.PIXELS_SQL}, {sql.oklab()}, {_BACK} SELECT frame_id, count(*) AS pixels, count(*) FILTER (WHERE {_CLOSE}) AS within_one, count(*) FILTER (WHERE {' OR '.join(f"back_{k} < -1e-3 OR back_{k} > 1.001e0" for k in 'rgb')}) AS outside,
  {s6(mean_hue=f"avg({sql.hue('oka', 'okb')})", mean_lightness='avg(okl)')} FROM back GROUP BY frame_id""")
def oklab_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To OKLab and back to eight bits, with the gamut test."""
    rows = colour.with_linear_from_oklab(colour.with_oklab(fixtures.pixels(spark, sf_dir)))
    lin = [F.col("lin_" + k) for k in "rgb"]
    close = F.lit(True)
    for k, c in zip("rgb", lin):
        close = close & (F.abs(colour.to_8bit(c) - F.col(k)) <= 1)
    out = rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(close).alias("within_one"), F.count_if(colour.outside_gamut(*lin)).alias("outside"), F.avg(colour.hue(F.col("ok_a"), F.col("ok_b"))).alias("mean_hue"), F.avg("ok_L").alias("mean_lightness"))
    return rounded(out)


def _names(pixels: DataFrame) -> DataFrame:
    rows = colour.with_oklab(pixels)
    c, h, light = colour.chroma(F.col("ok_a"), F.col("ok_b")), colour.hue(F.col("ok_a"), F.col("ok_b")), F.col("ok_L")
    return rows.select("frame_id", F.col("idx").cast("long"), colour.hex_code(F.col("r"), F.col("g"), F.col("b")).alias("hex"), colour.css_oklch(light, c, h).alias("css"), labels.hue_family(h).alias("family"), labels.plausible_skin(light, c, h).alias("skin"), labels.tone_role(light).alias("role"))


_NAMED_SQL = f"""WITH {fixtures.SCENES_SQL}, {sql.oklab()}, one AS (
  SELECT frame_id, CAST(idx AS BIGINT) AS idx, r, g, b, okl, {sql.hypot('oka', 'okb')} AS c, {sql.hue('oka', 'okb')} AS hue FROM lab)
SELECT frame_id, idx, printf('#%02X%02X%02X', r, g, b) AS hex,
  CASE WHEN c < 2e-3 THEN printf('oklch(%.1f%% 0 none)', okl * 100) ELSE printf('oklch(%.1f%% %.4f %.1f)', okl * 100, c, hue) END AS css,
  {sql.cases('hue', labels.HUE_FAMILIES, labels.HUE_FAMILIES[0][1])} AS family,
  okl BETWEEN 4e-1 AND 9.2e-1 AND c BETWEEN 2e-2 AND 1.15e-1 AND hue BETWEEN 25 AND 85 AS skin,
  CASE WHEN okl < 3.5e-1 THEN '{labels.TONE_ROLES['shadow']}' WHEN okl > 7e-1 THEN '{labels.TONE_ROLES['highlight']}'
    ELSE '{labels.TONE_ROLES['mid']}' END AS role FROM one"""


@query(_NAMED_SQL)
def colour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex and CSS text, hue family, tone role, skin likelihood of every pixel of every frame."""
    return _names(fixtures.scenes(spark, sf_dir))


@query(_NAMED_SQL)
def colour_names_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older name of colour_names, from when that query stopped at a frame's second row."""
    return colour_names(spark, sf_dir)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noise-like frame's pixels beside the gradient frame's, by position."""
    names = {k: "2" + k for k in "rgb"}
    return fixtures.pixels(spark, sf_dir).join(fixtures.scenes(spark, sf_dir).select("frame_id", "idx", *[F.col(k).alias(n) for k, n in names.items()]), ["frame_id", "idx"])


def _both(kind: str) -> str:
    return f"""WITH {fixtures.PIXELS_SQL}, sc AS (SELECT frame_id, idx, CAST((x * 8 + y * 3 + q) % 256 AS INT) AS r, CAST((y * 12 + l_linenumber * 4) % 256 AS INT) AS g, CAST(((255 - x * 6 + l_suppkey * 5) % 256 + 256) % 256 AS INT) AS b FROM placed),
{sql.linear('px', 'l1')}, {sql.linear('sc', 'l2')}""" if kind == "lab" else ""


def _named(out: str) -> str:
    return f"116 * {out}_f1 - 16 AS {out}l, 500 * ({out}_f0 - {out}_f1) AS {out}a, 200 * ({out}_f1 - {out}_f2) AS {out}b"


_DE = f"""{_both("lab")}, f AS MATERIALIZED (SELECT l1.frame_id, l1.idx, {sql.cielab('l1.lr', 'l1.lg', 'l1.lb', 'p')}, {sql.cielab('l2.lr', 'l2.lg', 'l2.lb', 's')} FROM l1 JOIN l2 USING (frame_id, idx)),
t AS (SELECT frame_id, {_named('p')}, {_named('s')} FROM f), c0 AS (SELECT *, sqrt(pa * pa + pb * pb) AS k1, sqrt(sa * sa + sb * sb) AS k2 FROM t),
g0 AS (SELECT *, 1.5e0 - 5e-1 * sqrt(pow((k1 + k2) / 2e0, 7) / (pow((k1 + k2) / 2e0, 7) + pow(25e0, 7))) AS gg FROM c0),
c1 AS (SELECT *, sqrt(pa * gg * pa * gg + pb * pb) AS w1, sqrt(sa * gg * sa * gg + sb * sb) AS w2, {sql.hue('pa * gg', 'pb')} AS h1, {sql.hue('sa * gg', 'sb')} AS h2 FROM g0),
d1 AS (SELECT *, h2 - h1 AS gap, h1 + h2 AS tot, w1 * w2 = 0 AS flat, (w1 + w2) / 2 AS mc, (pl + sl) / 2 AS ml FROM c1),
d2 AS (SELECT *, CASE WHEN flat THEN 0e0 WHEN abs(gap) <= 180 THEN gap WHEN gap > 180 THEN gap - 360 ELSE gap + 360 END AS turn, CASE WHEN flat THEN tot WHEN abs(gap) <= 180 THEN tot / 2 WHEN tot < 360 THEN (tot + 360) / 2 ELSE (tot - 360) / 2 END AS mh FROM d1),
d3 AS (SELECT *, 1 - 1.7e-1 * cos(radians(mh - 30)) + 2.4e-1 * cos(radians(2 * mh)) + 3.2e-1 * cos(radians(3 * mh + 6)) - 2e-1 * cos(radians(4 * mh - 63)) AS tt FROM d2),
d4 AS (SELECT *, (sl - pl) / (1 + 1.5e-2 * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2))) AS dl, (w2 - w1) / (1 + 4.5e-2 * mc) AS dc, 2 * sqrt(w1 * w2) * sin(radians(turn) / 2) / (1 + 1.5e-2 * mc * tt) AS dh,
  -sin(radians(60 * exp(-pow((mh - 275) / 25e0, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25e0, 7))) AS rt FROM d3),
d5 AS (SELECT *, sqrt(dl * dl + dc * dc + dh * dh + rt * dc * dh) AS de FROM d4)"""


@query(f"""{_DE} SELECT frame_id, count(*) AS pixels, {s6(median_de00='quantile_cont(de, 0.5)', p95_de00='quantile_cont(de, 0.95)', max_de00='max(de)', mean_de00='avg(de)')} FROM d5 GROUP BY frame_id""")
def ciede2000_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIEDE2000 between two frames, position by position."""
    rows = colour.with_lab(colour.with_lab(pairs(spark, sf_dir)), "2r", "2g", "2b", out="lab2_")
    rows = colour.with_ciede2000(rows.select("frame_id", *[c for c in rows.columns if c.startswith("lab")]), "lab_", "lab2_")
    return rounded(rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("pixels"), F.percentile("de00", 0.5).alias("median_de00"), F.percentile("de00", 0.95).alias("p95_de00"), F.max("de00").alias("max_de00"), F.avg("de00").alias("mean_de00")))


_GAP = f"abs(({sql.hue('pa', 'pb')}) - ({sql.hue('sa', 'sb')}))"


@query(f"""{_DE}, e AS (SELECT frame_id, CASE WHEN sqrt(pa * pa + pb * pb) < 15 OR sqrt(sa * sa + sb * sb) < 15 THEN 0e0 ELSE least({_GAP}, 360 - {_GAP}) END AS err FROM d5)
SELECT frame_id, {s6(mean_error='avg(err)', max_error='max(err)')}, count(*) FILTER (WHERE err = 0) AS without_hue FROM e GROUP BY frame_id""")
def hue_angle_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle between CIELAB hues, where both are chromatic enough."""
    rows = pairs(spark, sf_dir).select("frame_id", hues.hue_angle_error(("r", "g", "b"), ("2r", "2g", "2b")).alias("err"))
    return rounded(rows.groupBy("frame_id").agg(F.avg("err").alias("mean_error"), F.max("err").alias("max_error"), F.count_if(F.col("err") == 0).alias("without_hue")))


_HUE_HSV = "CASE WHEN mx = mn THEN 0e0 WHEN mx = r THEN ((g - b) / d) - 6 * floor(((g - b) / d) / 6) WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END"


@query(f"""WITH {fixtures.PIXELS_SQL}, m AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS d FROM px),
k AS (SELECT *, {sql.luma()} AS luma, d / 255 AS span, {_HUE_HSV} AS turn, CASE WHEN mx = 0 THEN 0e0 ELSE d / mx END AS sat FROM m),
l AS (SELECT *, CASE WHEN luma > 216e0 / 24389 THEN cbrt(luma) * 116 - 16 ELSE luma * (24389e0 / 27) END AS ls FROM k)
SELECT frame_id, {s6(luma='avg(luma)', span='avg(span)', warm='avg((r - b) / 255e0)', hsv_hue='avg(turn * 60)', hsv_saturation='avg(sat)', lightness='avg(ls)',
  grey='avg(CASE WHEN ls > 8 THEN pow((ls + 16) / 116, 3) ELSE ls * (27e0 / 24389) END)', ramp='avg(CASE WHEN luma <= 2.5e-1 THEN 0e0 WHEN luma >= 7.5e-1 THEN 1e0 ELSE pow((luma - 2.5e-1) / 5e-1, 2) * (3 - 2 * (luma - 2.5e-1) / 5e-1) END)')} FROM l GROUP BY frame_id""")
def encoded_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma, span, warmth, HSV, L* and a smooth ramp, of encoded channels."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hue, sat = colour.hsv(r, g, b)
    rows = fixtures.pixels(spark, sf_dir).select("frame_id", colour.luma(r, g, b).alias("luma"), colour.span(r, g, b).alias("span"), ((r - b) / 255.0).alias("warm"), hue.alias("hsv_hue"), sat.alias("hsv_saturation"))
    rows = rows.withColumn("lightness", colour.lightness_from_grey(F.col("luma")))
    rows = rows.withColumns({"grey": colour.grey_from_lightness(F.col("lightness")), "ramp": colour.smoothstep(F.col("luma"), 0.25, 0.75)})
    return rounded(rows.groupBy("frame_id").agg(*[F.avg(c).alias(c) for c in rows.columns[1:]]))
