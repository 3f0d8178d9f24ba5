"""Queries over palettes: bins, clusters, roles, harmony and risks, prediction and its check.

Clusters by k-means are beyond SQL (tests hold them against plain Python). What works on any palette is
also run on palettes that SQL can make: a frame's five heaviest bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.functions import colour, labels
from tintmill.operators import grade, palettes
from tintmill.plans import sql
from tintmill.plans.frames import _BACK, eight_bit, rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures

HEAVIEST = 5
GRADE = grade.Look(brightness=0.03, contrast=1.12, gamma=1.1)


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.bins(fixtures.scenes(spark, sf_dir), fixtures.WIDTH)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.content_seed(fixtures.scenes(spark, sf_dir))


def heaviest(bins: DataFrame, k: int = HEAVIEST) -> DataFrame:
    """A palette of the k heaviest bins of each frame, the earlier one of equals."""
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.col("n").desc(), "first"))
    own = bins.withColumn("place", place).filter(F.col("place") <= k)
    pool = palettes.pool_of(colour.chroma(F.col("ok_a"), F.col("ok_b")))
    lab = [F.col(f"ok_{c}").alias(c) for c in "Lab"]
    whole = F.sum("n").over(Window.partitionBy("frame_id"))
    return own.select("frame_id", "place", pool.alias("pool"), F.col("n").alias("weight"), (F.col("n") / whole).alias("area"), *lab, "x", "y", F.lit(0.0).alias("spread"))


def _bins_sql(source: str, out: str) -> str:
    return f"""{out}_sums AS (SELECT frame_id, ((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS key, min(idx) AS first, count(*) AS n,
  avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, avg(x / 31e0) AS bx, avg(y / CAST(greatest(1, h - 1) AS DOUBLE)) AS by_ FROM {source} GROUP BY ALL),
{out}_bins AS (SELECT *, CAST(round_even(mr, 0) AS INT) AS r, CAST(round_even(mg, 0) AS INT) AS g, CAST(round_even(mb, 0) AS INT) AS b FROM {out}_sums),
{sql.oklab(out + '_bins', out)}"""


def _heaviest_sql(source: str, out: str) -> str:
    """From bins with okl, oka, okb to a palette."""
    return f"""{out}_top AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, first) AS place FROM {source} QUALIFY place <= {HEAVIEST}),
{out} AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY frame_id) AS DOUBLE) AS area,
  CASE WHEN {sql.hypot('oka', 'okb')} >= 28e-3 THEN 'chromatic' ELSE 'neutral' END AS pool FROM {out}_top)"""


BINS = f"WITH {fixtures.SCENES_SQL}, {_bins_sql('px', 'bin')}"
TOP = f"{BINS}, {_heaviest_sql('bin', 'pal')}"


@query(f"""{BINS} SELECT frame_id, key::BIGINT AS key, first::BIGINT AS first, n, {s6(x='bx', y='by_', l='okl', a='oka', b='okb')},
  r::BIGINT AS r8, g::BIGINT AS g8, bin.b::BIGINT AS b8 FROM bin""")
def palette_frame_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1's input: bins of 5 bits a channel, with their mean colour and place."""
    own = _bins(spark, sf_dir)
    lab = [F.col("ok_L").alias("l"), F.col("ok_a").alias("a"), F.col("ok_b").alias("b")]
    return rounded(own.select("frame_id", F.col("key").cast("long"), F.col("first").cast("long"), "n", "x", "y", *lab, "r8", "g8", "b8"), "frame_id")


@query(f"""WITH {fixtures.SCENES_SQL}, raw AS (SELECT frame_id, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY idx) AS raw FROM px GROUP BY frame_id)
SELECT frame_id, ('0x' || substr(sha256(unhex(raw)), 1, 8))::BIGINT AS seed FROM raw""")
def palette_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 for palettes: the seed that a frame's own bytes give."""
    return _seeds(spark, sf_dir)


@query()
def palette_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven weighted clusters of each frame's bins."""
    return rounded(palettes.clusters(_bins(spark, sf_dir), _seeds(spark, sf_dir)).drop("keys", "pool"), "frame_id")


@query()
def palette_swatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of frames, with the colour, place and role of each swatch."""
    found = palettes.swatches(_bins(spark, sf_dir), _seeds(spark, sf_dir))
    return rounded(palettes.described(found).drop("keys"), "frame_id")


@query()
def palette_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 on clustered palettes: where each swatch goes under a grade, by its members."""
    bins = _bins(spark, sf_dir)
    found = palettes.swatches(bins, _seeds(spark, sf_dir))
    members = found.select("frame_id", "place", F.explode("keys").alias("key")).join(bins, ["frame_id", "key"])
    return palettes.predicted(_graded(members))


def _graded(bins: DataFrame) -> DataFrame:
    """Bins with the graded channels of their rounded colour."""
    own = bins.drop("r", "g", "b").withColumnsRenamed({f"{c}8": c for c in "rgb"})
    return grade.with_grade(own, GRADE)


def _out(c: str) -> str:
    return f"CAST(round_even(pow(least(greatest(({c} / 255e0 - 5e-1) * 112e-2 + 5e-1 + 3e-2, 0e0), 1e0), 1 / 11e-1) * 255, 0) AS BIGINT)"


_ROLES = f"""{TOP}, {_BACK.replace('FROM lab)', 'FROM pal)')}, d AS (SELECT frame_id, place::INT AS place, n, round(area, 4) AS area, okl, bx, by_,
  round({sql.hypot('oka', 'okb')}, 4) AS c, round({sql.hue('oka', 'okb')}, 1) AS hue, {', '.join(f"{eight_bit('back_' + k)} AS {k}8" for k in 'rgb')} FROM back),
p AS (SELECT frame_id, min(place) FILTER (WHERE c >= 28e-3) AS first FROM d GROUP BY frame_id),
roles AS (SELECT d.*, m.c AS pc, m.hue AS ph, okl BETWEEN 4e-1 AND 92e-2 AND d.c BETWEEN 2e-2 AND 115e-3 AND d.hue BETWEEN 25 AND 85 AS skin,
  CASE WHEN d.c < 28e-3 THEN '中性色' WHEN place = p.first THEN '主色'
    WHEN area <= 18e-2 AND (d.c >= m.c * 112e-2 OR least(abs(d.hue - m.hue), 360 - abs(d.hue - m.hue)) >= 90) THEN '强调色' ELSE '辅色' END AS role
  FROM d JOIN p USING (frame_id) LEFT JOIN (SELECT frame_id, place AS first, c, hue FROM d) m USING (frame_id, first))"""


@query(f"""{_ROLES} SELECT frame_id, place::BIGINT AS place, n AS weight, {s6(area='area', chroma='c', hue='hue')}, r8, g8, b8, role, skin,
  c < 28e-3 AND place = 1 AS ground, CASE WHEN okl < 35e-2 THEN '{labels.TONE_ROLES['shadow']}' WHEN okl > 7e-1 THEN '{labels.TONE_ROLES['highlight']}' ELSE '{labels.TONE_ROLES['mid']}' END AS tone,
  (CASE WHEN by_ < 34e-2 THEN '{labels.ROWS['top']}' WHEN by_ > 66e-2 THEN '{labels.ROWS['bottom']}' ELSE '{labels.ROWS['middle']}' END) ||
  (CASE WHEN bx < 38e-2 THEN '{labels.SIDES['left']}' WHEN bx > 62e-2 THEN '{labels.SIDES['right']}' ELSE '{labels.SIDES['centre']}' END) AS position FROM roles""")
def palette_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour, role, tone and place of the swatches of each frame."""
    out = palettes.described(heaviest(_bins(spark, sf_dir)))
    return rounded(out.select("frame_id", "place", "weight", "area", "chroma", "hue", "r8", "g8", "b8", "role", "skin", "ground", "tone", "position"), "frame_id")


_GAP = "least(abs({0} - {1}) % 360, 360 - abs({0} - {1}) % 360)"


@query(f"""{_ROLES}, hs AS (SELECT frame_id, coalesce(list(hue ORDER BY place) FILTER (WHERE c >= 28e-3), []) AS hues FROM roles GROUP BY frame_id),
gs AS (SELECT *, list_transform(hues[2:], lambda h: {_GAP.format('h', 'hues[1]')}) AS gaps, len(hues) AS k FROM hs)
SELECT frame_id, {s6(widest='CASE WHEN k < 2 THEN 0e0 ELSE round(list_max(gaps), 1) END')}, CASE WHEN k < 2 THEN 'monochrome' ELSE {sql.cases('list_max(gaps)', labels.HUE_TIERS, op='<=')} END AS tier,
  CASE WHEN k < 3 THEN NULL WHEN len(list_filter(gaps, lambda d: d BETWEEN 120 AND 150)) > 0 AND len(list_filter(gaps, lambda d: d BETWEEN 160 AND 200)) > 0 THEN 'split complementary'
    WHEN len(list_filter(hues[1:3], lambda a: len(list_filter(hues, lambda b: abs({_GAP.format('a', 'b')} - 120) < 30)) = 0)) = 0 THEN 'triad' END AS compound,
  k >= 2 AND len(list_filter(hues, lambda h: h BETWEEN 20 AND 115)) > 0 AND len(list_filter(hues, lambda h: h BETWEEN 190 AND 300)) > 0 AS split FROM gs""")
def palette_harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the hues of a palette stand to its largest one."""
    return rounded(palettes.harmony(palettes.described(heaviest(_bins(spark, sf_dir)))), "frame_id")


@query(f"""{_ROLES}, own AS (SELECT frame_id, sum(c * area) FILTER (WHERE c >= 28e-3) / greatest(1e-6, sum(area) FILTER (WHERE c >= 28e-3)) AS mean, count(*) FILTER (WHERE c >= 28e-3) AS k, bool_or(skin) AS skin,
  list(CASE WHEN role = '强调色' AND area > 2e-1 THEN 'accent too large ' || place END ORDER BY place) AS accents,
  flatten(list([CASE WHEN okl > 9e-1 AND c > 5e-2 THEN 'tinted highlight ' || place END, CASE WHEN okl < 1e-1 AND area > 8e-2 THEN 'near black ' || place END,
    CASE WHEN by_ < 34e-2 AND area > 2e-1 THEN 'flat top ' || place END] ORDER BY place)) AS each FROM roles GROUP BY frame_id),
f AS (SELECT frame_id, list_filter([CASE WHEN k = 0 THEN 'no chroma' WHEN mean < 42e-3 THEN 'low chroma' END, CASE WHEN skin THEN 'skin' END] || accents || each, lambda s: s IS NOT NULL) AS found FROM own)
SELECT frame_id, CASE WHEN len(found) = 0 THEN 'none' ELSE array_to_string(found[1:6], ', ') END AS risks FROM f""")
def palette_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may go wrong with a palette, six at most."""
    out = palettes.risks(palettes.described(heaviest(_bins(spark, sf_dir))))
    return out.select("frame_id", F.array_join("risks", ", ").alias("risks"))


def _nearest_sql(source: str, key: str) -> str:
    """Rows of source with the place of their nearest swatch, of the same pool if there is one."""
    far = "pow(s.okl - p.okl, 2) + pow(s.oka - p.oka, 2) + pow(s.okb - p.okb, 2)"
    own = f"CASE WHEN {sql.hypot('s.oka', 's.okb')} >= 28e-3 THEN 'chromatic' ELSE 'neutral' END"
    return f"""(SELECT s.*, p.place FROM {source} s JOIN pal p USING (frame_id)
  QUALIFY row_number() OVER (PARTITION BY s.frame_id, s.{key} ORDER BY p.pool <> {own}, {far}, p.place) = 1)"""


def _assigned(rows: DataFrame, palette: DataFrame) -> DataFrame:
    """Rows (frame_id, ok_L, ok_a, ok_b) with the place of their nearest swatch in their pool."""
    lab = {c: F.col(f"ok_{c}") for c in "Lab"}
    own = palettes.nearest(lab, F.col("palette"), palettes.pool_of(colour.chroma(lab["a"], lab["b"])))
    return rows.join(palettes.palette_arrays(palette), "frame_id").withColumn("place", own["place"]).drop("palette")


_MOVED = f"""moved AS (SELECT frame_id, place, sum(n)::BIGINT AS n, {', '.join(f"CAST(round_even(sum({_out(c)} * n) / CAST(sum(n) AS DOUBLE), 0) AS INT) AS {c}" for c in 'rgb')}
  FROM {_nearest_sql('bin', 'key')} GROUP BY frame_id, place)"""


@query(f"{TOP}, {_MOVED} SELECT frame_id, place::BIGINT AS place, n, r::BIGINT AS r8, g::BIGINT AS g8, b::BIGINT AS b8 FROM moved")
def palette_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each swatch goes under a grade, as the mean of its graded members."""
    bins = _bins(spark, sf_dir)
    return rounded(palettes.predicted(_graded(_assigned(bins, heaviest(bins)))), "frame_id")


@query(f"""{TOP}, {_MOVED}, {sql.oklab('moved', 'want')}, {sql.oklab('px', 'pix')},
seen AS (SELECT frame_id, place, count(*) AS pixels, {', '.join(f"CAST(round_even(avg({_out(c)}), 0) AS INT) AS {c}" for c in 'rgb')}
  FROM {_nearest_sql('pix', 'idx')} GROUP BY frame_id, place), {sql.oklab('seen', 'got')},
e AS (SELECT got.frame_id, pixels, sqrt(pow(got.okl - want.okl, 2) + pow(got.oka - want.oka, 2) + pow(got.okb - want.okb, 2)) AS e FROM got JOIN want USING (frame_id, place))
SELECT frame_id, count(*) AS swatches, sum(pixels)::BIGINT AS pixels, {s6(mean_error='avg(e)', max_error='max(e)')}, CASE WHEN avg(e) < 2e-2 THEN 'holds' WHEN avg(e) < 5e-2 THEN 'nearly' ELSE 'unreliable' END AS verdict FROM e GROUP BY frame_id""")
def palette_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction against what the pixels of each swatch became, pool by pool."""
    bins = _bins(spark, sf_dir)
    palette = heaviest(bins)
    want = colour.with_oklab(palettes.predicted(_graded(_assigned(bins, palette))), "r8", "g8", "b8", out="want_")
    px = _assigned(colour.with_oklab(fixtures.scenes(spark, sf_dir)), palette)
    mean = [F.rint(F.avg(f"out_{c}")).cast("int").alias(f"{c}8") for c in "rgb"]
    got = grade.with_grade(px, GRADE).groupBy("frame_id", "place").agg(F.count(F.lit(1)).alias("pixels"), *mean)
    both = colour.with_oklab(got, "r8", "g8", "b8", out="got_").drop("r8", "g8", "b8").join(want, ["frame_id", "place"])
    error = colour.delta_e_ok("got_", "want_")
    out = both.groupBy("frame_id").agg(F.count(F.lit(1)).alias("swatches"), F.sum("pixels").alias("pixels"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))
    return rounded(out.withColumn("verdict", palettes.verdict(F.col("mean_error"))), "frame_id")


@query(f"""{TOP}, after AS (SELECT frame_id, idx, x, y, h, {', '.join(f'{_out(c)} AS {c}' for c in 'rgb')} FROM px), {_bins_sql('after', 'nbin')}, {_heaviest_sql('nbin', 'npal')},
m AS (SELECT p.frame_id, p.place, q.place AS other, sqrt(pow(p.okl - q.okl, 2) + pow(p.oka - q.oka, 2) + pow(p.okb - q.okb, 2)) AS e, q.area - p.area AS drift FROM pal p JOIN npal q USING (frame_id)
  QUALIFY row_number() OVER (PARTITION BY p.frame_id, p.place ORDER BY e, q.place) = 1)
SELECT frame_id, place::BIGINT AS place, other::BIGINT AS other, {s6(delta_e='e', area_drift='drift')} FROM m""")
def palette_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each swatch beside the nearest one of the graded frame's palette."""
    graded = grade.with_grade(fixtures.scenes(spark, sf_dir), GRADE).select("frame_id", "idx", "x", "y", "h", *[F.col(f"out_{c}").alias(c) for c in "rgb"])
    return rounded(palettes.paired(heaviest(_bins(spark, sf_dir)), heaviest(palettes.bins(graded, fixtures.WIDTH))), "frame_id")
