"""Queries over records: rankings, ledgers, blind trials, references, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.operators import records
from tintmill.plans.frames import rounded, s6
from tintmill.plans.registry import query
from tintmill.sources import fixtures
from tintmill.sources.fixtures import table

RECIPES = f"WITH {fixtures.RECIPES_SQL}"
AVOID = "warm, vivid,faded,warm,noisy"
KNOWN, UNKNOWN = records.avoid_terms(AVOID)
_AGAINST = "array_to_string(list_filter([CASE WHEN temperature > 3e-2 THEN 'warm' END, CASE WHEN saturation > 1.12e0 THEN 'vivid' END, CASE WHEN saturation < 9e-1 THEN 'faded' END], lambda x: x IS NOT NULL), ',')"


@query(f"{RECIPES}, a AS (SELECT recipe_id, {_AGAINST} AS reasons FROM recipes) SELECT recipe_id, reasons, reasons <> '' AS avoided, 'noisy' AS unknown FROM a")
def avoid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request to avoid speaks against; terms not known are said, not dropped."""
    rows = fixtures.recipes(spark, sf_dir).select("recipe_id", records.avoided_for(KNOWN).alias("reasons"))
    return rows.select("recipe_id", "reasons", (F.col("reasons") != "").alias("avoided"), F.lit(",".join(UNKNOWN)).alias("unknown"))


TERMS = "暖调, 鲜艳，褪色,偏蓝,暖调,noisy"
_TAG = "['warm amber', 'Cool', 'neutral', 'gold', 'monochrome', 'cyan', NULL][recipe_id % 7 + 1]"
_TAGGED = """array_to_string(list_filter([CASE WHEN temperature > 3e-2 OR coalesce(regexp_matches(lower(tag), 'warm|amber|gold|orange|red'), FALSE) THEN '暖调' END, CASE WHEN saturation > 1.12e0 THEN '鲜艳' END,
  CASE WHEN saturation < 9e-1 THEN '褪色' END, CASE WHEN temperature < -3e-2 OR coalesce(regexp_matches(lower(tag), 'cool|blue|cyan'), FALSE) THEN '偏蓝' END], lambda x: x IS NOT NULL), ',')"""


@query(f"{RECIPES}, t AS (SELECT *, {_TAG} AS tag FROM recipes) SELECT recipe_id, {_TAGGED} AS reasons, 'noisy' AS unknown, saturation <= 5e-2 OR coalesce(tag = 'monochrome', FALSE) AS needs_intent FROM t")
def avoid_terms_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed terms, by a recipe's numbers and its colour tag; and looks that must be asked for."""
    known, unknown = records.avoid_terms(TERMS)
    tags = F.array(*[F.lit(v).cast("string") for v in ("warm amber", "Cool", "neutral", "gold", "monochrome", "cyan", None)])
    rows = fixtures.recipes(spark, sf_dir).withColumn("tag", F.get(tags, (F.col("recipe_id") % 7).cast("int")))
    return rows.select("recipe_id", records.avoided_for(known).alias("reasons"), F.lit(",".join(unknown)).alias("unknown"), records.needs_intent(F.col("saturation"), F.col("tag")).alias("needs_intent"))


LEDGER_SQL = "ledger AS (SELECT sha256(CAST(doc_id % 50 AS VARCHAR)) AS source_sha, doc_id % 11 AS recipe_id, CASE doc_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 55 ELSE 80 END AS strength, doc_id AS recorded, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS verdict FROM labels)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        F.sha2((doc % 50).cast("string"), 256).alias("source_sha"), (doc % 11).alias("recipe_id"), F.when(doc % 3 == 0, 30).when(doc % 3 == 1, 55).otherwise(80).cast("long").alias("strength"),
        doc.alias("recorded"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("verdict"),
    )


@query(f"WITH {LEDGER_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY source_sha, recipe_id ORDER BY recorded DESC) AS n FROM ledger) SELECT source_sha, recipe_id, recorded, CAST(strength AS BIGINT) AS strength, verdict FROM k WHERE n = 1")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last verdict on a recipe for a source."""
    return records.latest(ledger(spark, sf_dir), ["source_sha", "recipe_id"], "recorded")


@query(f"""{RECIPES}, {LEDGER_SQL}, no AS (SELECT DISTINCT recipe_id, strength FROM ledger WHERE verdict = 'rejected'), op AS (SELECT recipe_id, CASE WHEN saturation > 1 THEN 55 ELSE 80 END AS strength FROM recipes)
SELECT recipe_id, CAST(strength AS BIGINT) AS strength, CASE WHEN (recipe_id, strength) IN (SELECT (recipe_id, strength) FROM no) THEN 'rejected' WHEN recipe_id IN (SELECT recipe_id FROM no) THEN 'rejected_elsewhere' ELSE 'new' END AS memory FROM op""")
def feedback_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that were rejected before, at this or at another strength."""
    options = fixtures.recipes(spark, sf_dir).select("recipe_id", F.when(F.col("saturation") > 1, 55).otherwise(80).cast("long").alias("strength"))
    return records.remembered(options, ledger(spark, sf_dir).filter("verdict = 'rejected'"))


@query(f"""WITH {LEDGER_SQL}, op AS (SELECT DISTINCT source_sha, recipe_id, 55 AS strength, recipe_id * 5 % 11 AS place FROM ledger), no AS (SELECT DISTINCT source_sha, recipe_id, strength FROM ledger WHERE verdict = 'rejected'),
m AS (SELECT op.*, no.recipe_id IS NOT NULL AS rejected FROM op LEFT JOIN no USING (source_sha, recipe_id, strength))
SELECT source_sha, recipe_id, rejected, row_number() OVER (PARTITION BY source_sha ORDER BY rejected, place, recipe_id) AS new_place FROM m""")
def feedback_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options rejected for the same source at the same strength go behind the others."""
    book = ledger(spark, sf_dir)
    options = book.select("source_sha", "recipe_id").distinct().withColumns({"strength": F.lit(55), "place": F.col("recipe_id") * 5 % 11})
    return rounded(records.demoted(options, book).select("source_sha", "recipe_id", "rejected", "new_place"))


_POINTS = (0.0, 0.06, 0.25, 0.5, 0.75, 1.0)
_MOVED = ", ".join(f"round(greatest(0e0, least(1e0, {x!r} + midpoint_ev * {max(0.0, 1 - x / 0.5) * min(1.0, x / 0.12)!r} / 4 + temperature * {max(0.0, (x - 0.5) / 0.5)!r})), 6) + 0e0 AS y{k}" for k, x in enumerate(_POINTS))


@query(f"{RECIPES} SELECT recipe_id, {_MOVED} FROM recipes")
def adjusted_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve whose shadows and highlights a user moved."""
    points = F.array(*[F.array(F.lit(x), F.lit(x)) for x in _POINTS])
    rows = fixtures.recipes(spark, sf_dir).withColumn("curve", records.adjusted_curve(points, F.col("midpoint_ev") / 4, F.col("temperature")))
    return rounded(rows.select("recipe_id", *[F.col("curve")[k][1].alias(f"y{k}") for k in range(len(_POINTS))]))


_BANDS = "['r', 'y', 'g', 'c', 'b', 'm']"


@query(f"""{RECIPES}, own AS (SELECT recipe_id, {_BANDS}[recipe_id % 6 + 1] AS band, midpoint_ev AS h, temperature AS s, 1e-2 AS i FROM recipes), mine AS (SELECT recipe_id, {_BANDS}[recipe_id % 4 + 1] AS band, temperature AS h, 2e-2 AS s, midpoint_ev AS i FROM recipes)
SELECT recipe_id, band, {s6(hue='coalesce(a.h, 0) + coalesce(b.h, 0)', saturation='coalesce(a.s, 0) + coalesce(b.s, 0)', intensity='coalesce(a.i, 0) + coalesce(b.i, 0)')} FROM own a FULL JOIN mine b USING (recipe_id, band)""")
def merged_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe's shifts of hue bands and a user's, band by band."""
    bands = F.array(*map(F.lit, "rygcbm"))
    rows = fixtures.recipes(spark, sf_dir)
    own = rows.select("recipe_id", F.get(bands, (F.col("recipe_id") % 6).cast("int")).alias("band"), F.col("midpoint_ev").alias("hue"), F.col("temperature").alias("saturation"), F.lit(0.01).alias("intensity"))
    mine = rows.select("recipe_id", F.get(bands, (F.col("recipe_id") % 4).cast("int")).alias("band"), F.col("temperature").alias("hue"), F.lit(0.02).alias("saturation"), F.col("midpoint_ev").alias("intensity"))
    return rounded(records.merged_bands(own, mine))


@query(f"""{RECIPES}, o AS (SELECT p_partkey AS recipe_id, CASE WHEN p_size > 20 THEN 'video' ELSE 'photo' END AS media, CASE WHEN p_size % 2 = 0 THEN p_size / 50e0 END AS saturation, CASE WHEN p_size % 3 = 0 THEN -1e-1 END AS temperature FROM part)
SELECT r.recipe_id, {s6(saturation='coalesce(o.saturation, r.saturation)', temperature='coalesce(o.temperature, r.temperature)', midpoint_ev='midpoint_ev')} FROM recipes r LEFT JOIN o ON o.recipe_id = r.recipe_id AND o.media = 'video'""")
def media_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes as video runs them."""
    size = F.col("p_size")
    overrides = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("recipe_id"), F.when(size > 20, "video").otherwise("photo").alias("media"), F.when(size % 2 == 0, size / 50.0).alias("saturation"), F.when(size % 3 == 0, -0.1).alias("temperature")
    )
    rows = fixtures.recipes(spark, sf_dir).select("recipe_id", "saturation", "temperature", "midpoint_ev")
    return rounded(records.overridden(rows, overrides, "video", ["saturation", "temperature"]))


@query(f"""WITH {fixtures.PIXELS_SQL}, a AS (SELECT frame_id, idx FROM px), m AS (SELECT frame_id, idx FROM px WHERE NOT (frame_id % 10 = 3 AND y = 1)), c AS (SELECT frame_id, idx FROM px WHERE NOT (frame_id % 10 = 4 AND x = 0)),
u AS (SELECT frame_id, idx, count(*) AS parts FROM (SELECT * FROM a UNION ALL SELECT * FROM m UNION ALL SELECT * FROM c) GROUP BY ALL) SELECT frame_id, count(*) FILTER (WHERE parts = 3) AS pixels, bool_and(parts = 3) AS complete FROM u GROUP BY frame_id""")
def zip_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, mask and result place by place; frames where one of them lacks some."""
    rows = fixtures.pixels(spark, sf_dir)
    mask, result = rows.filter("not (frame_id % 10 = 3 and y = 1)"), rows.filter("not (frame_id % 10 = 4 and x = 0)")
    return records.zipped(rows, mask, result, ["frame_id", "idx"])


_TAGS = ("srgb", "untagged", "display-p3", "rec2020", "untagged-video", "rec709-sdr", None)
_CURVES = ("bt709", "log100", None)


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"""WITH t AS (SELECT p_partkey AS source_id, {_list(_TAGS)}[p_partkey % 7 + 1] AS profile, {_list(_CURVES)}[p_partkey % 3 + 1] AS transfer, p_size > 45 AS hdr FROM part)
SELECT source_id, CASE WHEN hdr THEN 'hdr' WHEN transfer IN ('log100', 'log316') THEN 'log/raw' WHEN profile IN ('srgb', 'display-p3', 'rec709-sdr', 'rec709-sdr-inferred', 'untagged', 'untagged-video') THEN 'display-referred' ELSE 'unknown' END AS state,
  CASE WHEN hdr OR transfer IN ('log100', 'log316') OR profile IN ('srgb', 'display-p3', 'rec709-sdr', 'rec709-sdr-inferred') THEN 'metadata' WHEN profile LIKE 'untagged%' THEN 'user-confirmed-assumption' ELSE 'insufficient-metadata' END AS confidence FROM t""")
def input_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what inputs are by their tags, untagged ones being assumed ordinary on request."""
    key = F.col("p_partkey")
    profile, transfer = (F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int")) for values in (_TAGS, _CURVES))
    state, confidence = records.input_truth(profile, transfer, F.col("p_size") > 45, assume_sdr=True)
    return table(spark, sf_dir, "part").select(key.alias("source_id"), state.alias("state"), confidence.alias("confidence"))


_ORDERED = f"WITH {fixtures.PIXELS_SQL}, o AS (SELECT frame_id, list_sort(list(g)) AS v FROM px GROUP BY frame_id)"


@query(f"{_ORDERED} SELECT frame_id, {', '.join(f'CAST(v[least(len(v) - 1, CAST(floor(len(v) * {p}) AS BIGINT)) + 1] AS BIGINT) AS trunc_{n}, CAST(v[CAST(round_even((len(v) - 1) * {p}, 0) AS BIGINT) + 1] AS BIGINT) AS round_{n}' for n, p in (('05', 0.05), ('50', 0.5), ('95', 0.95)))} FROM o")
def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: percentiles that are values of the frame, by both ways to find their place."""
    picks = [records.nearest_rank(F.col("g"), p, how).alias(f"{how}_{n}") for n, p in (("05", 0.05), ("50", 0.5), ("95", 0.95)) for how in ("trunc", "round")]
    return rounded(fixtures.pixels(spark, sf_dir).groupBy("frame_id").agg(*picks))


SCORED = f"{RECIPES}, sc AS (SELECT media, recipe_id, tone_tag, color_tag, round(100 - abs(midpoint_ev) * 30 - abs(saturation - 1) * 20, 6) AS score FROM recipes)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.lit(100) - F.abs("midpoint_ev") * 30 - F.abs(F.col("saturation") - 1) * 20
    return fixtures.recipes(spark, sf_dir).select("media", "recipe_id", "tone_tag", "color_tag", F.round(score, 6).alias("score"))


@query(f"""{SCORED}, t AS (SELECT *, row_number() OVER (PARTITION BY media, color_tag, tone_tag ORDER BY score DESC, recipe_id) AS k FROM sc),
p AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, score DESC, recipe_id) AS place FROM t) SELECT media, recipe_id, tone_tag, color_tag, {s6(score='score')}, place FROM p WHERE place <= 3""")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 O3: the three best recipes of a medium, no two alike while others are left."""
    return rounded(records.diverse_first(scored(spark, sf_dir), "media", ["color_tag", "tone_tag"], 3))


@query(f"{SCORED} SELECT media, recipe_id, {s6(score='score')}, row_number() OVER (PARTITION BY media ORDER BY CASE WHEN color_tag = 3 THEN 0 ELSE 1 END, score DESC, recipe_id) AS place FROM sc")
def scene_first_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: recipes made for the scene come first; no score changes."""
    from pyspark.sql import Window

    order = Window.partitionBy("media").orderBy(F.when(F.col("color_tag") == 3, 0).otherwise(1), F.col("score").desc(), "recipe_id")
    return rounded(scored(spark, sf_dir).select("media", "recipe_id", "score", F.row_number().over(order).alias("place")))


@query("""WITH rp AS (SELECT o_custkey AS recipe_id, [30, 55, 80, 100][o_orderkey % 4 + 1] AS level, CAST(floor(o_totalprice) AS BIGINT) % 3 > 0 AS passed FROM orders),
s AS (SELECT recipe_id, max(CASE WHEN level <= 80 AND passed THEN level END) AS selected FROM rp GROUP BY recipe_id) SELECT recipe_id, CAST(selected AS BIGINT) AS selected, CASE WHEN selected IS NULL THEN 'blocked' WHEN selected = 80 THEN 'unchanged' ELSE 'downgraded' END AS status FROM s""")
def safe_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest passing strength that is not above the requested one."""
    level = F.get(F.array(*[F.lit(v).cast("long") for v in (30, 55, 80, 100)]), (F.col("o_orderkey") % 4).cast("int"))
    reports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recipe_id"), level.alias("level"), (F.floor("o_totalprice") % 3 > 0).alias("passed"))
    return records.highest_safe(reports, 80)


TRIALS_SQL = "trials AS (SELECT o_orderkey AS trial, o_custkey % 11 AS left_id, (o_custkey + 1 + o_orderkey % 10) % 11 AS right_id, o_orderkey % 5 = 0 AS probe, CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 11 WHEN 1 THEN (o_custkey + 1 + o_orderkey % 10) % 11 END AS winner FROM orders)"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, left = F.col("o_orderkey"), F.col("o_custkey") % 11
    right = (F.col("o_custkey") + 1 + key % 10) % 11
    return table(spark, sf_dir, "orders").select(key.alias("trial"), left.alias("left_id"), right.alias("right_id"), (key % 5 == 0).alias("probe"), F.when(key % 3 == 0, left).when(key % 3 == 1, right).alias("winner"))


@query(f"WITH {TRIALS_SQL}, u AS (SELECT left_id AS recipe_id, winner FROM trials UNION ALL SELECT right_id, winner FROM trials) SELECT recipe_id, count(*) AS appearances, count(*) FILTER (WHERE winner = recipe_id) AS wins, {s6(win_rate='count(*) FILTER (WHERE winner = recipe_id) / CAST(count(*) AS DOUBLE)')} FROM u GROUP BY recipe_id")
def blind_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each recipe was shown and preferred."""
    return rounded(records.tally(trials(spark, sf_dir)))


@query(f"""WITH {TRIALS_SQL}, pr AS (SELECT *, least(left_id, right_id) AS low, greatest(left_id, right_id) AS high FROM trials), f AS (SELECT low, high, arg_max_null(winner, trial) AS before FROM pr WHERE NOT probe GROUP BY ALL)
SELECT low, high, count(*) AS probes, count(*) FILTER (WHERE winner IS NOT DISTINCT FROM before) AS agreed FROM pr JOIN f USING (low, high) WHERE probe GROUP BY ALL""")
def blind_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs shown again, and how often the choice was the same."""
    return records.probe_agreement(trials(spark, sf_dir))


@query(f"""WITH k AS (SELECT doc_id, quality AS expected FROM labels), r AS (SELECT doc_id, 1 - toxic AS actual FROM labels WHERE doc_id % 5 <> 0)
SELECT count(*) AS total, count(*) FILTER (WHERE actual = expected) AS correct, {s6(accuracy='count(*) FILTER (WHERE actual = expected) / CAST(greatest(1, count(*)) AS DOUBLE)')}, count(*) FILTER (WHERE actual = expected) >= 7.5e-1 * greatest(1, count(*)) AS target_met FROM k LEFT JOIN r USING (doc_id)""")
def pairing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against a key; a missing answer is wrong."""
    rows = table(spark, sf_dir, "labels")
    said = rows.filter("doc_id % 5 <> 0").select("doc_id", (F.lit(1) - F.col("toxic")).alias("actual"))
    sums = rows.select("doc_id", F.col("quality").alias("expected")).join(said, "doc_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("actual") == F.col("expected")).alias("correct"))
    rate = F.col("correct") / F.greatest(F.col("total"), F.lit(1))
    return rounded(sums.withColumns({"accuracy": rate, "target_met": rate >= 0.75}))


LINKS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("nation", "n_regionkey", "region", "r_regionkey"))


def _link(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{child}' AS "check", (SELECT count(*) FROM {child} WHERE {key} NOT IN (SELECT {parent_key} FROM {parent})) AS rows_lost, (SELECT count(DISTINCT {key}) FROM {child} WHERE {key} NOT IN (SELECT {parent_key} FROM {parent})) AS keys_lost,
  (SELECT count(DISTINCT {parent_key}) FROM {parent} WHERE {parent_key} NOT IN (SELECT {key} FROM {child})) AS unused"""


@query(" UNION ALL ".join(_link(*link) for link in LINKS))
def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead nowhere, and keys that only one side has."""
    return records.stacked({child: records.dangling(table(spark, sf_dir, child), key, table(spark, sf_dir, parent), parent_key) for child, key, parent, parent_key in LINKS})


@query("SELECT p_name AS name, count(*) AS n, min(p_partkey) AS first_id, count(*) FILTER (WHERE p_size / 50e0 * 8e-1 + 6e-1 > 1.3e0) AS out_of_bounds FROM part GROUP BY p_name HAVING count(*) > 1")
def recipe_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names used twice, and parameters beyond their bounds."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"), F.count_if(F.col("p_size") / 50.0 * 0.8 + 0.6 > 1.3).alias("out_of_bounds")).filter("n > 1")


FIELDS = ["part", "brand", "size"]
PLAN_SQL = """plans AS (SELECT p_partkey AS part, p_brand AS brand, p_size AS size FROM part), js AS (SELECT *, '{"brand":"' || brand || '","part":"' || part || '","size":"' || size || '"}' AS j FROM plans)"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


@query(f"WITH {PLAN_SQL}, sd AS (SELECT *, sha256(j) AS h, CAST('0x' || substr(sha256(j), 1, 8) AS BIGINT) AS seed FROM js) SELECT part, substr(h, 1, 16) AS fingerprint, seed, (seed * 1664525 + 1013904223) % 4294967296 AS next_state FROM sd")
def plan_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a plan as sorted JSON, the seed from it and the generator's next state."""
    text = records.canonical(FIELDS)
    rows = plans(spark, sf_dir).select("part", records.fingerprint(text).alias("fingerprint"), records.seed(text).alias("seed"))
    return rows.withColumn("next_state", records.drawn(F.col("seed")))


@query("""WITH now AS (SELECT p_partkey AS part, p_brand AS brand, p_size + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 17 <> 5), d AS (
  SELECT b.p_partkey AS part, n.part IS NULL AS missing, CASE WHEN n.part IS NULL THEN 'brand,part,size' WHEN n.size <> b.p_size THEN 'size' ELSE '' END AS changed FROM part b LEFT JOIN now n ON n.part = b.p_partkey)
SELECT part, missing, changed, changed = '' AS valid FROM d""")
def tamper_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound plans against what is found now: missing ones and every field that differs."""
    bound = plans(spark, sf_dir)
    found = bound.filter("part % 17 <> 5").withColumn("size", F.col("size") + F.when(F.col("part") % 13 == 0, 1).otherwise(0))
    rows = bound.select("part", F.struct(*FIELDS).alias("bound")).join(found.select("part", F.struct(*FIELDS).alias("found")), "part", "left")
    fields = records.changed(sorted(FIELDS), "bound", "found")
    return rows.select("part", F.col("found").isNull().alias("missing"), fields.alias("changed"), (fields == "").alias("valid"))
