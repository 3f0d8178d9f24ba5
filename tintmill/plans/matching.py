"""Queries over requests: words found in recipes, scores, policies, evaluation, one-to-one matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.operators import matching as m
from tintmill.plans.frames import rounded, s6
from tintmill.plans.registry import query
from tintmill.sources.fixtures import table

#: What users ask for: scenes, subjects, problems, preferences.
REQUESTS = (
    ("cold morning", "widget", "镜头匹配 small", "Small, cold"),
    ("night", "economy_gear", "", "brand#13"),
    (None, "standard", "noisy", "warm / promo"),
)
#: Recipes that one task scores, about.
TASK_CARDS = 5_000
KINDS = ("scenes", "subjects", "problems", "preferences")
POLICIES = m.Policies(
    rules=(
        m.Policy("cold", ("warm up", "hold skin"), ("cool down",)),
        m.Policy("small", ("hold skin", "sharpen"), ("vignette", "cool down")),
        m.Policy("ECO nomy", ("lift shadows",)),
        m.Policy("standard", (), ("grain",)),
    ),
    synonyms={"hot": "cold"},
)


def norm(text: str) -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), '{m.SEPARATORS}', '', 'g')"


def hits(text: str, words: str) -> str:
    return f"list_filter({words}, lambda w: length({norm('w')}) >= 2 AND length({norm(text)}) > 0 AND (contains({norm(text)}, {norm('w')}) OR contains({norm('w')}, {norm(text)})))"


CARDS_SQL = """cards AS (SELECT p_partkey AS recipe_id, p_brand AS brand, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN '基础校正' ELSE p_brand END AS family, [p_type] AS aliases,
  string_split(p_name, ' ') AS scenes, CASE WHEN p_partkey % 4 = 0 THEN ['全部'] ELSE [p_type] END AS subjects,
  {'preferences': string_split(p_name, ' '), 'problems': [p_brand, 'noisy'], 'scenes': [p_type, 'night'], 'subjects': string_split(p_name, ' '), 'exclusions': ['promo', 'gear']} AS rule FROM part)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    lists = {"preferences": words, "problems": F.array("p_brand", F.lit("noisy")), "scenes": F.array("p_type", F.lit("night")), "subjects": words, "exclusions": F.array(F.lit("promo"), F.lit("gear"))}
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("recipe_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 9 == 0, m.BASELINE).otherwise(F.col("p_brand")).alias("family"),
        F.array("p_type").alias("aliases"), words.alias("scenes"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(m.EVERYTHING))).otherwise(F.array("p_type")).alias("subjects"),
        F.struct(*[c.alias(n) for n, c in lists.items()]).alias("rule"),
    )


def _said(v: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"


def _points(kind: str) -> str:
    n = f"len({hits('q_' + kind, 'rule.' + kind)})"
    w = m.WEIGHTS[kind]
    return f"CASE WHEN {n} > 0 THEN {w} + ({n} - 1) * {w} * {m.AGAIN} ELSE 0e0 END"


_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(map(_said, r))})" for k, r in enumerate(REQUESTS)) + ") t(request, " + ", ".join("q_" + k for k in KINDS) + "))"
SCORED_SQL = f"""{CARDS_SQL}, {_ASKED}, scored AS (SELECT recipe_id, brand, name, family, CAST(request AS BIGINT) AS request, array_to_string({hits('q_preferences', 'rule.preferences')}, ',') AS matched,
  round({' + '.join(map(_points, m.WEIGHTS))} + CASE WHEN len({hits('q_scenes', 'scenes')}) > 0 THEN 5e0 ELSE 0e0 END
  + CASE WHEN len({hits('q_subjects', 'subjects')}) > 0 AND NOT list_contains(subjects, '全部') THEN 3e0 ELSE 0e0 END
  + CASE WHEN len({hits('q_preferences', '[name, family] || aliases')}) > 0 THEN 12e0 ELSE 0e0 END
  - CASE WHEN len({hits("concat_ws(' ', q_scenes, q_subjects, q_problems, q_preferences)", 'rule.exclusions')}) > 0 THEN 15e0 ELSE 0e0 END
  + CASE WHEN family = '基础校正' AND q_problems <> '' THEN CASE WHEN contains(q_problems, '不一致') OR contains(q_problems, '镜头匹配') THEN 26e0 ELSE 1e0 END ELSE 0e0 END, 2) AS score FROM cards, asked)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recipe beside each of a few requests, which are literals. A recipe costs much and takes little room, so
    a file of many is dealt out to tasks of TASK_CARDS."""
    asked = [F.struct(F.lit(k).cast("long").alias("request"), *[F.lit(v).cast("string").alias(n) for n, v in zip(KINDS, r)]) for k, r in enumerate(REQUESTS)]
    parts = max(1, -(-table(spark, sf_dir, "part").count() // TASK_CARDS))
    rows = cards(spark, sf_dir).repartition(parts).withColumn("q", F.explode(F.array(*asked)))
    request = {k: F.col("q." + k) for k in KINDS}
    matched = F.array_join(m.hits(request["preferences"], F.col("rule.preferences")), ",")
    return rows.select("recipe_id", "brand", "name", "family", "q.request", matched.alias("matched"), m.score(request).alias("score"))


@query(f"WITH {SCORED_SQL} SELECT recipe_id, request, matched, {s6(score='score')} FROM scored")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each recipe answers a request, by words found either way."""
    return rounded(scored(spark, sf_dir).select("recipe_id", "request", "matched", "score"))


def _rule_rows(kind: str) -> str:
    return ", ".join(f"('{r.problem}', '{a}', {k * 100 + j})" for k, r in enumerate(POLICIES.rules) for j, a in enumerate(getattr(r, kind)))


def policy_sql(kind: str, source: str, key: str, text: str) -> str:
    said = norm(text)
    for a, b in POLICIES.synonyms.items():
        said = f"replace({said}, '{a}', '{b}')"
    return f"""{kind}_first AS (SELECT {key}, action, min(place) AS place FROM {source} JOIN (VALUES {_rule_rows(kind)}) v(problem, action, place) ON contains({said}, {norm('problem')}) GROUP BY ALL),
{kind}_of AS (SELECT {key}, list(action ORDER BY place) AS actions FROM {kind}_first GROUP BY {key})"""


_PROBLEMS = "said AS (SELECT p_partkey AS recipe_id, p_name || ' - ' || p_type AS text FROM part)"


@query(f"""WITH {_PROBLEMS}, {policy_sql('required', 'said', 'recipe_id', 'text')}, {policy_sql('forbidden', 'said', 'recipe_id', 'text')}
SELECT recipe_id, coalesce(array_to_string(r.actions, ','), '') AS required, coalesce(array_to_string(f.actions, ','), '') AS forbidden
FROM said LEFT JOIN required_of r USING (recipe_id) LEFT JOIN forbidden_of f USING (recipe_id)""")
def review_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that a problem asks for and those it forbids, after synonyms."""
    text = F.concat_ws(" - ", "p_name", "p_type")
    both = [F.array_join(POLICIES.actions(text, kind), ",").alias(kind) for kind in ("required", "forbidden")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("recipe_id"), *both)


@query(f"""WITH {SCORED_SQL}, pl AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, recipe_id) AS k FROM scored WHERE request = 0),
b AS (SELECT brand, list(recipe_id ORDER BY k) FILTER (WHERE k <= 3) AS ranked, coalesce(list(recipe_id ORDER BY recipe_id) FILTER (WHERE family = '基础校正' AND recipe_id % 2 = 0), []) AS expected, arg_min(name, recipe_id) AS asked_text, arg_max(name, recipe_id) AS got_text FROM pl GROUP BY brand),
{policy_sql('required', 'b', 'brand', 'asked_text')}, {policy_sql('forbidden', 'b', 'brand', 'asked_text')}, gb AS (SELECT brand AS gbrand, got_text FROM b),
{policy_sql('required', 'gb', 'gbrand', 'got_text').replace('required_', 'gr_')}, {policy_sql('forbidden', 'gb', 'gbrand', 'got_text').replace('forbidden_', 'gf_')},
a AS (SELECT b.brand, ranked, expected, coalesce(r.actions, []) AS required, coalesce(f.actions, []) AS forbidden, coalesce(gr_of.actions, []) AS got_required, coalesce(gf_of.actions, []) AS got_forbidden
  FROM b LEFT JOIN required_of r USING (brand) LEFT JOIN forbidden_of f USING (brand) LEFT JOIN gr_of ON gr_of.gbrand = b.brand LEFT JOIN gf_of ON gf_of.gbrand = b.brand)
SELECT count(*) AS total, count(*) FILTER (WHERE list_contains(expected, ranked[1])) AS top1, count(*) FILTER (WHERE list_has_any(ranked, expected)) AS top3, count(*) FILTER (WHERE list_has_all(got_required, required)) AS required_ok,
  count(*) FILTER (WHERE list_has_all(got_forbidden, forbidden)) AS forbidden_ok, count(DISTINCT list_sort(got_required)) AS required_sets, count(DISTINCT list_sort(got_forbidden)) AS forbidden_sets, count(DISTINCT ranked) AS rankings, count(*) FILTER (WHERE len(got_required) = 0) AS without_action FROM a""")
def rule_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often rankings and policies meet what was expected, and how many different answers there are."""
    order = Window.partitionBy("brand").orderBy(F.col("score").desc(), "recipe_id")
    rows = scored(spark, sf_dir).filter("request = 0").withColumn("k", F.row_number().over(order))
    best = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "recipe_id"))))
    cases = rows.groupBy("brand").agg(
        F.transform(best, lambda p: p["recipe_id"]).alias("ranked"), F.collect_list(F.when((F.col("family") == m.BASELINE) & (F.col("recipe_id") % 2 == 0), F.col("recipe_id"))).alias("expected"),
        F.min_by("name", "recipe_id").alias("asked"), F.max_by("name", "recipe_id").alias("got"),
    )
    actions = {f"{prefix}{kind}": POLICIES.actions(F.col(text), kind) for prefix, text in (("", "asked"), ("got_", "got")) for kind in ("required", "forbidden")}
    return m.discrimination(cases.withColumns(actions))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS image_id, l_linenumber AS instance, l_suppkey % 4 AS face, (l_partkey * 37 % 100) / 100e0 AS overlap FROM lineitem),
l AS (SELECT image_id, list({'o': -overlap, 'i': instance, 'f': face} ORDER BY -overlap, instance, face) AS ps FROM o WHERE overlap >= 1.5e-1 GROUP BY image_id),
w AS (SELECT image_id, ps, ps[1:0] AS kept, 1 AS k FROM l UNION ALL SELECT image_id, ps, CASE WHEN len(list_filter(kept, lambda t: t.i = ps[k].i OR t.f = ps[k].f)) > 0 THEN kept ELSE list_append(kept, ps[k]) END, k + 1 FROM w WHERE k <= len(ps)),
u AS (SELECT image_id, unnest(kept) AS p FROM w WHERE k > len(ps)) SELECT image_id, CAST(p.i AS BIGINT) AS instance, CAST(p.f AS BIGINT) AS face, round(-p.o, 4) + 0e0 AS overlap FROM u""")
def face_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces and instances of an image matched one to one, the largest overlap first."""
    overlap = (F.col("l_partkey") * 37 % 100) / 100.0
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("instance"), (F.col("l_suppkey") % 4).alias("face"), overlap.alias("overlap"))
    return rounded(m.one_to_one(rows))
