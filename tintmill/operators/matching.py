"""Requests against recipes: words found either way, scores, policies of actions, one-to-one matches.

Words, rules and weights are columns or parameters; a request meets the rules as array literals, so that
neither side is joined or moved. A null text or list counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is stripped from a text, weights of a score, the family and terms of its rules.
SEPARATORS = r"[\s,，、/；;|+·_\-]+"
SHORTEST = 2
WEIGHTS = {"preferences": 10.0, "problems": 9.0, "scenes": 8.0, "subjects": 4.0}
AGAIN, FOR_SCENE, FOR_SUBJECT, FOR_NAME, AGAINST = 0.3, 5.0, 3.0, 12.0, 15.0
EVERYTHING, BASELINE, UNEVEN = "全部", "基础校正", ("不一致", "镜头匹配")
FOR_BASELINE, FOR_UNEVEN = 1.0, 25.0


def normalised(text: Column) -> Column:
    """Lower case, without blanks and separators."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, "")


def hits(text: Column, words: Column) -> Column:
    """Words of two or more characters that the text holds or that hold the text; an empty text has none."""
    words = F.coalesce(words, F.array().cast("array<string>"))

    def either(said: Column, word: Column) -> Column:
        # The list of one binds what is normalised, so that it is worked out once and not in each use.
        return F.exists(F.array(normalised(word)), lambda w: (F.length(w) >= SHORTEST) & (F.length(said) > 0) & (F.contains(said, w) | F.contains(w, said)))

    return F.transform(F.array(normalised(text)), lambda said: F.filter(words, lambda word: either(said, word)))[0]


def score(request: dict[str, Column]) -> Column:
    """How well a recipe answers a request (scenes, subjects, problems, preferences).

    The recipe has `rule` (a struct of word lists named as WEIGHTS, and `exclusions`), `scenes`, `subjects`,
    `aliases` (lists), `name` and `family`.
    """
    total = F.lit(0.0)
    for kind, weight in WEIGHTS.items():
        n = F.size(hits(request[kind], F.col(f"rule.{kind}")))
        total = total + F.when(n > 0, weight + (n - 1) * weight * AGAIN).otherwise(0.0)

    def found(text: Column, words: Column) -> Column:
        return F.size(hits(text, words)) > 0

    anything = F.coalesce(F.array_contains("subjects", EVERYTHING), F.lit(False))
    named = F.concat(F.array("name", "family"), F.coalesce("aliases", F.array().cast("array<string>")))
    whole = F.concat_ws(" ", *[request[k] for k in ("scenes", "subjects", "problems", "preferences")])
    problems = F.coalesce(request["problems"], F.lit(""))
    baseline = (F.col("family") == BASELINE) & (problems != "")
    uneven = baseline & (F.contains(problems, F.lit(UNEVEN[0])) | F.contains(problems, F.lit(UNEVEN[1])))
    for holds, points in (
        (found(request["scenes"], F.col("scenes")), FOR_SCENE),
        (found(request["subjects"], F.col("subjects")) & ~anything, FOR_SUBJECT),
        (found(request["preferences"], named), FOR_NAME),
        (found(whole, F.col("rule.exclusions")), -AGAINST),
        (baseline, FOR_BASELINE),
        (uneven, FOR_UNEVEN),
    ):
        total = total + F.when(holds, points).otherwise(0.0)
    return F.round(total, 2)


@dataclass(frozen=True)
class Policy:
    """What a problem asks for and forbids."""

    problem: str
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policies:
    rules: tuple[Policy, ...]
    synonyms: dict[str, str] = field(default_factory=dict)

    def actions(self, problems: Column, kind: str) -> Column:
        """Actions of all rules whose problem the text holds, in the rules' order, each once."""
        text = normalised(problems)
        for said, meant in self.synonyms.items():
            text = F.replace(text, F.lit(said), F.lit(meant))
        none = F.array().cast("array<string>")
        own = [F.when(F.contains(text, normalised(F.lit(r.problem))), F.array(*map(F.lit, getattr(r, kind)))).otherwise(none) for r in self.rules if getattr(r, kind)]
        return F.array_distinct(F.concat(none, *own))


def within(part: str, whole: str) -> Column:
    """Whether all of a list is in another; an empty or missing list is in any."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(part, none), F.coalesce(whole, none))) == 0


def discrimination(answers: DataFrame) -> DataFrame:
    """One row of how often answers (ranked, expected, required, forbidden, got_required, got_forbidden) are right,
    and how many different ones there are."""
    checks = {
        "top1": F.array_contains("expected", F.get("ranked", F.lit(0))),
        "top3": F.arrays_overlap(F.slice("ranked", 1, 3), "expected"),
        "required_ok": within("required", "got_required"),
        "forbidden_ok": within("forbidden", "got_forbidden"),
    }
    return answers.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c).alias(n) for n, c in checks.items()],
        F.count_distinct(F.array_sort("got_required")).alias("required_sets"),
        F.count_distinct(F.array_sort("got_forbidden")).alias("forbidden_sets"),
        F.count_distinct("ranked").alias("rankings"),
        F.count_if(F.size("got_required") == 0).alias("without_action"),
    )


def one_to_one(overlaps: DataFrame, least: float = 0.15) -> DataFrame:
    """image_id, instance, face, overlap: pairs taken from the largest overlap down, each side at most once.

    Of equal overlaps the smaller instance, then the smaller face goes first. The list of an image is
    its instances x faces that overlap enough, some dozens.
    """
    pair = F.struct((-F.col("overlap")).alias("less"), "instance", "face")
    lists = overlaps.filter(F.col("overlap") >= least).groupBy("image_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))

    def take(kept: Column, p: Column) -> Column:
        used = F.exists(kept, lambda k: (k["instance"] == p["instance"]) | (k["face"] == p["face"]))
        return F.when(used, kept).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate("pairs", F.slice("pairs", 1, 0), take)
    rows = lists.select("image_id", F.explode(kept).alias("p"))
    return rows.select("image_id", "p.instance", "p.face", F.round(-F.col("p.less"), 4).alias("overlap"))
