"""Records about recipes: ledgers, rankings, blind trials, references and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Terms to avoid, by what they speak against, and the parts of a colour tag that count as warm or cool.
WARM_TERMS = ("黄红", "暖调", "偏黄", "偏红", "暖黄", "暖红")
COOL_TERMS = ("冷调", "偏蓝", "青蓝", "冷青")
VIVID_TERMS = ("高饱和", "浓艳", "鲜艳")
FADED_TERMS = ("低饱和", "寡淡", "褪色")
WARM_TAGS, COOL_TAGS = "warm|amber|gold|orange|red", "cool|blue|cyan"

#: Requests that a user may make, each with the test that a recipe fails by; others are reported. The four
#: English terms look at numbers alone, the fixed terms at the recipe's colour tag too.
AVOIDABLE = {
    "warm": "temperature > 3e-2",
    "cold": "temperature < -3e-2",
    "vivid": "saturation > 1.12e0",
    "faded": "saturation < 9e-1",
    **dict.fromkeys(WARM_TERMS, f"temperature > 3e-2 OR coalesce(lower(tag) RLIKE '{WARM_TAGS}', false)"),
    **dict.fromkeys(COOL_TERMS, f"temperature < -3e-2 OR coalesce(lower(tag) RLIKE '{COOL_TAGS}', false)"),
    **dict.fromkeys(VIVID_TERMS, "saturation > 1.12e0"),
    **dict.fromkeys(FADED_TERMS, "saturation < 9e-1"),
}


def avoid_terms(text: str) -> tuple[list[str], list[str]]:
    """Known and unknown terms of a comma-separated request, each once, in order."""
    terms = list(dict.fromkeys(t.strip() for t in text.replace("，", ",").split(",") if t.strip()))
    return [t for t in terms if t in AVOIDABLE], [t for t in terms if t not in AVOIDABLE]


def avoided_for(terms: list[str]) -> Column:
    """The terms that speak against a recipe, comma-joined; empty: none."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.expr(AVOIDABLE[t]), F.lit(t)) for t in terms])), ",")


def latest(ledger: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key. One aggregate with partial sums, so a hot key costs no more."""
    rest = [c for c in ledger.columns if c not in keys]
    last = ledger.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in rest])


def remembered(options: DataFrame, rejected: DataFrame) -> DataFrame:
    """Options beside what was rejected before: at this strength, at another one, or never."""
    exact = rejected.select("recipe_id", "strength", F.lit(True).alias("__same")).distinct()
    other = rejected.select("recipe_id", F.lit(True).alias("__any")).distinct()
    rows = options.join(exact, ["recipe_id", "strength"], "left").join(other, "recipe_id", "left")
    memory = F.when(F.col("__same"), "rejected").when(F.col("__any"), "rejected_elsewhere").otherwise("new")
    return rows.withColumn("memory", memory).drop("__same", "__any")


def demoted(options: DataFrame, ledger: DataFrame) -> DataFrame:
    """Options in their order, those after the rest that were rejected for the same source, recipe and strength.

    options: source_sha, recipe_id, strength, place; ledger: source_sha, recipe_id, strength, verdict.
    """
    key = ["source_sha", "recipe_id", "strength"]

    def rounded(df: DataFrame) -> DataFrame:
        return df.withColumn("strength", F.round(F.col("strength").cast("double"), 6))

    no = rounded(ledger.filter("verdict = 'rejected'")).select(*key, F.lit(True).alias("rejected")).distinct()
    rows = rounded(options).join(no, key, "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    again = Window.partitionBy("source_sha").orderBy("rejected", "place", "recipe_id")
    return rows.withColumn("new_place", F.row_number().over(again))


def needs_intent(saturation: Column, tag: Column) -> Column:
    """Looks too strong to be proposed unasked: hardly any colour, by number or by tag."""
    return (F.coalesce(saturation, F.lit(1.0)) <= 0.05) | F.coalesce(tag == "monochrome", F.lit(False))


def nearest_rank(values: Column, p: float, how: str = "trunc") -> Column:
    """Aggregate: the value at place int(n * p), or with `round` at round((n - 1) * p), of the sorted values.

    Of a bounded group, as a frame's or a chart's: its values are gathered in one list.
    """
    ordered = F.array_sort(F.collect_list(values))
    n = F.size(ordered)
    at = F.floor(n * F.lit(p)) if how == "trunc" else F.bround((n - 1) * F.lit(p), 0)
    return F.get(ordered, F.least(n - 1, at.cast("int")))


def adjusted_curve(points: Column, shadow: Column, highlight: Column) -> Column:
    """Points [x, y] of a curve with shadows and highlights moved; black stays where it is."""

    def move(p: Column) -> Column:
        x = p[0]
        dark = F.greatest(F.lit(0.0), F.lit(1.0) - x / 0.5) * F.least(F.lit(1.0), x / 0.12)
        y = p[1] + shadow * dark + highlight * F.greatest(F.lit(0.0), (x - 0.5) / 0.5)
        return F.array(x, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)), 6))

    return F.transform(points, move)


def overridden(recipes: DataFrame, overrides: DataFrame, media: str, fields: list[str]) -> DataFrame:
    """Recipes as one medium runs them: fields that its override names replace the recipe's own, others stay.

    overrides: recipe_id, media and the fields, null where an override is silent; of several for one recipe
    and medium each field takes its largest value, so that rows never multiply.
    """
    own = overrides.filter(F.col("media") == media).groupBy("recipe_id").agg(*[F.max(f).alias("__" + f) for f in fields])
    rows = recipes.join(own, "recipe_id", "left")
    return rows.withColumns({f: F.coalesce("__" + f, f) for f in fields}).drop(*["__" + f for f in fields])


def zipped(first: DataFrame, second: DataFrame, third: DataFrame, keys: list[str]) -> DataFrame:
    """group key, pixels, complete: how many places all three have, and whether none has a place that another lacks.

    Each input is one row a place; the rest of keys after the first tells places of a group apart. An input is a
    bit of its places, so that a task holds a place once, not once an input.
    """
    marked = [df.select(*keys, F.lit(1 << k).alias("part")) for k, df in enumerate((first, second, third))]
    places = reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(F.bit_or("part").alias("parts"))
    return places.groupBy(keys[0]).agg(F.count_if(F.col("parts") == 7).alias("pixels"), F.every(F.col("parts") == 7).alias("complete"))


# Profiles that are meant for a screen, those that say nothing, and curves of logarithmic recordings.
DISPLAY_PROFILES = ("srgb", "display-p3", "rec709-sdr", "rec709-sdr-inferred")
UNTAGGED_PROFILES = ("untagged", "untagged-video")
LOG_TRANSFERS = ("log100", "log316")


def input_truth(profile: Column, transfer: Column, hdr: Column, assume_sdr: bool = False) -> tuple[Column, Column]:
    """state and confidence of what an input is, by its tags alone; how it looks is never asked."""
    steps = (
        (hdr, "hdr", "metadata"),
        (transfer.isin(*LOG_TRANSFERS), "log/raw", "metadata"),
        (profile.isin(*DISPLAY_PROFILES), "display-referred", "metadata"),
        (profile.isin(*UNTAGGED_PROFILES) & F.lit(assume_sdr), "display-referred", "user-confirmed-assumption"),
    )
    state, confidence = F.lit("unknown"), F.lit("insufficient-metadata")
    for holds, s, c in reversed(steps):
        state, confidence = F.when(holds, s).otherwise(state), F.when(holds, c).otherwise(confidence)
    return state, confidence


def merged_bands(*tables: DataFrame) -> DataFrame:
    """recipe_id, band, hue, saturation, intensity: shifts of one band added up; a band missing on one side is zero there."""
    rows = reduce(DataFrame.unionByName, tables)
    return rows.groupBy("recipe_id", "band").agg(*[F.round(F.sum(F.coalesce(k, F.lit(0.0))), 6).alias(k) for k in ("hue", "saturation", "intensity")])


def diverse_first(ranked: DataFrame, group: str, tags: list[str], count: int) -> DataFrame:
    """The best `count` rows of a group, those with a tag not seen before first. ranked: has `score`, `recipe_id`.

    Of each tag only its best `count` rows can be chosen, so later windows see no more than those.
    """
    order = (F.col("score").desc(), F.col("recipe_id"))
    rows = ranked.withColumn("of_tag", F.row_number().over(Window.partitionBy(group, *tags).orderBy(*order))).filter(F.col("of_tag") <= count)
    again = (F.col("of_tag") > 1).cast("int")
    place = F.row_number().over(Window.partitionBy(group).orderBy(again, *order))
    return rows.withColumn("place", place).filter(F.col("place") <= count).drop("of_tag")


def highest_safe(reports: DataFrame, requested: int) -> DataFrame:
    """recipe_id, selected, status: the highest passing strength not above the requested one."""
    safe = F.max(F.when((F.col("level") <= requested) & F.col("passed"), F.col("level")))
    rows = reports.groupBy("recipe_id").agg(safe.alias("selected"))
    return rows.withColumn("status", F.when(F.col("selected").isNull(), "blocked").when(F.col("selected") == requested, "unchanged").otherwise("downgraded"))


def tally(trials: DataFrame) -> DataFrame:
    """Appearances, wins and their rate for each recipe of pairwise trials; a tie has no winner."""
    seen = trials.select(F.explode(F.array("left_id", "right_id")).alias("recipe_id"), "winner")
    return seen.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("appearances"), F.count_if(F.col("winner") == F.col("recipe_id")).alias("wins")).withColumn("win_rate", F.col("wins") / F.col("appearances"))


def probe_agreement(trials: DataFrame) -> DataFrame:
    """Repeated pairs against the last trial of the same pair, whichever side each stood on."""
    pair = [F.least("left_id", "right_id").alias("low"), F.greatest("left_id", "right_id").alias("high")]
    first = trials.filter(~F.col("probe")).groupBy(*pair).agg(F.max_by("winner", "trial").alias("before"))
    again = trials.filter("probe").select(*pair, "winner").join(first, ["low", "high"])
    return again.groupBy("low", "high").agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("winner").eqNullSafe(F.col("before"))).alias("agreed"))


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How many rows and keys of a child have no parent, and how many parents no child; null keys refer to nothing."""
    keys = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    both = keys.join(parent.select(F.col(parent_key).alias("k"), F.lit(True).alias("known")).distinct(), "k", "full")
    lost = F.col("known").isNull()
    return both.agg(F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("rows_lost"), F.count_if(lost).alias("keys_lost"), F.count_if(F.col("n").isNull()).alias("unused"))


def canonical(fields: list[str]) -> Column:
    """JSON with sorted keys, all values as text: equal plans, equal bytes."""
    return F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in sorted(fields)]))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def seed(text: Column) -> Column:
    """The first 32 bits of the digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def drawn(state: Column) -> Column:
    """The next state of a linear congruential generator modulo 2**32."""
    return (state * 1664525 + 1013904223) % (1 << 32)


def changed(fields: list[str], bound: str, found: str) -> Column:
    """Names of the fields that no longer are what was bound, comma-joined."""
    differs = [F.when(~F.col(f"{bound}.{f}").eqNullSafe(F.col(f"{found}.{f}")), F.lit(f)) for f in fields]
    return F.array_join(F.array_compact(F.array(*differs)), ",")


def stacked(named: dict[str, DataFrame]) -> DataFrame:
    """Results of several checks below each other, each with its name."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("check"), "*") for n, df in named.items()])


def stable_seed(*parts: str) -> Column:
    """The first 32 bits of the digest of joined parts, as a number; a null part counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long")
