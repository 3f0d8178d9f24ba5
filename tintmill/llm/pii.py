"""Personal data by rules, and by bootstrapped contextual extraction, in DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers. Their finds are seeds. A seed
induces lexical patterns: its own shape (digits as 0, letters as a, and whether a card's check digit
holds), the two words before it, and the word on each side of it. Patterns also fit candidates, things
that look like identifiers and overlap no base span: one to WINDOW neighbouring words of digits, with
six digits at least and 64 characters at most, or a word with @ of 64 characters at most on each side of
it (base spans may be of any length; longer candidates are not looked for, they are no identifiers). So a phone number that a rule lost, because digits followed it
and it looked too long, is found again by its shape. Patterns and instances form a bipartite graph,
scored in rounds: a pattern's score for a kind is the share of its instances, weighted by their
scores, that are of that kind (with BELIEF doubtful ones added); a candidate's score is that of its
best pattern. Candidates that reach CONFIDENT with a pattern of at least SUPPORT different seeds, and
that keep the kind's own rules for digits, become spans; base spans always stay. Of overlapping ones
the leftmost stays, and of those the longest. Spans are counted in code points.

The text is read once: each row's finds, with AROUND code points on each side, go to a durable table,
and all rounds work on that. Words of a context that lie further off are cut there. Sums over a
pattern are combined before they are shuffled; a pattern that many candidates share is left to
adaptive splitting of skewed joins.

Defined cases: null text counts as empty and has no spans; overlapping kinds are all reported (each
kind matches by itself); repeated rows are searched each; null doc_id is carried; a very long text or
run of digits is searched whole, in time linear in it; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.llm.shared import documents, settle

KINDS = ("email", "ip", "card", "phone")
#: Expressions that match just what the contract's do, but never go back over a run (possessive) and
#: start only where a match can: so a text of one long run is read once.
LOCAL = "[A-Za-z0-9._%+-]"
MATCH = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Words that candidates are made of: words with @, and runs of words of digits.
LOOSE = {
    "at": r"(?<![^ \t\n])[^\s@]{1,64}+@[^\s@]{1,64}+(?![^\s,;.!?])",
    "run": r"(?<![0-9A-Za-z.+(-])[+(]?[0-9][0-9().-]*+(?: [+(]?[0-9][0-9().-]*+)*+",
}
WINDOW, LEAST_DIGITS = 4, 6
ROUNDS, BELIEF, CONFIDENT, SUPPORT = 3, 1.0, 0.8, 5
AROUND = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)
    part = lambda p: F.ltrim(p, F.lit("0"))
    ip = F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(False)).when(kind == "phone", n.between(9, 15)).otherwise(True)


def _finds(text: Column, pattern: str, possible: Column) -> Column:
    """array of (gap: code points since the last match, hit, left, right) of a text's matches."""
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    after = F.slice(between, 2, 2**31 - 1)
    # Zipped, so that a text is split once and not again for each match; the last piece has no match.
    rows = F.filter(F.arrays_zip(hits.alias("hit"), between.alias("before"), after.alias("after")), lambda z: z["hit"].isNotNull())
    found = F.transform(rows, lambda z: F.struct(F.length(z["before"]).cast("long").alias("gap"), z["hit"].alias("hit"), F.right(z["before"], F.lit(AROUND)).alias("left"), F.left(z["after"], F.lit(AROUND)).alias("right")))
    none = F.array().cast("array<struct<gap:bigint,hit:string,left:string,right:string>>")
    return F.when(possible, found).otherwise(none)


def search(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id), and matches in place: row, kind (or 'at', 'run'), n, start, end, hit, left, right."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body.alias("body"))
    rows = rows.withColumns({"digits": F.col("body").rlike("[0-9]"), "with_at": F.contains("body", F.lit("@"))})
    may = {"email": F.col("with_at"), "ip": F.col("digits"), "card": F.col("digits"), "phone": F.contains("body", F.lit("+")), "at": F.col("with_at"), "run": F.col("digits")}
    rules = MATCH | LOOSE
    table = settle(rows.select("row", "doc_id", *[_finds(F.col("body"), rule, may[k]).alias(k) for k, rule in rules.items()]), "finds")
    # A column for each kind: a generator then carries nothing but the row's number beside each match.
    each = None
    for k in rules:
        own = table.select("row", F.posexplode(k).alias("n", "m")).select("row", F.lit(k).alias("kind"), "n", "m")
        each = own if each is None else each.unionAll(own)
    upto = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m.hit")
    each = each.withColumn("end", F.sum(F.col("m.gap") + size).over(upto))
    return table.select("row", "doc_id"), each.select("row", "kind", "n", (F.col("end") - size).alias("start"), "end", "m.hit", "m.left", "m.right")


def candidates(matches: DataFrame) -> DataFrame:
    """row, start, end, hit, left, right: words with @, and windows of WINDOW words at most over runs
    of words of digits; brackets and points at their end are left off."""
    runs = matches.filter("kind = 'run'")
    words = runs.select("row", "n", F.col("start").alias("from"), "left", "right", F.posexplode(F.split("hit", " ")).alias("k", "word"))
    order = Window.partitionBy("row", "n").orderBy("k")
    before = F.coalesce(F.sum(F.length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = {f"w{k}": F.lead("word", k).over(order) for k in range(1, WINDOW + 1)} | {f"b{k}": F.lag("word", k).over(order) for k in (1, 2)}
    words = words.withColumns({"start": F.col("from") + before, "w0": F.col("word"), **near})
    left = F.when(F.col("b1").isNull(), F.col("left")).otherwise(F.concat_ws(" ", "b2", "b1", F.lit("")))
    options = []
    for k in range(1, WINDOW + 1):
        hit = F.regexp_replace(F.concat_ws(" ", *[f"w{j}" for j in range(k)]), r"[().-]+$", "")
        right = F.when(F.col(f"w{k}").isNull(), F.col("right")).otherwise(F.concat(F.lit(" "), F.col(f"w{k}")))
        options.append(F.when(F.col(f"w{k - 1}").isNotNull(), F.struct(hit.alias("hit"), right.alias("right"))))
    windows = words.select("row", "start", left.alias("left"), F.explode(F.array_compact(F.array(*options))).alias("o"))
    windows = windows.select("row", "start", (F.col("start") + F.length("o.hit")).alias("end"), "o.hit", "left", "o.right")
    windows = windows.filter((F.length(_digits(F.col("hit"))) >= LEAST_DIGITS) & (F.length("hit") <= 64))
    return windows.unionByName(matches.filter("kind = 'at'").select(*windows.columns))


def base_spans(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("kind").isin(*KINDS) & valid(F.col("kind"), F.col("hit")))


def shape(hit: Column) -> Column:
    """Digits as 0, runs of letters as a; a mark where 13 to 19 digits keep a card's check digit."""
    digits = _digits(hit)
    card = F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.concat(F.when(card, "=L ").otherwise("="), F.regexp_replace(F.regexp_replace(hit, "[0-9]", "0"), r"\p{L}+", "a"))


def _patterns(spans: DataFrame) -> DataFrame:
    """spans with their patterns, a row for each: their shape, the two words before, and one word on
    each side. Words at the cut of the surroundings count as they stand; a side without a word gives
    no pattern."""
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), "[0-9]", "0")
    two = F.regexp_extract(plain("left"), r"(\S+\s+\S+[ =:\"'(]*)$", 1)
    one = F.regexp_extract(plain("left"), r"(\S+[ =:\"'(]*)$", 1)
    after = F.regexp_extract(plain("right"), r"^\W*(\w+)", 1)
    patterns = F.array_compact(F.array(shape(F.col("hit")), F.when(two != "", F.concat(F.lit("<"), two)), F.when((one != "") & (after != ""), F.concat(one, F.lit("<>"), after))))
    return spans.select("*", F.explode(patterns).alias("pattern"))


def bootstrap(matches: DataFrame, base: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """Added spans: row, kind, start, end."""
    seeds = _patterns(base).select("pattern", "kind", F.xxhash64("hit").alias("instance")).distinct()
    # What overlaps a base span is no candidate. In order of starts, the base spans that begin before a
    # candidate ends are met by the greatest end so far, and those inside it by the next start.
    loose = candidates(matches).withColumn("base", F.lit(0))
    marks = loose.unionByName(base.select(*[c for c in loose.columns if c != "base"], F.lit(1).alias("base")))
    upto = Window.partitionBy("row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumns({"reached": F.max(F.when(F.col("base") == 1, F.col("end"))).over(upto), "next": F.min(F.when(F.col("base") == 1, F.col("start"))).over(after)})
    free = marks.filter("base = 0 and coalesce(reached, 0) <= start and coalesce(next, end) >= end")
    free = settle(_patterns(free).select("row", "start", "end", "hit", "pattern", F.xxhash64("hit").alias("instance")), "candidates")
    # Only patterns that some seeds of a kind support can ever be confident.
    strong = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    totals = seeds.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("all_seeds"))
    strong = settle(strong.filter(F.col("seeds") >= support).join(totals, "pattern"), "patterns")
    pairs = settle(free.select("pattern", "instance").distinct().join(strong.select("pattern").distinct(), "pattern", "left_semi"), "pairs")
    belief = None  # of candidates: (instance, kind, score)
    for _ in range(rounds):
        weight = F.count(F.lit(1)).alias("candidates")
        of_pattern = pairs.groupBy("pattern").agg(weight)
        scored = strong.join(of_pattern, "pattern", "left").na.fill(0, ["candidates"])
        if belief is not None:
            gained = pairs.join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            scored = scored.join(gained, ["pattern", "kind"], "left").na.fill(0.0, ["gained"])
        else:
            scored = scored.withColumn("gained", F.lit(0.0))
        scored = scored.select("pattern", "kind", ((F.col("seeds") + F.col("gained")) / (F.col("all_seeds") + F.col("candidates") + BELIEF)).alias("trust"))
        belief = settle(pairs.join(scored, "pattern").groupBy("instance", "kind").agg(F.max("trust").alias("score")), "belief")
        trusted = scored
    trusted = settle(trusted.filter(F.col("trust") >= confident), "trusted")
    best = free.join(trusted, "pattern").groupBy("row", "start", "end", "hit").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
    best = best.filter(valid(F.col("kind"), F.col("hit")))
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("reached", F.max("end").over(earlier)).filter("coalesce(reached, 0) <= start")
    return best.select("row", "kind", "start", "end")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, base and spans (arrays of kind, start, end in order)."""
    rows, matches = search(docs, doc_id, text)
    base = base_spans(matches)
    added = bootstrap(matches, base)
    both = base.select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added.withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    grouped = both.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("spans"))
    return rows.join(grouped, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType)).alias("spans"))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
