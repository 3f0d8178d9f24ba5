"""Mixing sources to target weights by hierarchical budgets.

The tree is root > domain > language > source. A budget of tokens enters at the root; each node deals
its budget to its children in proportion to their weights. A child whose capacity (tokens below it x
max_epochs) is smaller takes its capacity, and its shortage goes to its siblings first; only what a
whole family cannot use goes back to the ancestor's other children - dealing top-down against
capacities of whole subtrees does exactly that. All of it is integer arithmetic.

Each leaf (a source in a language) is then read in epochs; an epoch is the leaf's documents in the
order of md5(seed:epoch:doc_id). The leaf's budget is a token prefix of epoch 0, epoch 1, ...; the
document at the cut counts with the tokens that fit. Whole hash ranges are taken or left without
sorting: only the range at a leaf's cut is ordered, so a leaf with a third of all rows is no hot spot.

A token is a word or the one end of a document, as in this package's language model; `size` takes
any other count, such as the ids of `token_counts`, if a column holds it.

Defined cases: null or empty text has one token, its end; null lang or source are nodes of their own
('', of domain UNLISTED); a null doc_id is ordered as ''; repeated rows count each, in any order among
themselves; a very long text is one row of many tokens, cut where the budget ends; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.llm.shared import documents, settle

SEED = 11
#: Integer weights of nodes among their siblings; nodes not listed weigh OTHER.
WEIGHTS = {"domain": {"web": 4, "books": 3, "news": 2, "reference": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}, "source": {}}
OTHER = 1
#: The domain of each source: a parameter; these twenty are the sources of the supplied tables, which
#: carry no domain of their own. A source that is not listed belongs to UNLISTED.
DOMAINS = {f"src{k}": ("web", "books", "news", "reference")[k // 5] for k in range(20)}
UNLISTED = "other"
#: The budget in thousandths of all tokens, and how often a document may be read.
SHARE, EPOCHS = 600, 2
#: Hash ranges of a leaf: the first hexadecimal digits of the order.
RANGE_DIGITS = 3
LEVELS = ("domain", "lang", "source")
#: A word, as the language model of this package has it.
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def domain(source: Column, domains: dict[str, str] = DOMAINS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair]) if domains else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, F.coalesce(source, F.lit(""))), F.lit(UNLISTED))


def dealt(children: DataFrame, parent: list[str], total: str) -> DataFrame:
    """children (parent's columns, name, weight, capacity, budget of the parent in `total`) with `budget`.
    Children that are full sooner (capacity / weight) are served first; from the first that is not
    full on, the rest is shared by weight, and what rounding leaves goes out one by one."""
    order = [F.col("capacity") / F.col("weight"), F.col("name")]
    up = Window.partitionBy(*parent).orderBy(*order)
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col(total) - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    table = children.withColumns({"__left": left, "__weights": weights})
    table = table.withColumn("__full", F.col("capacity") * F.col("__weights") <= F.col("__left") * F.col("weight"))
    # From the first child that is not full, none is: later ones have more room for their weight.
    table = table.withColumn("__open", F.max(F.when(~F.col("__full"), 1).otherwise(0)).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    pool = F.max(F.when(F.col("__open") == 1, F.col("__left"))).over(whole)
    shares = F.max(F.when(F.col("__open") == 1, F.col("__weights"))).over(whole)
    table = table.withColumns({"__pool": pool, "__shares": shares})
    table = table.withColumn("__part", F.when(F.col("__open") == 0, F.col("capacity")).otherwise(F.expr("__pool * weight div __shares")))
    rest = F.col("__pool") - F.sum(F.when(F.col("__open") == 1, F.col("__part"))).over(whole)
    place = F.sum("__open").over(up.rowsBetween(Window.unboundedPreceding, 0))
    table = table.withColumns({"__rest": rest, "__place": place})
    budget = F.least("capacity", F.col("__part") + F.when((F.col("__open") == 1) & (F.col("__place") <= F.col("__rest")), 1).otherwise(0))
    return table.withColumn("budget", budget.cast("long")).drop(*[c for c in table.columns if c.startswith("__")])


def weight_of(level: str, name: Column, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(OTHER)
    for node, weight in weights.get(level, {}).items():
        out = F.when(name == node, weight).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `budget`."""
    sized = leaves.withColumn("capacity", F.col("tokens") * epochs)
    above = sized.agg(F.least(F.sum("capacity"), total).cast("long").alias("of_parent"))
    known: list[str] = []
    for level in LEVELS:
        nodes = sized.groupBy(*known, level).agg(F.sum("capacity").cast("long").alias("capacity"))
        nodes = nodes.withColumns({"name": F.col(level), "weight": weight_of(level, F.col(level), weights)})
        nodes = nodes.join(above, known) if known else nodes.join(F.broadcast(above))  # one row
        nodes = dealt(nodes, known or [F.lit(0)], "of_parent")
        known = [*known, level]
        above = nodes.select(*known, F.col("budget").alias("of_parent"))
    return above.withColumnRenamed("of_parent", "budget").join(leaves, list(LEVELS))


def mix(docs: DataFrame, share: int = SHARE, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] = WEIGHTS, seed: int = SEED,
        doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain_of: Column | None = None, size: Column | None = None) -> DataFrame:
    """doc_id, epoch, domain, lang, source, tokens, before (tokens of its leaf and epoch ahead of it),
    taken (tokens of it inside the budget): a row for each document and epoch that is taken."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (domain(F.col(source)) if domain_of is None else domain_of).alias("domain"), blank(lang).alias("lang"), blank(source).alias("source"), (tokens(F.col(text)) if size is None else size.cast("long")).alias("tokens"))
    rows = settle(rows, "mix")
    key = lambda e: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(e).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    everything = rows.agg(F.expr(f"coalesce(sum(tokens), 0) * {share} div 1000").alias("n")).first()["n"]
    plan = settle(budgets(leaves, F.lit(everything).cast("long"), weights, epochs).withColumnRenamed("tokens", "leaf_tokens"), "mix-budgets")
    out = None
    for e in range(epochs):
        # This epoch's part of each leaf's budget.
        part = plan.withColumn("want", F.greatest(F.lit(0), F.least("leaf_tokens", F.col("budget") - F.col("leaf_tokens") * e)).cast("long"))
        part = part.filter("want > 0").select(*LEVELS, "want")
        keyed = rows.withColumn("order", key(e)).withColumn("range", F.substring("order", 1, RANGE_DIGITS))
        ranges = keyed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("in_range"))
        # Two levels of sums, by the first digit and inside it: a leaf is sixteen small windows, not one.
        ranges = ranges.withColumn("first", F.substring("range", 1, 1))
        inner = Window.partitionBy(*LEVELS, "first").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("inner", F.coalesce(F.sum("in_range").over(inner), F.lit(0)))
        outer = Window.partitionBy(*LEVELS).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        firsts = ranges.groupBy(*LEVELS, "first").agg(F.sum("in_range").alias("n"))
        firsts = firsts.withColumn("outer", F.coalesce(F.sum("n").over(outer), F.lit(0))).join(part, list(LEVELS)).drop("n")
        ranges = ranges.join(firsts, [*LEVELS, "first"]).withColumn("ahead", F.col("outer") + F.col("inner")).filter("ahead < want").drop("first", "inner", "outer")
        near = keyed.join(ranges, [*LEVELS, "range"])
        inside = near.withColumn("before", F.lit(None).cast("long")).filter("ahead + in_range <= want")
        at_cut = near.filter("ahead + in_range > want")
        up = Window.partitionBy(*LEVELS, "range").orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, -1)
        at_cut = at_cut.withColumn("before", F.col("ahead") + F.coalesce(F.sum("tokens").over(up), F.lit(0))).filter("before < want")
        both = inside.unionByName(at_cut)
        taken = F.when(F.col("before").isNull(), F.col("tokens")).otherwise(F.least("tokens", F.col("want") - F.col("before")))
        both = both.select("doc_id", F.lit(e).alias("epoch"), *LEVELS, "tokens", taken.cast("long").alias("taken"))
        out = both if out is None else out.unionByName(both)
    return out


def op3_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS[level].items())
    return f"CASE {cases} ELSE {OTHER} END" if cases else str(OTHER)


def oracle() -> str:
    """The same in DuckDB SQL: budgets level by level, then every leaf fully ordered."""
    domains = " ".join(f"WHEN '{source}' THEN '{name}'" for source, name in DOMAINS.items())
    parts = [f"""WITH rows AS (SELECT doc_id, CASE source {domains} ELSE '{UNLISTED}' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS HUGEINT) AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM rows GROUP BY ALL),
    root AS (SELECT least(sum(tokens) * {EPOCHS}, sum(tokens) * {SHARE} // 1000) AS of_parent FROM leaves)"""]
    above, known = "root", []
    for level in LEVELS:
        keys = ", ".join([*known, level])
        by = f"PARTITION BY {', '.join(known)}" if known else ""
        order = f"ORDER BY capacity / weight, {level}"
        join = f"JOIN {above} USING ({', '.join(known)})" if known else f"CROSS JOIN {above}"
        parts.append(f"""n_{level} AS (SELECT * FROM (SELECT {keys}, sum(tokens) * {EPOCHS} AS capacity, {_sql_weight(level)} AS weight FROM leaves GROUP BY {keys}) {join}),
    a_{level} AS (SELECT *, of_parent - coalesce(sum(capacity) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(weight) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM n_{level}),
    b_{level} AS (SELECT *, max(CASE WHEN capacity * weights <= rest * weight THEN 0 ELSE 1 END) OVER ({by} {order} ROWS UNBOUNDED PRECEDING) AS is_open FROM a_{level}),
    c_{level} AS (SELECT *, max(CASE WHEN is_open = 1 THEN rest END) OVER ({by}) AS pool, max(CASE WHEN is_open = 1 THEN weights END) OVER ({by}) AS shares FROM b_{level}),
    d_{level} AS (SELECT *, CASE WHEN is_open = 0 THEN capacity ELSE pool * weight // shares END AS part, sum(is_open) OVER ({by} {order} ROWS UNBOUNDED PRECEDING) AS place FROM c_{level}),
    e_{level} AS (SELECT {keys}, least(capacity, part + CASE WHEN is_open = 1 AND place <= pool - sum(CASE WHEN is_open = 1 THEN part END) OVER ({by}) THEN 1 ELSE 0 END) AS of_parent FROM d_{level})""")
        above, known = f"e_{level}", [*known, level]
    parts.append(f"""epochs AS (SELECT unnest(range({EPOCHS})) AS epoch),
    placed AS (SELECT rows.*, epoch, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows, epochs),
    asked AS (SELECT domain, lang, source, epoch, greatest(0, least(tokens, of_parent - tokens * epoch)) AS want FROM e_source JOIN leaves USING (domain, lang, source), epochs)""")
    return ",\n".join(parts) + """
    SELECT doc_id, CAST(epoch AS INT) AS epoch, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(least(tokens, want - before) AS BIGINT) AS taken
    FROM placed JOIN asked USING (domain, lang, source, epoch) WHERE before < want"""
