from tintmill.llm import mixing


def filled(budget, children):
    """Water-filling, one token at a time would do; here by repeated sharing. children: (name, weight, capacity)."""
    full, left = {}, budget
    while True:
        live = [c for c in children if c[0] not in full]
        weights = sum(c[1] for c in live)
        over = [c for c in live if c[2] * weights <= left * c[1]]
        if not over:
            return full | {c[0]: left * c[1] / weights for c in live}
        first = min(over, key=lambda c: c[2] / c[1])
        full[first[0]] = first[2]
        left -= first[2]


def test_shortage_goes_to_siblings_first(spark):
    rows = [("d", "en", "small", 10), ("d", "en", "big", 1000), ("d", "fr", "only", 500), ("e", "en", "x", 5), ("f", "de", "y", 10_000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"d": 2, "e": 1, "f": 1}, "lang": {}, "source": {}}
    from pyspark.sql import functions as F

    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, F.lit(1000).cast("long"), weights, 1).collect()}
    top = filled(1000, [("d", 2, 1510), ("e", 1, 5), ("f", 1, 10_000)])
    lang = filled(top["d"], [("en", 1, 1010), ("fr", 1, 500)])
    leaf = filled(lang["en"], [("small", 1, 10), ("big", 1, 1000)])
    assert sum(got.values()) == 1000
    assert got["e", "en", "x"] == 5 and got["d", "en", "small"] == 10
    for key, want in ((("d", "en", "big"), leaf["big"]), (("d", "fr", "only"), lang["fr"]), (("f", "de", "y"), top["f"])):
        assert abs(got[key] - want) <= 2


def test_budget_is_met_and_repeats_are_epochs(spark, odd):
    out = mixing.op3_tree_mix(spark, odd).collect()
    from tintmill.llm.shared import documents
    from pyspark.sql import functions as F

    total = documents(spark, odd).select(F.sum(mixing.tokens(F.col("text")))).first()[0]
    assert sum(r.taken for r in out) == min(total * mixing.SHARE // 1000, total * mixing.EPOCHS)
    assert all(0 < r.taken <= r.tokens and r.epoch < mixing.EPOCHS for r in out)
