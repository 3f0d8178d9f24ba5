import math

import numpy as np

from tintmill.llm import language_id
from tintmill.llm.shared import documents


def brute(texts, order=language_id.ORDER):
    """Interpolated Kneser-Ney of one language in dictionaries: probability of c after h."""
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        s = language_id.PAD + t + " "
        for i in range(order - 1, len(s)):
            g = s[i - order + 1:i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    discounts = []
    for n in range(order + 1):
        once, twice = max(1, sum(v == 1 for v in counts[n].values())), sum(v == 2 for v in counts[n].values())
        discounts.append(min(0.95, max(0.1, once / (once + 2 * twice))))

    def p(h, c, letters):
        n = len(h) + 1
        low = p(h[1:], c, letters) if n > 1 else 1 / letters
        own = [v for g, v in counts[n].items() if g[:-1] == h]
        if not own:
            return low
        return max(counts[n].get(h + c, 0) - discounts[n], 0) / sum(own) + discounts[n] * len(own) / sum(own) * low

    return p


def test_probabilities_against_dictionaries():
    texts = {"xx": ["abra cadabra", "abracadabra ab", "cab"], "yy": ["zug um zug", "abzug"]}
    counts = {}
    for lang, own in texts.items():
        folded, starts, ends = language_id._folded(own)
        counts[lang] = np.unique(language_id._grams(folded)[language_id._scored(starts, ends, len(folded))], return_counts=True)
    model = language_id.Model(counts)
    letters = len({c for own in texts.values() for t in own for c in t} | {" "}) + 1
    for text in ("abra", "zug cab", "qqq", "a"):
        bits, n = model.entropies([text, "other"])
        s = language_id.PAD + text + " "
        for k, lang in enumerate(model.langs):
            p = brute(texts[lang])
            want = -sum(math.log2(p(s[i - 4:i], s[i], letters)) for i in range(4, len(s))) / (len(text) + 1)
            assert abs(bits[0, k] - want) < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in documents(spark, sf).select("doc_id", "lang").collect()}
    got = language_id.op5_kneser_ney_language(spark, sf).collect()
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert len(got) == 1000 and len(held) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got) <= 10


def test_odd_rows(spark, odd):
    got = {r.doc_id: r for r in language_id.op5_kneser_ney_language(spark, odd).collect()}
    for i in (1, 2, 3, 11):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_noise_is_rejected(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = language_id.fit(docs)
    noise = spark.createDataFrame([(1, " ".join("zqxjkvwp"[(k * 7 + j * 3) % 8] * 2 + "xq" for j in range(3) for k in range(200)))], "doc_id long, text string")
    assert language_id.identify(noise, model).first()["language"]["rejected"]


def test_the_sample_does_not_depend_on_the_size_of_the_corpus():
    for n in (601, 10**6, 3 * 10**8, 10**10, 10**13):
        assert abs(language_id.bound(600, n) * n / 2**63 - 600) < 1
    assert language_id.bound(600, 5) == 2**63 - 1


def test_marks_alone_are_no_letters(spark):
    model = language_id.fit(documents(spark, "/root/testdata/sf0.001"))
    rows = spark.createDataFrame([(1, "́̂ ̃"), (2, "étude des élèves de la maison")], "doc_id long, text string")
    got = {r.doc_id: r.language for r in language_id.identify(rows, model).collect()}
    assert got[1].lang_pred == "und" and got[1].rejected and got[1].score == 0
    assert got[2].lang_pred != "und"


def test_a_single_labelled_row_is_learned_from(spark):
    docs = spark.createDataFrame([(1, "only one row here", "xx"), (2, "...", "yy"), (3, None, "zz")], "doc_id long, text string, lang string")
    assert language_id.fit(docs).langs == ["xx"]


def test_a_rare_language_has_limits_too(spark):
    rows = [(k, f"the quick brown fox number {'abcdefghij'[k % 10] * (k % 7 + 1)} jumps over it", "en") for k in range(400)]
    rows += [(1000 + k, f"der schnelle braune fuchs {'klmnop'[k % 6] * (k % 5 + 1)} springt", "de") for k in range(9)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"] and sorted(model.limits) == [0, 1]


def test_equal_rows_do_not_crowd_out_a_language(spark):
    """Rows without doc_id share a draw; a language of one repeated text is learned beside varied rows, either way round."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    varied = [(k, " ".join(words[(k * j) % 12] for j in range(1, 9)) + f" {words[k % 12]}{words[k % 7]}", "en") for k in range(2000)]
    equal = [(None, "ein und derselbe kleine Satz über schöne Häuser", "de")] * 20_000
    docs = spark.createDataFrame(varied + equal, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.langs == ["de", "en"]
    assert model.decide(["schöne kleine haus", "seven eleven twelve"])["lang_pred"].tolist() == ["de", "en"]


def test_the_sample_is_bounded_by_texts_and_by_characters(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 40)
    seen = []
    settle = language_id.settle
    monkeypatch.setattr(language_id, "settle", lambda df, tag: seen.append(settle(df, tag)) or seen[-1])
    docs = spark.createDataFrame([(k, f"text number {k % 500} " * 8, "en") for k in range(4000)], "doc_id long, text string, lang string")
    language_id.fit(docs, sample=100)
    rows = seen[0].collect()
    assert 50 < len(rows) < 200 and max(len(r.text) for r in rows) <= 40
