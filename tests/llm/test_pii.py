import hashlib
import re
import time

from conftest import ROWS, put

from tintmill.llm import pii
from tintmill.llm.shared import documents

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rule in RULES.items() for m in re.finditer(rule, text or "") if good(k, m[0])]


def check(rows, got):
    want = []
    for i, t in rows:
        spans = base(t)
        want.append((str(i), *(sum(s.startswith(k + ":") for s in spans) for k in RULES), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    texts = {}
    for i, t in rows:
        texts.setdefault(str(i), set()).update(base(t))
    for r in got:
        assert texts[str(r.doc_id)] <= set(filter(None, r.spans.split(",")))


TRICKY = [
    "a@b.c_d@e.f.g x@y", "é é 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9.9.9", "4111 1111-1111 1111 4111  1111 1111 1111", "4111111111111111 4111-1111-1111-1112",
    "+1 (203) 555-0199 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a..b@c..d e@f-.g@h.i", "++1 234 567 890", "1.2.3.4@x.y.z", "\U0001f600 m@n.o \U0001f600 p@q.r", "99999999999999999999.1.1.1", "+1-" * 5 + "22222222", "@a.b c@.d",
]


def test_base_spans(spark, odd, tmp_path):
    check([(r[0], r[1]) for r in ROWS], pii.op9_bootstrapped_pii(spark, odd).collect())
    rows = [(k, t, "en", "a") for k, t in enumerate(TRICKY)]
    check([(r[0], r[1]) for r in rows], pii.op9_bootstrapped_pii(spark, put(tmp_path, rows)).collect())


def test_base_spans_of_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]
    check(rows, pii.op9_bootstrapped_pii(spark, sf).collect())


def test_very_long_runs(spark, tmp_path):
    began = time.time()
    rows = [(k, t, "en", "a") for k, t in enumerate(["1 " * 200_000, "a" * 400_000, "7" * 300_000, "x@" + "y." * 100_000 + "z", "+1" + " " * 200_000, "1.2.3 " * 50_000])]
    got = {r.doc_id: r for r in pii.op9_bootstrapped_pii(spark, put(tmp_path, rows)).collect()}
    assert got[3].n_email == 1 and got[0].n_card == 0 and time.time() - began < 120


def test_patterns_find_unseen_identifiers(spark, tmp_path):
    seeds = [f"customer phone: +1 (203) 555-{k:04d} noted" for k in range(40)]
    clean = [f"there were {k * 1111117} grains of sand" for k in range(30)]
    hidden = ["customer phone: 2035550877 noted"]
    rows = [(k, t, "en", "a") for k, t in enumerate(seeds + clean + hidden)]
    got = {r.doc_id: r for r in pii.op9_bootstrapped_pii(spark, put(tmp_path, rows)).collect()}
    assert got[70].spans == "phone:16:26" and got[70].n_phone == 0
    assert all(got[k].spans == "" for k in range(40, 70))


def luhn(d):
    return 13 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def patterns(text, a, b):
    hit, left, right = text[a:b], text[max(0, a - 24):a], text[b:b + 24]
    return patterns_of(hit, left, right)


def patterns_of(hit, left, right):
    out = [("=L " if luhn(re.sub("[^0-9]", "", hit)) else "=") + re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "0", hit))]
    left, right = (re.sub("[0-9]", "0", x.lower()) for x in (left, right))
    two, one, after = re.search(r"(?a:(\S+\s+\S+[ =:\"'(]*)$)", left), re.search(r"(?a:(\S+[ =:\"'(]*)$)", left), re.match(r"(?a:\W*(\w+))", right)
    if two:
        out.append("<" + two[1])
    if one and after:
        out.append(one[1] + "<>" + after[1])
    return out


def brute(texts):
    """Added spans of all texts, by dictionaries and loops over the whole graph."""
    seeds, free = [], []
    for i, text in texts:
        spans = [(m.start(), m.end(), k) for k, rule in RULES.items() for m in re.finditer(rule, text) if good(k, m[0])]
        seeds += [(k, text[a:b], p) for a, b, k in spans for p in patterns(text, a, b)]
        options = [(m.start(), m.end(), text[max(0, m.start() - 24):m.start()], text[m.end():m.end() + 24]) for m in re.finditer(r"(?<![^ \t\n])[^\s@]{1,64}@[^\s@]{1,64}(?![^\s,;.!?])", text)]
        for m in re.finditer(r"(?<![0-9A-Za-z.+(-])[+(]?[0-9][0-9().-]*(?: [+(]?[0-9][0-9().-]*)*", text):
            words, at = m[0].split(" "), m.start()
            for k, w in enumerate(words):
                for n in range(1, 5):
                    if k + n <= len(words):
                        hit = re.sub(r"[().-]+$", "", " ".join(words[k:k + n]))
                        left = text[max(0, m.start() - 24):m.start()] if k == 0 else " ".join(words[max(0, k - 2):k]) + " "
                        right = text[m.end():m.end() + 24] if k + n == len(words) else " " + words[k + n]
                        if len(re.sub("[^0-9]", "", hit)) >= 6 and len(hit) <= 64:
                            options.append((at, at + len(hit), left, right))
                at += len(w) + 1
        free += [(i, a, b, text[a:b], p) for a, b, left, right in options if not any(s < b and a < e for s, e, _ in spans) for p in patterns_of(text[a:b], left, right)]
    of = {}
    for k, hit, p in set(seeds):
        of.setdefault(p, {}).setdefault(k, set()).add(hit)
    strong = {(p, k): len(hits) for p, kinds in of.items() for k, hits in kinds.items() if len(hits) >= pii.SUPPORT}
    every = {p: len(set().union(*kinds.values())) for p, kinds in of.items()}
    pairs = {(p, hit) for *_, hit, p in free if any(q == p for q, _ in strong)}
    belief = {}
    for _ in range(pii.ROUNDS):
        trust = {}
        for (p, k), n in strong.items():
            own = [hit for q, hit in pairs if q == p]
            trust[p, k] = (n + sum(belief.get((hit, k), 0) for hit in own)) / (every[p] + len(own) + pii.BELIEF)
        belief = {}
        for p, hit in pairs:
            for (q, k), x in trust.items():
                if q == p:
                    belief[hit, k] = max(x, belief.get((hit, k), 0))
    best = {}
    for i, a, b, hit, p in free:
        for (q, k), x in trust.items():
            if q == p and x >= pii.CONFIDENT:
                best[i, a, b] = max(best.get((i, a, b), (0, "", "")), (x, k, hit))
    out, reached = [], {}
    for (i, a, b), (x, k, hit) in sorted(best.items(), key=lambda r: (r[0][0], r[0][1], -r[0][2])):
        if good(k, hit) and reached.get(i, 0) <= a:
            out.append((i, k, a, b))
        if good(k, hit):
            reached[i] = max(b, reached.get(i, 0))
    return sorted(out)


def test_added_spans_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf).select("doc_id", "text")
    extra = [(10_000 + k, f"call us: +1 (203) 555-{k:04d} today") for k in range(30)] + [(11_000, "call us: +1 (203) 555-9999 10.20.30.40 today"), (11_001, "call us: 2035559999 today"), (11_002, "call us: 256.1.1.1 4111 1111 1111 1111 +1 (203) 555-0001")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    found = pii.find(docs)
    got = sorted((r.doc_id, s.kind, s.start, s.end) for r in found.collect() for s in r.spans if not s.base)
    want = brute(texts)
    assert got == want
    assert (11_000, "phone", 9, 26) in want and len(want) >= 4
