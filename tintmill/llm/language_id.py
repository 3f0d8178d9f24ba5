"""Language identification by interpolated Kneser-Ney character models.

One order-5 model per language, learned from a bounded sample of labelled rows with a letter (about
SAMPLE different texts a language, all if there are fewer, of PIECE characters at most; chosen by a 63-bit
hash of the text, so that the sample's size depends neither on the corpus nor on its repeats). Counts of 5-grams are summed by Spark; continuation counts,
discounts and interpolation follow from them. Grams of all languages share sorted hash arrays: a
key's place in the array is its row of log-probabilities, one for each language. A text gets the
language with the lowest length-normalised cross-entropy. A part of the sample that is not learned
from calibrates the score (softmax temperature) and the rejection: a text whose cross-entropy lies
more than REJECT deviations above what its language shows is rejected. A language with fewer than
FEW calibration rows takes the limits of all languages' rows together.

Defined cases: null text, or text without a letter (combining marks are none), is `und`, score 0,
rejected; empty tables give no rows; without any labelled row with a letter every text is `und`; if
no row is left to calibrate with, nothing with a letter is rejected; equal cross-entropies go to the
first language in alphabetical order; repeated rows get equal results; a very long text is scored
whole, in one piece of some 60 bytes of memory a character and 4 more for each language; other columns pass through or are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.llm.shared import documents, is_held_out, settle, slices

ORDER = 5
#: Bits of a character in a gram's hash (folded code points): 5 x 12 bits fit into 63.
BITS = 12
MASK = (1 << BITS) - 1
#: Labelled rows of a language that are learned from, at most about; and one in CALIBRATE of them calibrates.
SAMPLE, CALIBRATE = 600, 5
#: Characters of a text that are learned from at once; a longer text counts as several.
PIECE = 1 << 16
REJECT, FEW = 8.0, 8
PAD = "\x01" * (ORDER - 1)
RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


def letters(text: Column) -> Column:
    """Lower-case letters and their marks, everything else between them one space; null and letterless text: ''."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), plain).otherwise("")


def bound(sample: int, rows: int) -> int:
    """Draws of 63 bits below this are sampled: about `sample` of so many rows, all of fewer."""
    return min(2**63 - 1, (sample << 63) // max(rows, 1))


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, each after PAD and before a space; first scored place of each; places."""
    parts = [PAD + x + " " for x in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = ((codes ^ (codes >> BITS)) & MASK).astype(np.int64)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    return folded, ends - sizes + len(PAD), ends


def _grams(folded: np.ndarray) -> np.ndarray:
    out = folded.copy()
    for back in range(1, ORDER):
        out[back:] |= folded[:-back] << (BITS * back)
    return out


def _scored(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    marks = np.zeros(size + 1, np.int8)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]).astype(bool)


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (lang, gram, n), summed by batch."""
    for batch in batches:
        frame = batch.to_pandas()
        for lang, own in frame.groupby("lang"):
            folded, starts, ends = _folded(own["text"].tolist())
            grams, n = np.unique(_grams(folded)[_scored(starts, ends, len(folded))], return_counts=True)
            yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams), "n": pa.array(n.astype(np.int64))})


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


class Model:
    """Sorted hash arrays by order, with a row of natural log-probabilities for each gram and of log
    back-off weights for each context; a column for each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.temperature, self.limits = 1.0, {}
        if not self.langs:
            return
        width = len(self.langs)
        grams = {n: {} for n in range(1, ORDER + 1)}
        for lang, (keys, n) in counts.items():
            grams[ORDER][lang] = (keys, n.astype(np.float64))
            for order in range(ORDER - 1, 0, -1):
                low, c = np.unique(grams[order + 1][lang][0] & ((1 << BITS * order) - 1), return_counts=True)
                grams[order][lang] = (low, c.astype(np.float64))
        letters = len(np.unique(np.concatenate([grams[1][x][0] for x in self.langs]))) + 1
        self.floor = np.full(width, -np.log(letters), np.float32)
        self.keys, self.rows, self.contexts, self.backoff = {}, {}, {}, {}
        for order in range(1, ORDER + 1):
            self.keys[order] = np.unique(np.concatenate([grams[order][x][0] for x in self.langs]))
            self.contexts[order] = np.unique(self.keys[order] >> BITS)
            rows = np.zeros((len(self.keys[order]), width), np.float32)
            backoff = np.zeros((len(self.contexts[order]), width), np.float32)
            lower = self.look(order - 1, self.keys[order] & ((1 << BITS * (order - 1)) - 1)) if order > 1 else np.tile(self.floor, (len(rows), 1))
            for k, lang in enumerate(self.langs):
                keys, c = grams[order][lang]
                once, twice = max(1, (c == 1).sum()), (c == 2).sum()
                discount = min(0.95, max(0.1, once / (once + 2 * twice)))
                at = np.searchsorted(self.contexts[order], keys >> BITS)
                total = np.bincount(at, c, len(backoff))
                kinds = np.bincount(at, None, len(backoff))
                spare = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                backoff[:, k] = np.log(spare)
                mine = np.zeros(len(rows))
                mine[np.searchsorted(self.keys[order], keys)] = (c - discount) / total[at]
                weight = spare[np.searchsorted(self.contexts[order], self.keys[order] >> BITS)]
                rows[:, k] = np.log(mine + weight * np.exp(lower[:, k]))
            self.rows[order], self.backoff[order] = rows, backoff

    def look(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities (grams x languages) of the last character of each gram."""
        if order == 0:
            return np.tile(self.floor, (len(grams), 1))
        at, known = _places(self.keys[order], grams)
        out = self.rows[order][at]
        rest = np.flatnonzero(~known)
        if len(rest):
            missing = grams[rest]
            low = self.look(order - 1, missing & ((1 << BITS * (order - 1)) - 1))
            where, seen = _places(self.contexts[order], missing >> BITS)
            out[rest] = low + np.where(seen[:, None], self.backoff[order][where], 0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character (texts x languages), and characters of each text."""
        folded, starts, ends = _folded(texts)
        values = self.look(ORDER, _grams(folded))
        values[~_scored(starts, ends, len(folded))] = 0
        sums = np.add.reduceat(values, starts, axis=0, dtype=np.float64)  # what lies before the next start scores 0
        return -sums / np.log(2) / (ends - starts)[:, None], ends - starts

    def calibrate(self, bits: np.ndarray, n: np.ndarray, langs: list[str]) -> None:
        """From the entropies (rows x languages), lengths and languages of rows set aside."""
        known = np.array([x in self.langs for x in langs], bool)
        if not known.any():
            return
        bits, n = bits[known], n[known]
        truth = np.array([self.langs.index(x) for x in langs if x in self.langs])
        losses = []
        grid = 2.0 ** np.arange(-2, 9)
        for t in grid:
            z = -t * bits
            z -= z.max(axis=1, keepdims=True)
            losses.append(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())
        self.temperature = float(grid[int(np.argmin(losses))])
        together = bits[np.arange(len(truth)), truth]
        for k in range(len(self.langs)):
            own, size = bits[truth == k, k], n[truth == k]
            if len(own) < FEW:
                own, size = together, n
            if len(own) >= FEW:
                middle = float(np.median(own))
                square = (own - middle) ** 2
                per_character = float(np.median(square * size) * 2.2)
                self.limits[k] = (middle, float(np.median(square) * 2.2) + 0.01, per_character)

    def decide(self, texts: list[str]) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "cross_entropy": np.nan, "rejected": True}, index=range(len(texts)))
        some = [k for k, t in enumerate(texts) if t]
        if not some or not self.langs:
            return out
        bits, n = self.entropies([texts[k] for k in some])
        best = bits.argmin(axis=1)
        lowest = bits[np.arange(len(some)), best]
        score = 1 / np.exp(-self.temperature * (bits - lowest[:, None])).sum(axis=1)
        far = np.zeros(len(some), bool)
        for k, (middle, steady, per_character) in self.limits.items():
            far |= (best == k) & (lowest > middle + REJECT * np.sqrt(steady + per_character / n))
        out.loc[some, "lang_pred"] = np.array(self.langs, object)[best]
        out.loc[some, "score"] = score
        out.loc[some, "cross_entropy"] = lowest
        out.loc[some, "rejected"] = far
        return out


def fit(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of the labelled rows of docs that are not held out. The sample's size is bounded by about
    `sample` different texts a language, of PIECE characters at most; what reaches the driver is its distinct 5-grams."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~is_held_out(doc_id, 4))
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.md5(F.col(text)).alias("key"))
    # Equal texts of a language are one, and a long text is as many as it has pieces: repeats neither
    # crowd out other texts nor come in beside each other, and no text is more than PIECE characters.
    pieces = rows.withColumn("piece", F.explode(F.expr(f"sequence(0L, (length(text) - 1) div {PIECE})")))
    drawn = lambda name: F.shiftrightunsigned(F.xxhash64(F.lit(name), "key", "piece"), 1)
    pieces = pieces.withColumns({"draw": drawn("sample"), "aside": drawn("aside") % CALIBRATE == 0})
    sizes = {r["lang"]: r["n"] for r in pieces.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not sizes:
        return Model({})
    chosen = F.lit(False)
    for x, n in sizes.items():
        chosen = chosen | ((F.col("lang") == x) & (F.col("draw") <= bound(sample, n)))
    cut = F.substring(F.col("text"), (F.col("piece") * PIECE + 1).cast("int"), F.lit(PIECE))
    own = pieces.filter(chosen).select("lang", "key", "piece", "aside", cut.alias("text")).dropDuplicates(["lang", "key", "piece"])
    rows = settle(own.select(letters(F.col("text")).alias("text"), "lang", "aside").filter("text != ''"), "language-sample")
    learned = rows.filter("not aside").select("text", "lang").mapInArrow(_counted, "lang string, gram long, n long")
    table = learned.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "gram"])
    model = Model({x: (own["gram"].to_numpy(), own["n"].to_numpy()) for x, own in table.groupby("lang")})
    if not model.langs:  # a handful of rows, all of them set aside: learn from them, calibrate with none
        table = rows.select("text", "lang").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        return Model({x: (own["gram"].to_numpy(), own["n"].to_numpy()) for x, own in table.sort_values(["lang", "gram"]).groupby("lang")})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def measured(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices([batch], 1 << 20):
                bits, n = shared.value.entropies(own.column(0).to_pylist())
                yield pa.record_batch({"bits": pa.array(list(bits), pa.list_(pa.float64())), "n": pa.array(n), "lang": own.column(1)})

    # Only numbers of the rows set aside reach the driver, not their texts.
    aside = rows.filter("aside").select("text", "lang").mapInArrow(measured, "bits array<double>, n long, lang string").orderBy("lang", "n").toPandas()
    if len(aside):
        model.calibrate(np.array(aside["bits"].tolist()), aside["n"].to_numpy(), aside["lang"].tolist())
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column `into`: lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            texts, out, at = batch.tolist(), [], 0
            while at < len(texts):  # about a million characters at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                    size, to = size + len(texts[to]), to + 1
                out.append(own.decide(texts[at:to]))
                at = to
            yield pd.concat(out, ignore_index=True) if out else own.decide([])

    return docs.withColumn(into, predict(letters(F.col(text))))


def op5_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs)
    rows = docs.select("doc_id", is_held_out("doc_id", 4).alias("held_out"), "text")
    named = identify(rows, model)
    return named.select("doc_id", "held_out", F.col("language.lang_pred"), F.col("language.score"), F.col("language.cross_entropy"), F.col("language.rejected"))
