"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes what its predecessor kept; all but the last return the columns of documents. Each
stage's input is a Parquet table. Stages take tables without rows, rows that are null in any column,
repeated rows, and texts of any length, as their operators say; extra columns pass through, but for
packing, which returns pieces.

What a stage settles on its way is deleted when its own result is written. The tables that the result
of run() reads stay until `shared.clear_settled` is called, after that result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.llm import exact_dedup, language_id, mixing, packing, simhash_dedup
from tintmill.llm.shared import documents, quoted, settle_stage, unused


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on; those that the model rejects go. Null texts and texts
    without a letter have no language, so they go too. If no row is labelled, nothing can be learned and
    nothing is known: that is an error, not an empty corpus."""
    model = language_id.fit(docs)
    if not model.langs and not docs.isEmpty():
        raise ValueError("no labelled row has a letter: there is no language to learn")
    into = unused(docs) + "language"
    named = language_id.identify(docs, model, into=into)
    return named.filter(~F.col(f"{into}.rejected")).select(*[quoted(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; of repeated rows, one."""
    return exact_dedup.kept_rows(docs, exact_dedup.exact_dedup(docs))


def _of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id found has; a null is found like any other."""
    name = unused(docs) + "id"
    ids = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


#: Similarity of the sets of five-word shingles from which two documents are near copies.
NEAR = 0.8


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies or linked fingerprints the document that names it stays (the smallest
    doc_id). Rows that share a doc_id, all those without one among them, stay or go together."""
    found = simhash_dedup.near_dedup(docs, similarity=NEAR, words=5)
    return _of(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


#: Thousandths of all tokens that the mix of the pipeline takes; every document once at most.
MIX_SHARE = 800


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the budget of their leaf; the document at a leaf's cut stays whole. Rows that
    share a doc_id stay if one of them is taken."""
    return _of(docs, mixing.mix(docs, share=MIX_SHARE, epochs=1))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences, along the curve; a null text is the separator alone."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("language_id", keep_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and fingerprints are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle_stage(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
