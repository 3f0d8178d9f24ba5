from pathlib import Path

import pytest

import corpus_pipeline
from tintmill.llm import shared


def test_a_stage_leaves_its_result_alone(spark):
    shared.clear_settled(spark)
    folder = Path(shared.shared_dir(spark)) / "settled"
    folder.mkdir(parents=True, exist_ok=True)

    def make():
        return shared.settle(shared.settle(spark.range(5), "a"), "b").filter("id > 1")

    before = {x.name for x in folder.iterdir()}
    table = shared.settle_stage(spark, make, "result")
    left = [x.name for x in folder.iterdir() if x.name not in before]
    assert len(left) == 1 and left[0].startswith("result") and table.count() == 3
    shared.clear_settled(spark)
    assert not [x for x in folder.iterdir() if x.name not in before]


def test_a_corpus_without_labels_is_an_error_and_not_an_empty_corpus(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="no language to learn"):
        corpus_pipeline.keep_language(spark, docs, "")
    assert corpus_pipeline.keep_language(spark, docs.limit(0), "").count() == 0
