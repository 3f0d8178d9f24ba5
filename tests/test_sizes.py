"""What one task holds must not grow with the tables."""

import re

import pytest
from pyspark.sql import functions as F

from tintmill.plans import matching, registry
from tintmill.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["palette_roles", "palette_bins", "box_blur_contrast", "already_polished"])
def test_frames_are_dealt_out_by_their_number_and_once(spark, name, monkeypatch):
    """A twentieth of the usual rows a task gives as many more partitions, and no second exchange of the pixels."""
    n = fixtures.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(fixtures, "TASK_ROWS", n // 20)
    assert fixtures.frame_parts(spark, SF) in (20, 21)
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey" in plan and f", {fixtures.frame_parts(spark, SF)}), REPARTITION_BY_NUM" in plan
    assert "REPARTITION_BY_COL" not in plan and plan.count("REPARTITION_BY_NUM") == 1


def test_pixels_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    per_task = fixtures.scenes(spark, SF).groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)), F.sum("count")).first()
    assert per_task[0] > 2 and per_task[1] == fixtures.table(spark, SF, "lineitem").count()


def test_recipes_are_scored_by_many_tasks(spark, monkeypatch):
    """One file of recipes was one task; and each word took several turns of the expression that strips it."""
    n = fixtures.table(spark, SF, "part").count()
    monkeypatch.setattr(matching, "TASK_CARDS", n // 10)
    assert registry.queries()["keyword_score"](spark, SF).rdd.getNumPartitions() in (10, 11)


def test_places_are_zipped_in_the_partitions_of_their_frames(spark, monkeypatch):
    n = fixtures.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(fixtures, "TASK_ROWS", n // 20)
    assert registry.queries()["zip_complete"](spark, SF).rdd.getNumPartitions() == fixtures.frame_parts(spark, SF)


@pytest.mark.parametrize("name", ["lut_precision_17", "lut_precision_33", "lut_review", "fit_score", "fit_preflight", "fit_score_top3", "gate_skin_corridor"])
def test_the_virtual_machine_compiles_what_runs_for_each_pixel(spark, name, capsys):
    """Methods of more than 8,000 bytes stay interpreted: these queries had ones of 20,000 and more."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        registry.queries()[name](spark, SF).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    found = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert found and max(found) < 8000


def test_clusters_get_the_columns_that_they_read_as_arrow(spark):
    """Rows went through pandas with six columns that no cluster reads."""
    plan = registry.queries()["palette_targets"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "FlatMapGroupsIn" in line)
    assert "FlatMapGroupsInArrow" in grouped and "r8" not in grouped


def test_a_task_zips_a_place_once(spark):
    """Distinct inputs of a place were kept as rows of their own, three a place, before they were counted."""
    plan = registry.queries()["zip_complete"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or(part" in plan and "distinct" not in plan
