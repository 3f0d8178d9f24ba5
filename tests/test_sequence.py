"""Cuts, flashes and shots of small clips that are known beforehand."""

from pyspark.sql import functions as F

from tintmill.operators import records
from tintmill.operators import sequence as seq


def clip(spark, values, clip_id=1):
    return spark.createDataFrame([(clip_id, k, float(v)) for k, v in enumerate(values)], "clip_id long, frame_no long, luma double")


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_cut_and_flash(spark):
    values = [0.2] * 20 + [0.6] * 20 + [0.95] * 2 + [0.6] * 20
    found = seq.deduplicated(seq.boundaries(clip(spark, values)), 10)
    assert rows_of(found, "frame_no", "kind") == [(20, "hard_cut"), (40, "flash")]
    n = spark.createDataFrame([(1, len(values))], "clip_id long, n long")
    shots = seq.shots(found, n, 10)
    assert rows_of(shots, "shot", "start", "end", "ends_with") == [(0, 0, 20, "hard_cut"), (1, 20, 62, "end-of-file")]
    inside = seq.with_shot(clip(spark, values), shots)
    assert inside.groupBy("shot").count().orderBy("shot").collect() == [(0, 20), (1, 42)]
    assert rows_of(seq.representatives(inside), "shot", "representative") == [(0, 0), (1, 20)]


def test_close_boundaries_are_held_against_the_last_kept(spark):
    schema = "clip_id long, frame_no long, kind string, confidence double"
    found = spark.createDataFrame([(1, 10, "hard_cut", 0.5), (1, 14, "hard_cut", 0.9), (1, 19, "hard_cut", 0.9), (1, 20, "hard_cut", 0.4), (2, 3, "flash", 0.2)], schema)
    assert rows_of(seq.deduplicated(found, 10), "clip_id", "frame_no") == [(1, 14), (1, 20), (2, 3)]


def test_time_stamps_of_long_clips(spark):
    """Frame 4,000,000 at 512 ticks: products beyond 32 bits, from columns of 32."""
    stamps = [(0, 0), (139_811, 139_811 * 512), (4_000_000, 4_000_000 * 512), (4_000_000, 4_000_000 * 512 + 9)]
    df = spark.createDataFrame(stamps, "frame_no int, pts int")
    assert [r.off for r in df.select(seq.off_beat(F.col("pts"), F.col("frame_no"), 30, 15360).alias("off")).collect()] == [False, False, False, True]


def test_no_frames(spark):
    empty = clip(spark, [0.1]).filter("clip_id < 0")
    assert seq.deduplicated(seq.boundaries(empty), 10).count() == 0
    assert seq.gradual_windows(empty, 10).count() == 0
    assert seq.boundaries(clip(spark, [0.1])).count() == 0


def test_avoid_terms_are_kept_once_and_unknown_ones_named():
    assert records.avoid_terms(" warm, faded,warm ,noisy,,") == (["warm", "faded"], ["noisy"])
