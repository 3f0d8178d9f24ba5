"""Tables of a grade: cells, interpolation and thresholds by hand."""

import pytest
from pyspark.sql import functions as F

from tintmill.operators import lut


def table(spark, size, of):
    return lut.cells(lut.baked(lut.lattice(spark, size), lambda df: df.withColumns({f"out_{c}": of(c) for c in "rgb"})), size)


def test_identity_comes_back(spark):
    px = spark.createDataFrame([(k, 17 * k % 256, 255 - k, k) for k in range(256)], "idx long, r int, g int, b int")
    for size in (2, 6, 17):  # 5 and 255 steps: the lattice's own values are whole
        if 255 % (size - 1):
            continue
        own = table(spark, size, lambda c: F.col(c) / 255.0)
        out = lut.applied(px, own, size).collect()
        assert own.count() == (size - 1) ** 3 and len(out) == 256
        assert all((r.lut_r, r.lut_g, r.lut_b) == (r.r, r.g, r.b) for r in out)


def test_a_product_of_channels_is_trilinear(spark):
    """r * g * b is linear along each side of a cell, so a table of two steps holds it exactly, corners rounded."""
    px = spark.createDataFrame([(0, 255, 255, 255), (1, 0, 255, 255), (2, 51, 255, 255), (3, 128, 64, 200)], "idx long, r int, g int, b int")
    own = table(spark, 2, lambda c: F.col("r") * F.col("g") * F.col("b") / 255.0**3)
    got = {r.idx: r.lut_r for r in lut.applied(px, own, 2).collect()}
    assert got == {0: 255, 1: 0, 2: 51, 3: round(128 * 64 * 200 / 255**2)}


def test_more_steps_come_nearer(spark):
    px = spark.range(256).select(F.col("id").alias("idx"), *[F.col("id").cast("int").alias(c) for c in "rgb"])
    worst = []
    for size in (5, 17, 33):
        out = lut.applied(px, table(spark, size, lambda c: F.pow(F.col(c) / 255.0, 2.2)), size)
        worst.append(out.agg(F.max(F.abs(F.col("lut_r") - F.pow(F.col("r") / 255.0, 2.2) * 255))).first()[0])
    assert worst[0] > worst[1] > worst[2] and worst[2] <= 1.0


@pytest.mark.parametrize("count, far, status", [(40, 0, "passed"), (40, 1, "not met"), (30, 0, "too few")])
def test_thresholds_from_one_part_hold_for_the_other(spark, count, far, status):
    import hashlib

    order = sorted(range(count), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())
    rows = [(k, 1.0, 2.0 if n < 39 or not far else 2.1) for n, k in enumerate(order)]
    r = lut.split_verdict(spark.createDataFrame(rows, "frame_id long, median double, p95 double"), "frame_id").first()
    assert r.status == status and (r.most_median, r.most_p95) == (1.0, 2.0) and r.held_out == min(12, count - 28)
