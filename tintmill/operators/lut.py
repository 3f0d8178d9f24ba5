"""Three-dimensional tables of a grade: the lattice, its cells, interpolation and precision.

A lattice of size n holds a grade at n x n x n colours. For use it becomes a table of cells, a row with the values
of its eight corners, so a pixel meets one row by equi-join and interpolates in columns. A table of cells has
(n - 1) cubed rows; Spark broadcasts it where it is small enough, and joins by shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORNERS = [(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)]


def lattice(spark: SparkSession, size: int) -> DataFrame:
    """i, j, k (red fastest) and the encoded colour r, g, b (0..255, not rounded) of each point."""
    at = [(F.expr(f"id div {size**n}") % size).cast("int").alias(c) for n, c in enumerate("ijk")]
    points = spark.range(size**3).select(*at)
    return points.withColumns({c: F.col(n) / (size - 1.0) * 255.0 for c, n in zip("rgb", "ijk")})


def baked(points: DataFrame, grade: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The lattice through a grade that adds out_r, out_g, out_b (0..1): what a file of the table would hold, eight bits."""
    out = grade(points)
    return out.select("i", "j", "k", *[(F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"out_{c}"))) * 255) / 255.0).alias(f"v{c}") for c in "rgb"])


def cells(values: DataFrame, size: int) -> DataFrame:
    """A row for each cell: ci, cj, ck and v<channel><corner> of its eight corners. Each point goes to the
    cells whose corner it is; one aggregate brings a cell's corners together."""
    shifts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for n, (i, j, k) in enumerate(CORNERS)])
    each = values.withColumn("c", F.explode(shifts)).withColumns({f"c{a}": F.col(a) - F.col(f"c.{a}") for a in "ijk"})
    inside = F.least("ci", "cj", "ck") >= 0
    each = each.filter(inside & (F.greatest("ci", "cj", "ck") < size - 1))
    own = [F.max(F.when(F.col("c.n") == n, F.col(f"v{ch}"))).alias(f"v{ch}{n}") for ch in "rgb" for n in range(len(CORNERS))]
    return each.groupBy("ci", "cj", "ck").agg(*own)


def applied(px: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """px (r, g, b, eight bits) with lut_r, lut_g, lut_b: eight bits, trilinear between the corners of the cell."""
    place = {c: F.col(c) / 255.0 * (size - 1) for c in "rgb"}
    cell = {a: F.least(F.lit(size - 2), F.floor(place[c]).cast("int")) for a, c in zip("ijk", "rgb")}
    rows = px.withColumns({f"c{a}": v for a, v in cell.items()}).join(table, ["ci", "cj", "ck"])
    rest = [place[c] - F.col(f"c{a}") for a, c in zip("ijk", "rgb")]

    def value(channel: str) -> Column:
        total = F.lit(0.0)
        for n, corner in enumerate(CORNERS):
            weight = F.lit(1.0)
            for share, on in zip(rest, corner):
                weight = weight * (share if on else F.lit(1.0) - share)
            total = total + weight * F.col(f"v{channel}{n}")
        return F.rint(total * 255).cast("int")

    rows = rows.withColumns({f"lut_{c}": value(c) for c in "rgb"})
    return rows.drop("ci", "cj", "ck", *[f"v{ch}{n}" for ch in "rgb" for n in range(len(CORNERS))])


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place round((n - 1) * p), half to even, of an array in order."""
    return F.get(values, F.rint((F.size(values) - 1) * F.lit(p)).cast("int"))


def precision(differences: DataFrame) -> DataFrame:
    """differences (frame_id, de00) to pixels, median, p95 of each frame. A frame is bounded (sampled)."""
    ordered = F.array_sort(F.collect_list("de00"))
    out = differences.groupBy("frame_id").agg(F.percentile("de00", 0.5).alias("median"), ordered.alias("v"))
    return out.select("frame_id", F.size("v").cast("long").alias("pixels"), "median", nearest_rank(F.col("v"), 0.95).alias("p95"))


def split_verdict(measured: DataFrame, key: str, learn: int = 28, hold: int = 12) -> DataFrame:
    """measured (key, median, p95) to one row: the first `learn` frames by sha256 of their key set the thresholds
    (the 95th percentile by rank of each figure), the next `hold` must meet both. Only learn + hold rows meet in one task."""
    mark = F.sha2(F.col(key).cast("string"), 256)
    first = measured.withColumn("mark", mark).orderBy("mark").limit(learn + hold)
    own = first.agg(F.sort_array(F.collect_list(F.struct("mark", "median", "p95"))).alias("rows"))
    part = lambda name: F.array_sort(F.transform(F.slice("rows", 1, learn), lambda r: r[name]))
    own = own.withColumns({f"most_{n}": F.round(nearest_rank(part(n), 0.95), 4) for n in ("median", "p95")})
    held = F.slice("rows", learn + 1, hold)
    passed = F.size(F.filter(held, lambda r: (r["median"] <= F.col("most_median")) & (r["p95"] <= F.col("most_p95"))))
    status = F.when(F.size("rows") < learn + hold, "too few").when(passed == hold, "passed").otherwise("not met")
    return own.select("most_median", "most_p95", passed.cast("long").alias("passed"), F.size(held).cast("long").alias("held_out"), status.alias("status"))
