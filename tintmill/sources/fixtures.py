"""Pixel, clip and recipe shapes over the supplied tables: deterministic integer projections.

Each view is an ordinary DataFrame; a table of real pixels with the same columns takes its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 32
#: Rows of line items that one task holds, about, and the fewest that are worth a task of their own.
TASK_ROWS, LEAST_TASK_ROWS = 200_000, 25_000
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_parts(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions line items are dealt out to by frame: with the table they grow in number, not in size.
    The count is read from the files' footers."""
    n = table(spark, sf_dir, "lineitem").count()
    return max(1, min(spark.sparkContext.defaultParallelism, -(-n // LEAST_TASK_ROWS)), -(-n // TASK_ROWS))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a pixel of its supplier's frame; the last row of a frame may be shorter."""
    items = table(spark, sf_dir, "lineitem").select(*ORDER).repartition(frame_parts(spark, sf_dir), "l_suppkey")
    frame = Window.partitionBy("l_suppkey")
    rows = items.withColumns({"idx": F.row_number().over(frame.orderBy(*ORDER)) - 1, "n": F.count(F.lit(1)).over(frame)})
    rows = rows.withColumns({"frame_id": F.col("l_suppkey"), "q": F.col("l_quantity").cast("int"), "x": F.col("idx") % WIDTH, "y": F.expr(f"cast(idx div {WIDTH} as int)")})
    return rows.withColumn("h", F.ceil(F.col("n") / WIDTH).cast("int"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, idx, x, y, h, r, g, b: noise-like frames, 32 wide."""
    rows = _placed(spark, sf_dir)
    return rows.select("frame_id", "idx", "x", "y", "h", ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 31) % 256).cast("int").alias("r"), ((F.col("q") * 5 + F.col("l_orderkey")) % 256).cast("int").alias("g"), ((F.col("l_suppkey") * 13 + F.col("l_partkey")) % 256).cast("int").alias("b"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, idx, x, y, h, r, g, b: frames with gradients, for space, masks and palettes."""
    rows = _placed(spark, sf_dir)
    return rows.select("frame_id", "idx", "x", "y", "h", ((F.col("x") * 8 + F.col("y") * 3 + F.col("q")) % 256).cast("int").alias("r"), ((F.col("y") * 12 + F.col("l_linenumber") * 4) % 256).cast("int").alias("g"), F.pmod(F.lit(255) - F.col("x") * 6 + F.col("l_suppkey") * 5, F.lit(256)).cast("int").alias("b"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, luma of a clip: events in order of time, a clip a day."""
    events = table(spark, sf_dir, "events")
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long")
    order = Window.partitionBy("clip_id").orderBy("ts", "event_id")
    return events.withColumn("clip_id", day).select("clip_id", (F.row_number().over(order) - 1).alias("frame_no"), "event_id", "user_id", F.col("value"), (F.col("value") / 490.0).alias("luma"))


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    price = F.floor(F.col("p_retailprice")).cast("long")
    return part.select(
        F.col("p_partkey").alias("recipe_id"), (F.col("p_size") / 50.0 * 0.8 + 0.6).alias("saturation"), ((price % 100 - 50) / 500.0).alias("temperature"),
        ((F.col("p_partkey") % 21 - 10) / 25.0).alias("midpoint_ev"), F.col("p_type").alias("tone_tag"), (F.col("p_partkey") % 7).alias("color_tag"), F.col("p_brand").alias("media"),
    )


# The same views as DuckDB SQL, for the oracle.
_ORDER = ", ".join(ORDER)
PLACED_SQL = f"""placed AS (SELECT *, l_suppkey AS frame_id, CAST(l_quantity AS INT) AS q, CAST(idx % {WIDTH} AS INT) AS x, CAST(idx // {WIDTH} AS INT) AS y, CAST((n + {WIDTH - 1}) // {WIDTH} AS INT) AS h FROM (
  SELECT {_ORDER}, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 1 AS idx, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem))"""
PIXELS_SQL = f"{PLACED_SQL}, px AS (SELECT frame_id, idx, x, y, h, CAST((l_partkey * 7 + l_linenumber * 31) % 256 AS INT) AS r, CAST((q * 5 + l_orderkey) % 256 AS INT) AS g, CAST((l_suppkey * 13 + l_partkey) % 256 AS INT) AS b FROM placed)"
SCENES_SQL = f"{PLACED_SQL}, px AS (SELECT frame_id, idx, x, y, h, CAST((x * 8 + y * 3 + q) % 256 AS INT) AS r, CAST((y * 12 + l_linenumber * 4) % 256 AS INT) AS g, CAST(((255 - x * 6 + l_suppkey * 5) % 256 + 256) % 256 AS INT) AS b FROM placed)"
STEPS_SQL = "steps AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS clip_id, row_number() OVER (PARTITION BY floor(epoch(ts) / 86400) ORDER BY ts, event_id) - 1 AS frame_no, event_id, user_id, value, value / 490e0 AS luma FROM events)"
RECIPES_SQL = "recipes AS (SELECT p_partkey AS recipe_id, p_size / 50e0 * 8e-1 + 6e-1 AS saturation, (CAST(floor(p_retailprice) AS BIGINT) % 100 - 50) / 500e0 AS temperature, (p_partkey % 21 - 10) / 25e0 AS midpoint_ev, p_type AS tone_tag, p_partkey % 7 AS color_tag, p_brand AS media FROM part)"
