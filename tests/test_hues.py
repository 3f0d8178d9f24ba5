"""Angles between CIELAB hues against SQL, where the last bit decides."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tintmill.functions import hues
from tintmill.plans import registry

#: Shades of primaries and of their mixtures: the colours of a family have one hue, but for rounding.
FAMILIES = [[(k * r, k * g, k * b) for k in range(64, 256, 2)] for r, g, b in ((0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0))]


def line_item(first, second):
    """Keys that make the first pixel of a frame `first` in one picture and `second` in the other; None where there are none."""
    (r1, g1, b1), (r2, g2, b2) = first, second
    supplier = (b2 + 1) * pow(5, -1, 256) % 256
    part = (b1 - 13 * supplier) % 256
    line = next((n for n in range(256) if n * 4 % 256 == g2 and (7 * part + 31 * n) % 256 == r1), None)
    return None if line is None else {"l_orderkey": (g1 - 5 * r2) % 256, "l_linenumber": line, "l_partkey": part, "l_suppkey": supplier, "l_quantity": float(r2), "l_extendedprice": 1.0}


def both(spark, tmp_path, items):
    """Rows of the query and of its SQL over these line items."""
    path = str(tmp_path / "lineitem.parquet")
    pq.write_table(pa.Table.from_pylist(items), path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    mine = registry.queries()["hue_angle_error"](spark, str(tmp_path))
    return sorted(map(tuple, mine.collect()), key=repr), sorted(con.sql(f"SELECT {', '.join(mine.columns)} FROM ({registry.oracles()['hue_angle_error']})").fetchall(), key=repr)


def test_one_hue_is_no_angle_where_it_is_none_in_sql(spark, tmp_path):
    """Of pairs of one hue, each in a frame of its own, Spark's arithmetic gave others an angle of 0 than SQL's does."""
    found = [line_item(a, b) for family in FAMILIES for a in family for b in family]
    items = [i | {"l_suppkey": i["l_suppkey"] + 256 * k} for k, i in enumerate(i for i in found if i)]
    mine, theirs = both(spark, tmp_path, items)
    assert len(items) > 100 and len(mine) == len(items) and mine == theirs
    assert {r[-1] for r in theirs} == {0, 1}


def test_missing_keys_are_missing_colours(spark, tmp_path):
    """A pixel without a colour has no angle, unless the other colour is too grey for one."""
    keys = [(o, n, p) for o, n, p in ((None, 1, 7), (4, 2, None), (5, None, 9), (9, 3, 8), (-7, 1, -300)) for _ in range(40)]
    items = [{"l_orderkey": o, "l_linenumber": n, "l_partkey": p, "l_suppkey": s, "l_quantity": 9.0, "l_extendedprice": 1.0} for s, (o, n, p) in enumerate(keys)]
    mine, theirs = both(spark, tmp_path, items)
    assert len(mine) == 200 and mine == theirs


def test_many_rows_and_none(spark):
    grey = spark.range(30_000).select(*[(F.col("id") % 256).cast("int").alias(k) for k in "rgb"])
    assert grey.select(hues.hue_or_none("r", "g", "b").alias("h")).where(f"h != {hues.NO_HUE}").count() == 0
    assert grey.limit(0).select(hues.hue_or_none("r", "g", "b")).count() == 0
