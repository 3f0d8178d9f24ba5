"""Six decimals as SQL rounds to them."""

import duckdb
import pyarrow as pa

from tintmill.plans.frames import r6, s6


def test_halves_of_the_last_decimal(spark):
    """Of these numbers that end, or nearly end, with a half of the sixth decimal, some went up in one and down in the other."""
    halves = [(2 * k + 1) / 2e6 for k in range(20_000)] + [133.3581535, 88.57705849999999, 16.5555575, 6.1534984999999995]
    t = pa.table({"v": halves + [-v for v in halves] + [0.0, -0.0, -1e-9, 1e-9, 1e12 + 0.3, float("inf"), float("nan"), None]})  # noqa: F841
    theirs = [repr(r[0]) for r in duckdb.sql(f"SELECT {s6(v='v')} FROM t").fetchall()]
    mine = [repr(r[0]) for r in spark.createDataFrame(t).select(r6("v")).collect()]
    assert [(h, a, b) for h, a, b in zip(t["v"].to_pylist(), mine, theirs) if a != b] == []
