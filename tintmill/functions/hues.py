"""CIELAB hues of 8-bit colours, worked out on Arrow batches inside tasks.

Spark takes powers and arc tangents from Java's StrictMath, SQL takes them from the C library; the last bits differ. Two
colours of one hue (shades of a primary, say) then are 0 degrees apart by one and 3e-14 by the other, which shows where
angles of 0 are counted or a value lies at half of the last decimal. Here both come from the C library, by Python's
`math`, and steps follow in the formula's order.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tintmill.functions import colour

#: Stands for the hue of a colour whose chroma is below `colour.LEAST_CHROMA`.
NO_HUE = -1.0


def _linear(channel: np.ndarray) -> np.ndarray:
    """Encoded channels to linear light, each value of a batch once."""
    values, at = np.unique(channel, return_inverse=True)
    return np.array([v / 255 / 12.92 if v / 255 <= 0.04045 else math.pow((v / 255 + 0.055) / 1.055, 2.4) for v in values.tolist()])[at]


def _lab_root(row: list[float], white: float, *linear: np.ndarray) -> np.ndarray:
    """A tristimulus value over white, by the cube root that CIELAB takes of it."""
    total = row[0] * linear[0] + row[1] * linear[1] + row[2] * linear[2]
    ratio = total / white
    out = 841 / 108 * total / white + 4 / 29
    bright = ratio > 216 / 24389
    out[bright] = np.fromiter(map(math.pow, ratio[bright].tolist(), repeat(1 / 3)), float)
    return out


def hues(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees from 0 to 360, or NO_HUE."""
    linear = [_linear(c) for c in (r, g, b)]
    fx, fy, fz = (_lab_root(row, white, *linear) for row, white in zip(colour.XYZ_FROM_LINEAR["srgb"], colour.WHITE))
    a, b = 500 * (fx - fy), 200 * (fy - fz)
    angle = np.fromiter(map(math.atan2, b.tolist(), a.tolist()), float) * (180 / math.pi)
    return np.where(np.sqrt(a * a + b * b) < colour.LEAST_CHROMA, NO_HUE, np.where(angle < 0, angle + 360, angle))


def _hues_of_batch(r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
    """Null where a channel is null."""
    whole = ~np.any([c.is_null().to_numpy(zero_copy_only=False) for c in (r, g, b)], axis=0)
    out = np.full(len(r), NO_HUE)
    out[whole] = hues(*[c.to_numpy(zero_copy_only=False)[whole] for c in (r, g, b)])
    return pa.array(out, mask=~whole)


hue_or_none = F.arrow_udf(_hues_of_batch, DoubleType())


def hue_angle_error(first: tuple[str, str, str], second: tuple[str, str, str]) -> Column:
    """`colour.hue_angle_error` of two 8-bit colours, given by the names of their channels."""
    one, two = hue_or_none(*first), hue_or_none(*second)
    gap = F.abs(one - two)
    return F.when((one == NO_HUE) | (two == NO_HUE), 0.0).otherwise(F.least(gap, F.lit(360.0) - gap))
