"""The grade chain: pointwise steps from encoded channels to encoded channels, as columns.

Order: tone (contrast, brightness, gamma), saturation, curve, gains, path to white, strength. Channels
stay doubles between steps; only `with_grade` at its end goes back to eight bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintmill.functions import colour


@dataclass(frozen=True)
class Look:
    """Parameters of a grade; the defaults change nothing."""

    brightness: float = 0.0
    contrast: float = 1.0
    gamma: float = 1.0
    saturation: float = 1.0
    temperature: float = 0.0
    tint: float = 0.0
    points: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.0, 1.0))
    mask_start: float = 0.6
    mask_full: float = 0.85

    def scaled(self, strength: float) -> Look:
        """Parameters between neutral and this look; curves move their points towards the diagonal."""
        neutral = Look()
        values = {n: getattr(neutral, n) + (getattr(self, n) - getattr(neutral, n)) * strength for n in ("brightness", "contrast", "gamma", "saturation", "temperature", "tint")}
        return Look(**values, points=tuple((x, x + (y - x) * strength) for x, y in self.points), mask_start=self.mask_start, mask_full=self.mask_full)

    def gains(self) -> tuple[float, float, float]:
        return round(1 + 0.6 * self.temperature, 6), round(1 - 0.35 * self.tint, 6), round(1 - 0.6 * self.temperature, 6)

    def pull(self) -> float | None:
        """Saturation of the light parts, where the look adds enough chroma to need it."""
        adders = max(0.0, self.saturation - 1) + (abs(self.temperature) + abs(self.tint)) * 2
        return round((1 + adders * 0.6) / (1 + adders), 6) if adders > 0.02 else None

    def mask_points(self) -> list[tuple[float, float]]:
        return [(0.0, 0.0), (self.mask_start, 0.0), (self.mask_full, 1.0), (1.0, 1.0)]


def clamped(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def _step(df: DataFrame, names: list[str], of) -> DataFrame:
    return df.withColumns(dict(zip(names, of([F.col(n) for n in names]))))


def _matrix(m):
    return lambda cs: [clamped(colour.combined(row, *cs)) for row in m]


def with_grade(df: DataFrame, look: Look, strength: float = 1.0, out: str = "out_", unrounded: bool = False) -> DataFrame:
    """Adds eight-bit out + r, g, b: source and full look mixed by strength. unrounded: doubles 0..1."""
    own = [f"__{k}" for k in "rgb"]
    df = df.withColumns({n: F.col(k) / 255.0 for n, k in zip(own, "rgb")})
    df = _step(df, own, lambda cs: [F.pow(clamped((c - 0.5) * look.contrast + 0.5 + look.brightness), 1 / look.gamma) for c in cs])
    if look.saturation != 1:
        df = _step(df, own, _matrix(colour.equal_luma_matrix(look.saturation)))
    df = _step(df, own, lambda cs: [colour.curve(c, list(look.points)) for c in cs])
    df = _step(df, own, lambda cs: [clamped(c * g) for c, g in zip(cs, look.gains())])
    if look.pull():
        pulled = _matrix(colour.equal_luma_matrix(look.pull()))
        df = df.withColumn("__mask", colour.curve(colour.combined(colour.LUMINANCE["srgb"], *[F.col(n) for n in own]), look.mask_points()))
        df = _step(df, own, lambda cs: [c + (p - c) * F.col("__mask") for c, p in zip(cs, pulled(cs))]).drop("__mask")
    mixed = {out + k: F.col(k) / 255.0 * (1 - strength) + F.col(n) * strength for n, k in zip(own, "rgb")}
    if not unrounded:
        mixed = {n: F.rint(c * 255).cast("int") for n, c in mixed.items()}
    mixed[out + "r"] = colour.apart(mixed[out + "r"])
    return df.withColumns(mixed).drop(*own)


def perceptual(strength: float, gamma: float) -> float:
    return strength**gamma


def strength_of(foundation_only: Column, strength: Column, gamma: float) -> Column:
    """A strength as the eye sees it, by one mapping for all; none where only the foundation is asked for."""
    return F.when(foundation_only, 0.0).otherwise(F.pow(strength, gamma))


def towards(neutral: float, target: Column, strength: Column) -> Column:
    """A parameter, or the height of a curve's point, between neutral and target."""
    return (target - neutral) * strength + neutral


def radial(v: Column, x: Column, y: Column, centre: tuple[float, float], radius: float, shade: float) -> Column:
    """v darkened away from a centre; x and y are shares of width and height."""
    return v * (F.lit(1.0) - F.least(F.lit(1.0), F.hypot(x - centre[0], y - centre[1]) / radius) * min(0.2, shade))


def merged(base: Column, over: Column, mask: Column) -> Column:
    """over through an eight-bit mask."""
    return base + (over - base) * mask / 255.0


def local_compose(base: Column, look: Column, target: Column, protect: Column, strength: float) -> Column:
    return base + (look - base) * target * (F.lit(1.0) - protect) * strength
