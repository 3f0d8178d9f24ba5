"""Colour science as column expressions: encoded 8-bit channels to linear light, OKLab, CIELAB and back.

Every function takes and returns columns and stays inside code generation; the `with_*` helpers add
the steps of a conversion one below the other, so that no step is computed twice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published sRGB / Display P3 primaries and the OKLab matrices, to the digits that results depend on.
XYZ_FROM_LINEAR = {
    "srgb": [[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]],
    "display-p3": [[0.48657095, 0.26566769, 0.19821729], [0.22897456, 0.69173852, 0.07928691], [0.0, 0.04511338, 1.04394437]],
}
LINEAR_FROM_XYZ = {
    "srgb": [[3.2404542, -1.5371385, -0.4985314], [-0.9692660, 1.8760108, 0.0415560], [0.0556434, -0.2040259, 1.0572252]],
    "display-p3": [[2.49349691, -0.93138362, -0.40271078], [-0.82948897, 1.76266406, 0.02362469], [0.03584583, -0.07617239, 0.95688452]],
}
LMS_FROM_XYZ = [[0.8189330101, 0.3618667424, -0.1288597137], [0.0329845436, 0.9293118715, 0.0361456387], [0.0482003018, 0.2643662691, 0.6338517070]]
XYZ_FROM_LMS = [[1.2270138511, -0.5577999807, 0.2812561490], [-0.0405801784, 1.1122568696, -0.0716766787], [-0.0763812845, -0.4214819784, 1.5861632204]]
LAB_FROM_LMS = [[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]]
LMS_FROM_LAB = [[1.0, 0.3963377774, 0.2158037573], [1.0, -0.1055613458, -0.0638541728], [1.0, -0.0894841775, -1.2914855480]]
WHITE = (0.95047, 1.0, 1.08883)
LUMINANCE = {"srgb": (0.2126, 0.7152, 0.0722), "display-p3": (0.2289746, 0.6917385, 0.0792869)}


def profile_of(name: str) -> str:
    if name not in XYZ_FROM_LINEAR:
        raise ValueError(f"no colour profile {name!r}; known: {sorted(XYZ_FROM_LINEAR)}")
    return name


def product(*matrices) -> list[list[float]]:
    out = np.array(matrices[0])
    for m in matrices[1:]:
        out = out @ np.array(m)
    return out.tolist()


#: One 3x3 from linear light to cone responses, and back.
LMS_FROM_LINEAR = {p: product(LMS_FROM_XYZ, m) for p, m in XYZ_FROM_LINEAR.items()}
LINEAR_FROM_LMS = {p: product(m, XYZ_FROM_LMS) for p, m in LINEAR_FROM_XYZ.items()}


def combined(row, *columns: Column) -> Column:
    out = columns[0] * row[0]
    for factor, c in zip(row[1:], columns[1:]):
        out = out + c * factor
    return out


def apart(v: Column) -> Column:
    """v itself, at the end of a run of columns. Spark compiles a run into one method, and the JVM leaves a method beyond
    8,000 bytes interpreted, some twenty times slower; it does not compile a lambda, so what follows is a method of its own."""
    return F.transform(F.array(v), lambda x: x)[0]


def decode(v: Column) -> Column:
    """Encoded value (0..1) to linear light, IEC 61966-2-1."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))


def encode(v: Column) -> Column:
    """Linear light, clamped to 0..1, to an encoded value."""
    c = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, 1 / 2.4) * 1.055 - 0.055)


#: BT.709 with the exact constants of its join, so that grey does not turn back at the knee.
ALPHA_709, BETA_709 = 1.09929682680944, 0.018053968510807


def encode_709(v: Column) -> Column:
    return F.when(v < BETA_709, v * 4.5).otherwise(F.pow(v, 0.45) * ALPHA_709 - (ALPHA_709 - 1))


def decode_709(v: Column) -> Column:
    return F.when(v < BETA_709 * 4.5, v / 4.5).otherwise(F.pow((v + (ALPHA_709 - 1)) / ALPHA_709, 1 / 0.45))


def with_linear(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", out: str = "lin_") -> DataFrame:
    return df.withColumns({out + k: decode(F.col(c) / 255.0) for k, c in (("r", r), ("g", g), ("b", b))})


def with_oklab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", out: str = "ok_", profile: str = "srgb") -> DataFrame:
    """Adds out + L, a, b of 8-bit channels."""
    m = LMS_FROM_LINEAR[profile_of(profile)]
    df = with_linear(df, r, g, b, "__lin_")
    lin = [F.col("__lin_" + k) for k in "rgb"]
    df = df.withColumns({f"__lms_{k}": F.cbrt(combined(m[k], *lin)) for k in range(3)})
    lms = [F.col(f"__lms_{k}") for k in range(3)]
    lab = {out + name: combined(row, *lms) for name, row in zip("Lab", LAB_FROM_LMS)}
    df = df.withColumns(lab | {out + "a": apart(lab[out + "a"])})
    return df.drop(*["__lin_" + k for k in "rgb"], *[f"__lms_{k}" for k in range(3)])


def with_linear_from_oklab(df: DataFrame, lab: str = "ok_", out: str = "lin_", profile: str = "srgb") -> DataFrame:
    m = LINEAR_FROM_LMS[profile_of(profile)]
    own = [F.col(lab + k) for k in "Lab"]
    df = df.withColumns({f"__lms_{k}": combined(row, *own) for k, row in enumerate(LMS_FROM_LAB)})
    cube = [F.col(f"__lms_{k}") * F.col(f"__lms_{k}") * F.col(f"__lms_{k}") for k in range(3)]
    return df.withColumns({out + k: combined(row, *cube) for k, row in zip("rgb", m)}).drop(*[f"__lms_{k}" for k in range(3)])


def to_8bit(linear: Column) -> Column:
    """Clamped and rounded half to even."""
    return F.least(F.greatest(F.rint(encode(linear) * 255), F.lit(0.0)), F.lit(255.0)).cast("int")


def outside_gamut(*linear: Column) -> Column:
    out = F.lit(False)
    for c in linear:
        out = out | (c < -0.001) | (c > 1.001)
    return out


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def hue(a: Column, b: Column) -> Column:
    angle = F.degrees(F.atan2(b, a))
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def delta_e_ok(first: str, second: str) -> Column:
    return F.sqrt(sum((F.pow(F.col(first + k) - F.col(second + k), 2) for k in "Lab"), F.lit(0.0)))


def hue_distance(a: Column, b: Column) -> Column:
    gap = F.abs(a - b) % 360.0
    return F.least(gap, F.lit(360.0) - gap)


def hex_code(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def css_oklch(lightness: Column, c: Column, h: Column) -> Column:
    """CSS Color 4; colours without chroma have hue none."""
    return F.when(c < 0.002, F.format_string("oklch(%.1f%% 0 none)", lightness * 100)).otherwise(F.format_string("oklch(%.1f%% %.4f %.1f)", lightness * 100, c, h))


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", out: str = "lab_", profile: str = "srgb") -> DataFrame:
    """Adds CIELAB (D65) out + L, a, b of 8-bit channels."""
    df = with_linear(df, r, g, b, "__lin_")
    lin = [F.col("__lin_" + k) for k in "rgb"]
    xyz = {f"__t_{k}": combined(row, *lin) / white for k, (row, white) in enumerate(zip(XYZ_FROM_LINEAR[profile_of(profile)], WHITE))}
    df = df.withColumns(xyz)
    df = df.withColumns({f"__f_{k}": F.when(F.col(t) > 216 / 24389, F.pow(F.col(t), 1 / 3)).otherwise(F.col(t) * (841 / 108) + 4 / 29) for k, t in enumerate(xyz)})
    fx, fy, fz = (F.col(f"__f_{k}") for k in range(3))
    df = df.withColumns({out + "L": fy * 116 - 16, out + "a": apart((fx - fy) * 500), out + "b": (fy - fz) * 200})
    return df.drop(*["__lin_" + k for k in "rgb"], *xyz, *[f"__f_{k}" for k in range(3)])


def with_ciede2000(df: DataFrame, first: str, second: str, out: str = "de00") -> DataFrame:
    """Adds the CIEDE2000 difference of two CIELAB colours, by the published formula."""
    c = F.col
    df = df.withColumns({"__c1": F.hypot(c(first + "a"), c(first + "b")), "__c2": F.hypot(c(second + "a"), c(second + "b"))})
    df = df.withColumn("__m7", F.pow((c("__c1") + c("__c2")) / 2, 7))
    df = df.withColumn("__g", F.lit(1.5) - F.sqrt(c("__m7") / (c("__m7") + 25.0**7)) * 0.5)
    df = df.withColumns({"__a1": apart(c(first + "a") * c("__g")), "__a2": c(second + "a") * c("__g")})
    df = df.withColumns({"__c1": F.hypot(c("__a1"), c(first + "b")), "__c2": F.hypot(c("__a2"), c(second + "b"))})
    df = df.withColumns({"__h1": hue(c("__a1"), c(first + "b")), "__h2": hue(c("__a2"), c(second + "b"))})
    flat = c("__c1") * c("__c2") == 0
    gap = c("__h2") - c("__h1")
    turn = F.when(flat, 0.0).when(F.abs(gap) <= 180, gap).when(gap > 180, gap - 360).otherwise(gap + 360)
    both = c("__h1") + c("__h2")
    mean = F.when(flat, both).when(F.abs(gap) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2)
    df = df.withColumns({"__dh": F.sqrt(c("__c1") * c("__c2")) * F.sin(F.radians(turn) / 2) * 2, "__mh": mean, "__mc": (c("__c1") + c("__c2")) / 2, "__ml": (c(first + "L") + c(second + "L")) / 2})
    cos = lambda times, shift: F.cos(F.radians(c("__mh") * times + shift))
    t = F.lit(1.0) - cos(1, -30) * 0.17 + cos(2, 0) * 0.24 + cos(3, 6) * 0.32 - cos(4, -63) * 0.2
    off = F.pow(c("__ml") - 50, 2)
    m7 = F.pow(c("__mc"), 7)
    twist = F.exp(-F.pow((c("__mh") - 275) / 25, 2)) * 60
    df = df.withColumns({
        "__l": (c(second + "L") - c(first + "L")) / (off * 0.015 / F.sqrt(off + 20) + 1), "__c": (c("__c2") - c("__c1")) / (c("__mc") * 0.045 + 1),
        "__h": c("__dh") / (c("__mc") * 0.015 * t + 1), "__r": -F.sin(F.radians(twist)) * F.sqrt(m7 / (m7 + 25.0**7)) * 2,
    })
    total = c("__l") * c("__l") + c("__c") * c("__c") + c("__h") * c("__h") + c("__r") * c("__c") * c("__h")
    df = df.withColumn(out, F.sqrt(total))
    return df.drop("__c1", "__c2", "__m7", "__g", "__a1", "__a2", "__h1", "__h2", "__dh", "__mh", "__mc", "__ml", "__l", "__c", "__h", "__r")


#: Below this CIELAB chroma an angle says nothing.
LEAST_CHROMA = 15.0


def hue_angle_error(first: str, second: str) -> Column:
    a1, b1, a2, b2 = F.col(first + "a"), F.col(first + "b"), F.col(second + "a"), F.col(second + "b")
    weak = (F.hypot(a1, b1) < LEAST_CHROMA) | (F.hypot(a2, b2) < LEAST_CHROMA)
    return F.when(weak, 0.0).otherwise(hue_distance(hue(a1, b1), hue(a2, b2)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 luma of encoded 8-bit channels, 0..1."""
    return (r * 0.2126 + g * 0.7152 + b * 0.0722) / 255.0


def span(r: Column, g: Column, b: Column) -> Column:
    """RGB span, 0..1: not to be mixed with OKLab chroma."""
    return (F.greatest(r, g, b) - F.least(r, g, b)) / 255.0


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Hue in degrees and saturation."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (high - low).cast("double")
    turn = F.when(d == 0, 0.0).when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return turn * 60, F.when(high == 0, 0.0).otherwise(d / high)


def smoothstep(v: Column, low: float, high: float) -> Column:
    t = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (F.lit(3.0) - t * 2)


def lightness_from_grey(y: Column) -> Column:
    """CIE L* of relative luminance."""
    return F.when(y > 216 / 24389, F.cbrt(y) * 116 - 16).otherwise(y * (24389 / 27))


def grey_from_lightness(v: Column) -> Column:
    return F.when(v > 8, F.pow((v + 16) / 116, 3)).otherwise(v * (27 / 24389))


def equal_luma_matrix(saturation: float) -> list[list[float]]:
    """Saturation as a 3x3 whose rows sum to one, so neutrals stay exactly neutral."""
    weights = LUMINANCE["srgb"]
    return [[w * (1 - saturation) + (saturation if k == j else 0.0) for j, w in enumerate(weights)] for k in range(3)]


def pchip(points: list[tuple[float, float]]):
    """Monotone cubic through points (Fritsch-Carlson weighted harmonic means; one-sided ends, limited):
    a list of (x0, x1, c0, c1, c2, c3), cubic in x - x0. The coefficients are worked out once here."""
    x, y = [p[0] for p in points], [p[1] for p in points]
    n = len(x)
    h = [b - a for a, b in zip(x, x[1:])]
    d = [(b - a) / s for a, b, s in zip(y, y[1:], h)]
    if n == 2:
        m = [d[0], d[0]]
    else:
        m = [0.0] * n
        for k in range(1, n - 1):
            if d[k - 1] * d[k] > 0:
                w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])
        for end, near, far in ((0, 0, 1), (n - 1, n - 2, n - 3)):
            slope = ((2 * h[near] + h[far]) * d[near] - h[near] * d[far]) / (h[near] + h[far])
            if slope * d[near] <= 0:
                slope = 0.0
            elif d[near] * d[far] <= 0 and abs(slope) > 3 * abs(d[near]):
                slope = 3 * d[near]
            m[end] = slope
    return [(x[k], x[k + 1], y[k], m[k], (3 * d[k] - 2 * m[k] - m[k + 1]) / h[k], (m[k] + m[k + 1] - 2 * d[k]) / (h[k] * h[k])) for k in range(n - 1)]


def curve(v: Column, points: list[tuple[float, float]]) -> Column:
    """A tone curve as a cascade of cubics; v is clamped to the curve's ends."""
    out = None
    pieces = pchip(points)
    v = F.least(F.greatest(v, F.lit(points[0][0])), F.lit(points[-1][0]))
    for x0, x1, c0, c1, c2, c3 in pieces:
        t = v - x0
        piece = ((t * c3 + c2) * t + c1) * t + c0
        out = F.when(v <= x1, piece) if out is None else out.when(v <= x1, piece)
    return F.least(F.greatest(out.otherwise(points[-1][1]), F.lit(0.0)), F.lit(1.0))


def ramp_weight(lightness: Column, mid_gain: float, highlight_ratio: float = 0.6) -> Column:
    """Saturation gain that never grows with lightness: full up to one half, then falling."""
    return F.when(lightness <= 0.5, mid_gain).otherwise((F.lit(1.0) - (lightness - 0.5) / 0.5 * (1 - highlight_ratio)) * mid_gain)


def pivot_slope(v: Column, slope: float, pivot: float) -> Column:
    return v * slope + pivot * (1.0 - slope)


def soft_toe(v: Column, toe: float) -> Column:
    """x * x / (x + t): softens black without adding light; t is held within 0.02 to 0.08."""
    toe = min(0.08, max(0.02, toe))
    return F.when(v <= 0, 0.0).otherwise(v * v / (v + toe))


def compressed_chroma(c: Column, amount: float, start: float) -> Column:
    over = c - start
    return F.when(c <= start, c).otherwise(over / (over * (amount / max(1e-6, start)) + 1.0) + start)


def halation(v: Column, threshold: float, gamma: float = 1.5, channel: str = "r") -> Column:
    return F.when(v <= threshold, 0.0).otherwise(F.pow(v - threshold, gamma) * {"r": 1.0, "g": 0.35, "b": 0.15}[channel])


def grain(lightness: Column, peak: float) -> Column:
    """Grain's amplitude: weak in deep shadow, full to one half, a fifth in the highlights."""
    return (F.when(lightness <= 0.15, lightness / 0.15 * (0.7 * peak) + 0.3 * peak).when(lightness <= 0.5, peak)
            .when(lightness >= 0.85, 0.2 * peak).otherwise((F.lit(1.0) - (lightness - 0.5) / 0.35 * 0.8) * peak))


def shadow_slope(points: list[tuple[float, float]], at: float = 0.05, delta: float = 0.01) -> float:
    """Local slope of a tone curve in the shadows; worked out on the driver, a curve is a parameter."""
    def value(x: float) -> float:
        for x0, x1, c0, c1, c2, c3 in pchip(points):
            if x <= x1:
                t = x - x0
                return ((t * c3 + c2) * t + c1) * t + c0
        return points[-1][1]

    return (value(at + delta) - value(max(0.0, at - delta))) / (2 * delta) if delta else math.nan
