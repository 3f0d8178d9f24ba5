"""Names for measured values: hue families, exposure classes, casts, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds and names as results show them.
HUE_FAMILIES = [(20, "红"), (55, "橙／肤色带"), (95, "黄"), (140, "黄绿"), (175, "绿"), (210, "青绿"), (250, "青蓝"), (285, "蓝"), (320, "紫"), (360, "洋红")]
EXPOSURE = {"deep": "严重欠曝", "dark": "偏暗", "high": "高调", "bright": "偏亮", "low": "低调", "usable": "曝光可用"}
NEUTRAL_CAST = "白平衡基本中性"
CAST_AXES = {"warm": "偏暖（黄／橙）", "cold": "偏冷（青／蓝）", "green": "偏绿", "magenta": "偏洋红"}
CAST_STRENGTHS = [(0.014, "轻微"), (0.028, "明显"), (9e9, "强烈")]
BLACK_POINT = {"real": "有真实黑位", "high": "黑位偏高，画面发灰", "soft": "黑位偏软"}
WHITE_POINT = {"room": "亮部有余量", "full": "亮部已接近上限"}
NOISE = [(0.004, "干净"), (0.009, "轻微噪点"), (9e9, "噪点明显")]

TONE_ROLES = {"shadow": "暗部", "highlight": "亮部", "mid": "中间调"}
ROWS = {"top": "上部", "bottom": "下部", "middle": "中部"}
SIDES = {"left": "偏左", "right": "偏右", "centre": "居中"}
HUE_TIERS = [(30.0, "类似色"), (60.0, "邻近色"), (90.0, "中差色"), (150.0, "对比色"), (360.0, "互补色")]


def first_below(v: Column, steps: list[tuple[float, str]], otherwise: str | None = None) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(v < bound, name) if out is None else out.when(v < bound, name)
    return out.otherwise(otherwise) if otherwise else out


def hue_family(hue: Column) -> Column:
    return first_below(hue, HUE_FAMILIES, HUE_FAMILIES[0][1])


def exposure_class(p05: Column, p50: Column, p95: Column) -> Column:
    return (F.when(p50 < 0.08, EXPOSURE["deep"]).when(p50 < 0.16, EXPOSURE["dark"]).when((p50 > 0.62) & (p05 > 0.22), EXPOSURE["high"])
            .when(p50 > 0.5, EXPOSURE["bright"]).when((p95 < 0.45) & (p50 < 0.25), EXPOSURE["low"]).otherwise(EXPOSURE["usable"]))


def cast_label(magnitude: Column, hue: Column) -> Column:
    axis = F.when(hue.between(20, 110), CAST_AXES["warm"]).when(hue.between(190, 300), CAST_AXES["cold"]).when((hue > 110) & (hue < 190), CAST_AXES["green"]).otherwise(CAST_AXES["magenta"])
    return F.when(magnitude < 0.006, NEUTRAL_CAST).otherwise(F.concat(first_below(magnitude, CAST_STRENGTHS), axis))


def black_point(p01: Column) -> Column:
    return F.when(p01 <= 0.012, BLACK_POINT["real"]).when(p01 > 0.04, BLACK_POINT["high"]).otherwise(BLACK_POINT["soft"])


def white_point(p99: Column) -> Column:
    return F.when(p99 < 0.93, WHITE_POINT["room"]).otherwise(WHITE_POINT["full"])


def noise_label(noise: Column) -> Column:
    return first_below(noise, NOISE)


def headroom_up(p50: Column) -> Column:
    return F.log2(F.greatest(F.lit(0.02), F.least(F.lit(0.62), p50 * 2.2)) / F.greatest(F.lit(0.005), p50))


def headroom_down(p50: Column) -> Column:
    return F.log2(F.greatest(F.lit(0.03), p50 * 0.55) / F.greatest(F.lit(0.005), p50))


def tone_role(lightness: Column) -> Column:
    return F.when(lightness < 0.35, TONE_ROLES["shadow"]).when(lightness > 0.70, TONE_ROLES["highlight"]).otherwise(TONE_ROLES["mid"])


def position_hint(x: Column, y: Column) -> Column:
    row = F.when(y < 0.34, ROWS["top"]).when(y > 0.66, ROWS["bottom"]).otherwise(ROWS["middle"])
    side = F.when(x < 0.38, SIDES["left"]).when(x > 0.62, SIDES["right"]).otherwise(SIDES["centre"])
    return F.concat(row, side)


def hue_tier(distance: Column) -> Column:
    out = None
    for bound, name in HUE_TIERS:
        out = F.when(distance <= bound, name) if out is None else out.when(distance <= bound, name)
    return out.otherwise(HUE_TIERS[-1][1])


def plausible_skin(lightness: Column, chroma: Column, hue: Column) -> Column:
    return lightness.between(0.40, 0.92) & chroma.between(0.020, 0.115) & hue.between(25.0, 85.0)


def skin_inside_a_face(lightness: Column, chroma: Column, hue: Column) -> Column:
    """A wider band, for pixels already known to lie in a face; never merged with the one above."""
    return lightness.between(0.08, 0.95) & (chroma >= 0.015) & hue.between(15.0, 80.0)
