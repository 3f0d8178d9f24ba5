"""Pieces of DuckDB SQL for the oracles, written from the formulas and not from the column code."""

from __future__ import annotations

from tintmill.functions import colour


def num(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def dot(row, *names: str) -> str:
    return "(" + " + ".join(f"{num(f)} * {n}" for f, n in zip(row, names)) + ")"


def decode(c: str) -> str:
    return f"CASE WHEN {c} / 255e0 <= 4.045e-2 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 5.5e-2) / 1.055e0, 2.4e0) END"


def linear(source: str, out: str = "lin") -> str:
    return f"{out} AS (SELECT *, {', '.join(f'{decode(c)} AS l{c}' for c in 'rgb')} FROM {source})"


def oklab(source: str = "px", out: str = "lab", profile: str = "srgb") -> str:
    """CTEs from source (r, g, b) to out, which adds lr, lg, lb and okl, oka, okb."""
    m = colour.LMS_FROM_LINEAR[profile]
    cone = ", ".join(f"cbrt({dot(m[k], 'lr', 'lg', 'lb')}) AS c{k}" for k in range(3))
    axes = ", ".join(f"{dot(row, 'c0', 'c1', 'c2')} AS ok{n}" for n, row in zip("lab", colour.LAB_FROM_LMS))
    return f"{linear(source, out + '_lin')}, {out}_lms AS (SELECT *, {cone} FROM {out}_lin), {out} AS (SELECT *, {axes} FROM {out}_lms)"


def hypot(a: str, b: str) -> str:
    return f"sqrt({a} * {a} + {b} * {b})"


def hue(a: str, b: str) -> str:
    return f"CASE WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"


def cielab(r: str, g: str, b: str, out: str) -> str:
    """Columns out_f0.. of X, Y, Z over white, from linear names."""
    xyz = [f"{dot(row, r, g, b)} / {num(w)}" for row, w in zip(colour.XYZ_FROM_LINEAR["srgb"], colour.WHITE)]
    return ", ".join(f"CASE WHEN {t} > 216e0 / 24389 THEN pow({t}, 1e0 / 3) ELSE 841e0 / 108 * {t} + 4e0 / 29 END AS {out}_f{k}" for k, t in enumerate(xyz))


def encode(v: str) -> str:
    c = f"least(greatest({v}, 0e0), 1e0)"
    return f"CASE WHEN {c} <= 3.1308e-3 THEN {c} * 12.92e0 ELSE pow({c}, 1e0 / 2.4e0) * 1.055e0 - 5.5e-2 END"


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(({r}) * 2.126e-1 + ({g}) * 7.152e-1 + ({b}) * 7.22e-2) / 255e0"


def quantile(v: str, p: float) -> str:
    return f"quantile_cont({v}, {p})"


def cases(v: str, steps, otherwise: str | None = None, op: str = "<") -> str:
    out = " ".join(f"WHEN {v} {op} {num(float(b))} THEN '{n}'" for b, n in steps)
    return f"CASE {out} " + (f"ELSE '{otherwise}' " if otherwise else "") + "END"
