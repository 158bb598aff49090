"""Pieces of DuckDB SQL that the oracles share."""

from rasterloom.functions import color as C
from rasterloom.operators.raster import lab_of
from rasterloom.sources.palettes import colors
from rasterloom.sources.rasters import PIXELS  # noqa: F401


def lin(e: str) -> str:
    return f"(CASE WHEN {e} <= 0.04045 THEN ({e}) / 12.92 ELSE pow((({e}) + 0.055) / 1.055, 2.4) END)"


def enc(e: str) -> str:
    return f"(CASE WHEN {e} <= 0.0031308 THEN ({e}) * 12.92 ELSE 1.055 * pow({e}, 1 / 2.4) - 0.055 END)"


def row(m: tuple, v: tuple) -> str:
    return "(" + " + ".join(f"({k!r}::DOUBLE) * {x}" for k, x in zip(m, v)) + ")"


def labs(source: str, name: str = "lab") -> str:
    """CTEs that add l, p, q (Oklab) to a relation with r, g, b."""
    return f"""{name}_1 AS (SELECT *, {lin("r / 255.0::DOUBLE")} lr, {lin("g / 255.0::DOUBLE")} lg, {lin("b / 255.0::DOUBLE")} lb FROM {source}),
{name}_2 AS (SELECT *, {", ".join(f"cbrt({row(m, ('lr', 'lg', 'lb'))}) c{i}" for i, m in enumerate(C.TO_LMS))} FROM {name}_1),
{name} AS (SELECT *, {", ".join(f"{row(m, ('c0', 'c1', 'c2'))} {n}" for n, m in zip("lpq", C.TO_LAB))} FROM {name}_2)"""


def unlab(l: str, p: str, q: str) -> list[str]:
    """8-bit channels of Oklab expressions."""
    cubes = [f"pow({row(m, (l, p, q))}, 3)" for m in C.FROM_LAB]
    return [f"floor({enc(f'least(1.0::DOUBLE, greatest(0.0::DOUBLE, {row(m, tuple(cubes))}))')} * 255 + 0.5)::INT" for m in C.FROM_LMS]


def nearest(source: str, palette: str, name: str = "near") -> str:
    """CTEs that add idx, the nearest entry of a palette, to a relation with l, p, q: the fold written out."""
    pal = [lab_of(c) for c in colors(palette)]
    d = [f"(l - {a!r}::DOUBLE) * (l - {a!r}::DOUBLE) + (p - {b!r}::DOUBLE) * (p - {b!r}::DOUBLE) + (q - {c!r}::DOUBLE) * (q - {c!r}::DOUBLE)" for a, b, c in pal]
    out = [f"{name}_d AS (SELECT *, {', '.join(f'{x} d{i}' for i, x in enumerate(d))} FROM {source})", f"{name}_0 AS (SELECT *, d0 m, 0 i FROM {name}_d)"]
    for k in range(1, len(pal)):
        out.append(f"{name}_{k} AS (SELECT * REPLACE (CASE WHEN d{k} < m - 1e-9 THEN d{k} ELSE m END AS m, CASE WHEN d{k} < m - 1e-9 THEN {k} ELSE i END AS i) FROM {name}_{k - 1})")
    out.append(f"{name} AS (SELECT *, CASE WHEN a < 128 THEN 65535 ELSE i END::INT idx FROM {name}_{len(pal) - 1})")
    return ",\n".join(out)


def cells(dst: int, src: int, c: str) -> str:
    """Condition that a source coordinate lies in the target cell t."""
    return f"({c} >= (t * {src}) // {dst} AND {c} < greatest((t * {src}) // {dst} + 1, ((t + 1) * {src}) // {dst}))"
