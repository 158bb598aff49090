"""Seven synthetic images to compare conversions on; a pixel is a function of its place, its grain of a counter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Widths and heights of the images.
SIZES = {
    "photo-portrait": (96, 128),
    "photo-landscape": (128, 96),
    "flat-illustration": (96, 96),
    "pixel-art": (128, 128),
    "alpha": (96, 96),
    "high-contrast": (96, 96),
    "gradient": (128, 64),
}
#: Seeds of the grain, and the step of its counter.
SEEDS = {"photo-portrait": 0x504F5254, "photo-landscape": 0x4C414E44}
STEP = 0x6D2B79F5
LOW = 0xFFFFFFFF
#: Share of a landscape above the horizon; colours of the flat and of the enlarged image.
SKY = 0.55
FLAT = [(242, 240, 232), (34, 44, 64), (220, 78, 66), (246, 190, 62), (64, 148, 132)]
SPRITE = [(0, 0, 0, 0), (24, 20, 37, 255), (229, 179, 107, 255), (176, 48, 60, 255), (72, 120, 168, 255), (255, 255, 255, 255)]


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers below 2**32, within signed 64 bits."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)) * b, (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(LOW))


def draw(seed: int, n: Column) -> Column:
    """The n-th number, from 0, of the stream of a seed (mulberry32), in [0, 1)."""
    state = (F.lit(seed).cast("long") + (n.cast("long") + 1) * F.lit(STEP)).bitwiseAND(F.lit(LOW))
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  names x, so that it is computed once
    a = lambda t: _times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1)))
    b = lambda t: t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(LOW)))
    return once(once(once(state, a), b), lambda t: t.bitwiseXOR(F.shiftright(t, 14))) / F.lit(2.0**32)


def _chosen(index: Column, colors: list[tuple[int, ...]]) -> tuple[Column, ...]:
    return tuple(F.element_at(F.array(*(F.lit(c[k]) for c in colors)), index + 1) for k in range(len(colors[0])))


def _portrait(x: Column, y: Column, w: int, h: int) -> tuple:
    du, dv = x / w - 0.5, y / h - 0.42
    shade = 0.35 + 0.65 * F.pow(F.greatest(F.lit(0.0), 1 - F.sqrt(du * du * 1.8 + dv * dv) * 2.4), F.lit(0.7))
    grain = (draw(SEEDS["photo-portrait"], y * w + x) - 0.5) * 14
    return tuple(c * shade + grain + d * (1 - shade) for c, d in ((228, 18), (176, 26), (150, 44))) + (F.lit(255),)


def _landscape(x: Column, y: Column, w: int, h: int) -> tuple:
    edge = int(h * SKY)
    du, dv = x / w - 0.72, y / edge - 0.25
    sun, up, down = F.greatest(F.lit(0.0), 1 - F.sqrt(du * du + dv * dv) * 3.2), y / edge, (y - edge) / (h - edge)
    grain = (draw(SEEDS["photo-landscape"], F.greatest(y - edge, F.lit(0)) * w + x) - 0.5) * 34
    sky, ground = ((60, 150, 190), (110, 110, 160), (200, -30, 90)), ((70, 60), (95, 70), (48, 30))
    return tuple(F.when(y < edge, s[0] + s[1] * up + s[2] * sun).otherwise(g[0] + g[1] * down + grain) for s, g in zip(sky, ground, strict=True)) + (F.lit(255),)


def _flat(x: Column, y: Column, w: int, h: int) -> tuple:
    u, v = x / w, y / h
    disc = F.sqrt((u - 0.38) * (u - 0.38) + (v - 0.4) * (v - 0.4)) < 0.26
    return _chosen(F.when(disc, 2).when(u + v > 1.35, 4).when(v > 0.72, 1).when((u > 0.7) & (v < 0.3), 3).otherwise(0), FLAT) + (F.lit(255),)


def _enlarged(x: Column, y: Column, w: int, h: int) -> tuple:
    x, y = F.floor(x / (w // 16)), F.floor(y / (w // 16))
    head, edge = x.between(3, 12) & y.between(2, 11), x.isin(3, 12) | y.isin(2, 11)
    parts = F.when(head & (y == 3) & x.between(5, 10), 5).when(~head & (y >= 12) & x.between(4, 11), 4).when(head & (y == 9) & x.between(6, 9), 3)
    return _chosen(parts.when(head & (edge | (y.isin(5, 6) & x.isin(6, 9))), 1).when(head, 2).otherwise(0).cast("int"), SPRITE)


def _soft(x: Column, y: Column, w: int, h: int) -> tuple:
    du, dv = x / w - 0.5, y / h - 0.5
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.36 - F.sqrt(du * du + dv * dv)) / 0.08)) * 255
    return tuple(F.when(a > 0, F.lit(c)).otherwise(F.lit(d)) for c, d in ((245, 0), (120, 255), (40, 0))) + (a,)


def _contrast(x: Column, y: Column, w: int, h: int) -> tuple:
    on = F.when(y > h * 0.7, F.floor(x / 2) % 2 == 0).otherwise((F.floor(x / 3) + F.floor(y / 3)) % 2 == 0)
    return (F.when(on, 255).otherwise(0),) * 3 + (F.lit(255),)


def _ramp(x: Column, y: Column, w: int, h: int) -> tuple:
    u, v = x / (w - 1), y / (h - 1)
    return 255 * u, 255 * v, 255 * (1 - u * v), F.lit(255)


RULES = dict(zip(SIZES, (_portrait, _landscape, _flat, _enlarged, _soft, _contrast, _ramp), strict=True))


def generated(spark: SparkSession, name: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """One image, at its own size or another: image, y, x, r, g, b, a."""
    w, h = width or SIZES[name][0], height or SIZES[name][1]
    at = spark.range(w * h).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    byte = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(v.cast("double") + 0.5).cast("double"))).cast("int")
    return at.select(F.lit(name).alias("image"), "y", "x", *(byte(v).alias(c) for v, c in zip(RULES[name](F.col("x"), F.col("y"), w, h), "rgba", strict=True)))


def all_generated(spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.union, (generated(spark, n) for n in SIZES))
