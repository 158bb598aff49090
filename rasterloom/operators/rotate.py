"""Rotation by nine samples: every pixel shows a colour of the source, and edges are sharpened by its neighbours.

Each source pixel is seen as 3 x 3 parts. A part takes a neighbour's colour where two sides that
meet at it are alike and neither continues; the others have the pixel's own. A target takes
the part under the first of its nine sample points that falls into the image when
turned back, and is empty if none does. What part a target takes depends on its place alone, so the
way from sources to targets is a small table, and the images are shuffled once, to see neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import similar
from rasterloom.operators.kernels import clean_edge

#: Fixed value: angles this near to a quarter turn are taken for it.
NEAR = 1e-6
#: Number of the part that a target takes if nothing falls into the image: the empty one.
EMPTY = 9
#: Targets up to which the way is broadcast (about 40 MB); larger canvases are joined by a shuffle.
BROADCAST_PLACES = 1_000_000


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def _turned(w: int, h: int, angle: float, pivot_x: float, pivot_y: float) -> Column:
    """The first sample of a place that falls into the image of 3 w x 3 h parts, or null."""
    spots = []
    for k in range(9):
        du, dv = 3 * (F.col("x") - pivot_x) + (k % 3 - 1), 3 * (F.col("y") - pivot_y) + (k // 3 - 1)
        to, far = F.atan2(dv, du) + angle, F.sqrt(du * du + dv * dv)
        # fixed rule: on canvases of odd width both coordinates are one more
        spots.append(F.struct((_rounded(pivot_x * 3 + 1 + far * F.cos(to)) + w % 2).alias("x"), (_rounded(pivot_y * 3 + 1 + far * F.sin(to)) + w % 2).alias("y")))
    return F.get(F.filter(F.array(*spots), lambda s: s["x"].between(0, 3 * w - 1) & s["y"].between(0, 3 * h - 1)), F.lit(0))


def way(spark: SparkSession, w: int, h: int, angle: float, pivot_x: float | None = None, pivot_y: float | None = None) -> DataFrame:
    """Of each target the source and its part: to_y, to_x, y, x, part. Quarter turns are exact, about the middle."""
    at = spark.range(w * h).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    x, y, quarters = F.col("x"), F.col("y"), angle / (math.pi / 2)
    if abs(angle - round(quarters) * math.pi / 2) < NEAR:
        sx, sy = [(x, y), (_rounded((w + h - 2 - 2 * y) / 2), _rounded((h - w + 2 * x) / 2)), (w - 1 - x, h - 1 - y), (_rounded((w - h + 2 * y) / 2), _rounded((h + w - 2 - 2 * x) / 2))][round(quarters) % 4]
        ends = at.select(y.alias("to_y"), x.alias("to_x"), sy.alias("y"), sx.alias("x"), F.lit(4).alias("part"))
        ends = ends.withColumn("part", F.when(x.between(0, w - 1) & y.between(0, h - 1), F.col("part")).otherwise(EMPTY))
    else:
        spot = at.withColumn("s", _turned(w, h, angle, w / 2 if pivot_x is None else pivot_x, h / 2 if pivot_y is None else pivot_y))
        found = spot.select(y.alias("to_y"), x.alias("to_x"), _rounded((F.col("s.y") - 1) / 3).alias("y"), _rounded((F.col("s.x") - 1) / 3).alias("x"), (F.col("s.x") % 3 + F.col("s.y") % 3 * 3).alias("part"))
        rim = x.isin(0, w - 1) | y.isin(0, h - 1)
        ends = found.withColumn("part", F.when(x.isNull(), EMPTY).when(rim, 4).otherwise(F.col("part")))
    lost = F.col("part") == EMPTY
    return ends.withColumns({"y": F.when(lost, 0).otherwise(y), "x": F.when(lost, 0).otherwise(x)})  # the first pixel stands for nothing


def parts(px: DataFrame, w: int) -> DataFrame:
    """image_id, y, x and the colours of the nine parts and of nothing, as an array; images list all their pixels."""
    along, none = Window.partitionBy("image_id").orderBy("y", "x"), F.struct(*(F.lit(0).alias(c) for c in "rgba"))
    px = px.withColumn("e", F.struct(*(F.col(c).cast("int").alias(c) for c in "rgba")))
    near = {"a": w + 1, "b": w, "c": w - 1, "d": 1, "f": -1, "g": 1 - w, "h": -w, "i": -1 - w}
    px = px.select("image_id", "y", "x", "e", *(F.coalesce(F.lag("e", n).over(along), none).alias(f"_{k}") for k, n in near.items()))
    side = {k: F.col(f"_{k}") for k in near} | {"e": F.col("e")}

    def like(p: str, q: str) -> Column:
        p, q = side[p], side[q]
        return similar(p, q)

    px = px.withColumns({f"_{p}{q}": like(p, q) for p, q in ("db", "bf", "fh", "dh", "ea", "ec", "eg", "ei")})
    s = lambda name: F.col(f"_{name}")
    # at a corner its two sides are alike, and neither is like the side across from the other
    px = px.withColumns({"_1": s("db") & ~s("dh") & ~s("bf"), "_2": s("bf") & ~s("db") & ~s("fh"), "_3": s("dh") & ~s("fh") & ~s("db"), "_4": s("fh") & ~s("bf") & ~s("dh")})

    def corner(n: int, of: str) -> Column:
        return F.when(s(n), side[of]).otherwise(F.col("e"))

    def edge(of: str, one: int, beyond_one: str, other: int, beyond_other: str) -> Column:
        """A side's colour if one of its corners holds and the pixel is not like the diagonal at its other corner."""
        return F.when((s(one) & ~s(f"e{beyond_one}")) | (s(other) & ~s(f"e{beyond_other}")), side[of]).otherwise(F.col("e"))

    nine = [corner(1, "d"), edge("b", 1, "c", 2, "a"), corner(2, "f"), edge("d", 3, "a", 1, "g"), F.col("e"), edge("f", 2, "i", 4, "c"), corner(3, "d"), edge("h", 4, "g", 3, "i"), corner(4, "f")]
    return px.select("image_id", "y", "x", F.array(*nine, none).alias("parts"))


def rotate(px: DataFrame, width: int, height: int, angle: float, pivot_x: float | None = None, pivot_y: float | None = None) -> DataFrame:
    """Images (image_id, y, x, r, g, b, a) of one size turned by an angle about a pivot, else the middle; the canvas keeps its size.

    Sources that an image does not list leave their targets out. An empty table gives no rows.
    """
    ends = way(px.sparkSession, width, height, angle, pivot_x, pivot_y)
    ends = F.broadcast(ends) if width * height <= BROADCAST_PLACES else ends
    out = parts(px, width).join(ends, ["y", "x"])
    return out.select("image_id", F.col("to_y").alias("y"), F.col("to_x").alias("x"), F.get("parts", F.col("part")).alias("p")).select("image_id", "y", "x", "p.r", "p.g", "p.b", "p.a")


def transformed(px: DataFrame, width: int, height: int, bounds: tuple[int, int, int, int] | None, degrees: float, percent: float = 100.0, method: str = "nine") -> DataFrame:
    """Images of one size with what lies in bounds (x, y, width, height; all if None) turned about its own middle; the rest stays.

    method "nine" only turns, "clean" scales too. Bounds are cut to the image; if nothing is left, images stay.
    """
    if method not in ("nine", "clean"):
        raise ValueError(f"no method {method!r}")
    x, y, w, h = bounds or (0, 0, width, height)
    left, top, right, bottom = max(x, 0), max(y, 0), min(x + w, width), min(y + h, height)
    names = ["image_id", "y", "x", "r", "g", "b", "a"]
    if left >= right or top >= bottom:
        return px.select(names)
    inside = F.col("x").between(left, right - 1) & F.col("y").between(top, bottom - 1)
    region = px.where(inside).select("image_id", (F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "r", "g", "b", "a")
    size, angle = (right - left, bottom - top), math.radians(degrees)
    out = rotate(region, *size, angle) if method == "nine" else clean_edge(region, *size, angle, max(0.01, percent / 100))
    return px.where(~inside).select(names).union(out.select("image_id", F.col("y") + top, F.col("x") + left, "r", "g", "b", "a"))
