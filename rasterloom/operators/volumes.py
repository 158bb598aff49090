"""Colour cubes as relations: moments of 5-bit cells, summed volumes, and boxes measured without their pixels.

A summed volume holds, at every corner of the cube, the moments of all cells below it in
all three axes. It is made by three windows, one an axis, over the planes in which a cell
occurs; a box's moments are then eight look-ups with alternating signs, so the weighted
variance of any box costs the same, whatever it holds.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 32
MOMENTS = ("w", "sr", "sg", "sb", "m2")
_AXES = ("ri", "gi", "bi")


def color_cells(px: DataFrame, threshold: int = 128) -> DataFrame:
    """image_id, ri, gi, bi (5 bits each) with the weight, the channels' sums and the sum of squares of the pixels not below the threshold."""
    five = [F.shiftright(c, 3).cast("int").alias(f"{c}i") for c in "rgb"]
    g = px.where(F.col("a") >= threshold).groupBy("image_id", *five)
    return g.agg(F.count(F.lit(1)).alias("w"), *(F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in "rgb"), F.sum((F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b")).cast("long")).alias("m2"))


def summed_volume(cells: DataFrame) -> DataFrame:
    """cells -> the same moments summed over all cells not above in any axis, at every place of the cube of an image that has pixels.

    Before an axis is summed, rows are made for its 32 places, so that a sum is there for later axes.
    """
    out = cells
    for axis in reversed(_AXES):
        others = ["image_id", *(a for a in _AXES if a != axis)]
        held = F.map_from_entries(F.collect_list(F.struct(axis, F.struct(*MOMENTS))))
        line = out.groupBy(others).agg(held.alias("_at")).select(*others, "_at", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias(axis))
        along = Window.partitionBy(*others).orderBy(axis)
        here = F.try_element_at("_at", F.col(axis))
        out = line.select(*others, axis, *(F.sum(F.coalesce(here[m], F.lit(0))).over(along).cast("long").alias(m) for m in MOMENTS))
    return out.select("image_id", *_AXES, *MOMENTS)


def box_moments(boxes: DataFrame, volume: DataFrame) -> DataFrame:
    """boxes (image_id, box_id, r0, r1, g0, g1, b0, b1; the lower edges are outside, -1 at the least) with the moments of what they hold.

    Eight corners a box by inclusion and exclusion; a corner outside the cube counts nothing.
    """
    corners = []
    for high in itertools.product((1, 0), repeat=3):
        sign = (-1) ** (3 - sum(high))
        corners.append(F.struct(*(F.col(f"{a[0]}{h}").alias(a) for a, h in zip(_AXES, high, strict=True)), F.lit(sign).alias("_sign")))
    asked = boxes.select("image_id", "box_id", F.inline(F.array(*corners))).where("ri >= 0 AND gi >= 0 AND bi >= 0")
    found = asked.join(volume, ["image_id", *_AXES]).groupBy("image_id", "box_id").agg(*(F.sum(F.col("_sign") * F.col(m)).alias(m) for m in MOMENTS))
    return boxes.join(found, ["image_id", "box_id"], "left").fillna(0, list(MOMENTS))


def variance(w: Column, sums: tuple[Column, Column, Column], m2: Column) -> Column:
    """Weighted variance of a box by its moments; of an empty one 0."""
    squares = reduce(lambda x, y: x + y, (s.cast("double") * s.cast("double") for s in sums))
    return F.when(w > 0, m2.cast("double") - F.try_divide(squares, w.cast("double"))).otherwise(0.0)


def box_volume() -> Column:
    """Cells of a box by its edges."""
    return reduce(lambda x, y: x * y, (F.col(f"{c}1") - F.col(f"{c}0") for c in "rgb"))
