"""Printable charts of index rasters: numbered cells, axis labels, gridlines and a legend.

Everything drawn is a rectangle of one colour on a level; a number is a rectangle for each lit part of
its digits. Rectangles are made by column arithmetic and dealt by chart; a task paints one chart
after the other, level by level, and gives the runs of one colour in each row of its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import with_oklab
from rasterloom.functions.views import label_interval

#: The digits 0 to 9 as five rows of three bits.
DIGITS = [
    (0b111, 0b101, 0b101, 0b101, 0b111),
    (0b010, 0b010, 0b010, 0b010, 0b010),
    (0b111, 0b001, 0b111, 0b100, 0b111),
    (0b111, 0b001, 0b111, 0b001, 0b111),
    (0b101, 0b101, 0b111, 0b001, 0b001),
    (0b111, 0b100, 0b111, 0b001, 0b111),
    (0b111, 0b100, 0b111, 0b101, 0b111),
    (0b111, 0b001, 0b001, 0b001, 0b001),
    (0b111, 0b101, 0b111, 0b101, 0b111),
    (0b111, 0b101, 0b111, 0b001, 0b111),
]
WIDE, HIGH = 3, 5
#: Cell sizes, inks, gridlines (every tenth is dark), and the lightness above which ink is black.
CELLS = (4, 200)
BLACK, WHITE, LIGHT, DARK = (0, 0, 0, 255), (255, 255, 255, 255), (200, 200, 200, 255), (70, 70, 70, 255)
BRIGHT = 0.6


def _color(c: tuple[int, ...]) -> Column:
    return F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "rgba", strict=True)))


def _rect(level: int, x: Column, y: Column, w: Column, h: Column, color: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), *(v.cast("int").alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))), color.alias("color"))


def _text_width(text: Column, scale: Column) -> Column:
    return (F.length(text) * (WIDE + 1) - 1) * scale


def _text(level: int, text: Column, x: Column, y: Column, scale: Column, color: Column) -> Column:
    """The rectangles of a number."""
    lit = F.array(*(F.array(*(F.struct(F.lit(c).alias("x"), F.lit(r).alias("y")) for r in range(HIGH) for c in range(WIDE) if rows[r] >> (WIDE - 1 - c) & 1)) for rows in DIGITS))
    digit = lambda i: F.get(lit, F.substring(text, i + 1, F.lit(1)).cast("int"))
    each = lambda i: F.transform(digit(i), lambda p: _rect(level, x + (i * (WIDE + 1) + p["x"]) * scale, y + p["y"] * scale, scale, scale, color))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(text) - 1), each))


def _inside(level: int, text: Column, x: Column, y: Column, side: Column, color: Column) -> Column:
    """A number in the middle of a square, if it fits with a margin."""
    w, h = _text_width(text, F.col("scale")), HIGH * F.col("scale")
    drawn = _text(level, text, x + _half(side - w), y + _half(side - h), F.col("scale"), color)
    return F.when((w + 2 <= side) & (h + 2 <= side), drawn).otherwise(F.array().cast(drawn_type()))


def drawn_type() -> str:
    return "array<struct<level:int,x:int,y:int,w:int,h:int,color:struct<r:int,g:int,b:int,a:int>>>"


def _half(v: Column) -> Column:
    """Half of a number, toward zero."""
    return (v / 2).cast("int")


def layouts(charts: DataFrame, legend: DataFrame, cell: int) -> DataFrame:
    """Places of a chart's parts, from charts (chart_id, width, height) and legend (chart_id, idx, r, g, b, count)."""
    if not CELLS[0] <= cell <= CELLS[1]:
        raise ValueError(f"cell size must be between {CELLS[0]} and {CELLS[1]}, got {cell}")
    known = legend.groupBy("chart_id").agg(F.count(F.lit(1)).alias("entries"), F.max("count").alias("most"))
    scale, pad = max(cell // 10, 1), max(cell // 10, 2)
    digits = lambda c: F.length(c.cast("string"))
    wide = lambda n: (n * (WIDE + 1) - 1) * scale
    swatch = max(cell, HIGH * scale + pad * 2)
    at = charts.join(known, "chart_id", "left").fillna(0, ["entries", "most"])
    at = at.withColumns({"scale": F.lit(scale), "pad": F.lit(pad), "swatch": F.lit(swatch), "cell": F.lit(cell)})
    at = at.withColumns({"left": wide(digits(F.col("height"))) + 2 * pad, "top": F.lit(HIGH * scale + 2 * pad), "places": digits(F.col("most"))})
    needed = F.col("left") + swatch + 3 * pad + 3 * wide(3) + 9 * pad + wide(F.col("places")) + pad
    below = F.when(F.col("entries") > 0, F.col("entries") * (swatch + 2 * pad) + 4 * pad).otherwise(0)
    return at.withColumns({
        "canvas_w": F.greatest(F.col("left") + F.col("width") * cell + pad, needed), "canvas_h": F.col("top") + F.col("height") * cell + pad + below + pad,
        "col_step": label_interval(F.col("cell"), F.col("scale"), F.col("width")), "row_step": label_interval(F.col("cell"), F.col("scale"), F.col("height")),
    })


RUN = "chart_id long, y int, x int, n int, color long"
#: Cells that a task paints; a chart is never parted.
PAINTED = 100_000


def _runs(chart: int, image: np.ndarray) -> pa.RecordBatch:
    """Runs of one colour in each row; places that nothing covers (-1) are in none."""
    first = np.ones(image.shape, bool)
    first[:, 1:] = image[:, 1:] != image[:, :-1]
    y, x = np.nonzero(first)
    start = y * image.shape[1] + x
    n, color = np.diff(start, append=image.size), image[y, x]
    on = color >= 0
    return pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), chart, np.int64)), *(pa.array(v[on].astype(np.int32)) for v in (y, x, n)), pa.array(color[on])], names=["chart_id", "y", "x", "n", "color"])


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Charts from their rectangles, which come chart by chart, the lowest level first."""
    chart = image = None
    for b in batches:
        charts, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        edges = np.flatnonzero(np.diff(charts)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(charts)]):
            if lo == hi:
                continue
            if charts[lo] != chart:
                if image is not None:
                    yield _runs(chart, image)
                chart, image = int(charts[lo]), np.full((columns[1][lo], columns[0][lo]), -1, np.int64)
            for x, y, w, h, c in zip(*(v[lo:hi].tolist() for v in columns[2:])):
                image[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = c
    if image is not None:
        yield _runs(chart, image)


def chart_pixels(charts: DataFrame, cells: DataFrame, legend: DataFrame, cell: int) -> DataFrame:
    """chart_id, y, x, r, g, b, a of whole charts, from what chart_runs() reads."""
    runs = chart_runs(charts, cells, legend, cell)
    return runs.select("chart_id", "y", F.explode(F.sequence("x", F.col("x") + F.col("n") - 1)).alias("x"), "r", "g", "b", "a")


def chart_runs(charts: DataFrame, cells: DataFrame, legend: DataFrame, cell: int) -> DataFrame:
    """chart_id, y, x, n, r, g, b, a: runs of n pixels of one colour, of whole charts; cells (chart_id, row, col, idx), idx -1 or null for none.

    legend (chart_id, idx, r, g, b, count) counts idx from 0; a cell whose idx it lacks is left
    blank, as is one outside its chart. A chart without cells or legend has its grid and labels only.
    """
    at = layouts(charts.select("chart_id", "width", "height"), legend, cell)
    left, top, pad, scale, swatch = (F.col(c) for c in ("left", "top", "pad", "scale", "swatch"))
    ink, n = F.lit(cell), F.lit(HIGH) * scale
    black = _color(BLACK)
    label = lambda i: (i + 1).cast("string")
    steps = lambda until, step: F.filter(F.sequence(F.lit(0), until), lambda i: (i < until) & (i % step == 0))
    line = lambda i: F.when(i % 10 == 0, _color(DARK)).otherwise(_color(LIGHT))
    grid_w, grid_h = F.col("width") * cell, F.col("height") * cell
    tops = F.flatten(F.transform(steps(F.col("width"), F.col("col_step")), lambda i: _text(1, label(i), left + i * cell + _half(ink - _text_width(label(i), scale)), pad, scale, black)))
    sides = F.flatten(F.transform(steps(F.col("height"), F.col("row_step")), lambda i: _text(1, label(i), F.greatest(left - pad - _text_width(label(i), scale), F.lit(0)), top + i * cell + _half(ink - n), scale, black)))
    uprights = F.transform(F.sequence(F.lit(0), F.col("width")), lambda i: _rect(4, left + i * cell, top, F.lit(1), grid_h, line(i)))
    levels = F.transform(F.sequence(F.lit(0), F.col("height")), lambda i: _rect(5, left, top + i * cell, grid_w, F.lit(1), line(i)))
    canvas = F.array(_rect(0, F.lit(0), F.lit(0), F.col("canvas_w"), F.col("canvas_h"), _color(WHITE)))
    frame = at.select("chart_id", "canvas_w", "canvas_h", F.inline(F.concat(canvas, tops, sides, uprights, levels)))

    lit = with_oklab(legend).withColumn("ink", F.when(F.col("lab_l") > BRIGHT, black).otherwise(_color(WHITE)))
    lit = lit.select("chart_id", "idx", "count", "ink", F.struct(F.col("r").cast("int").alias("r"), F.col("g").cast("int").alias("g"), F.col("b").cast("int").alias("b"), F.lit(255).alias("a")).alias("own"))
    on = cells.select("chart_id", "row", "col", "idx").join(lit.select("chart_id", "idx", "ink", "own"), ["chart_id", "idx"]).join(at, "chart_id").where("row BETWEEN 0 AND height - 1 AND col BETWEEN 0 AND width - 1")
    x, y = left + F.col("col") * cell, top + F.col("row") * cell
    squares = on.select("chart_id", "canvas_w", "canvas_h", F.inline(F.concat(F.array(_rect(2, x, y, ink, ink, F.col("own"))), _inside(3, label(F.col("idx")), x, y, ink, F.col("ink")))))

    row_y = top + grid_h + pad + pad * 4 + F.col("idx") * (swatch + pad * 2)
    text_y, step = row_y + _half(swatch - n), _text_width(F.lit("000"), scale) + pad * 3
    first = left + swatch + pad * 3
    fields = [_text(6, F.lpad(F.col(f"own.{c}").cast("string"), 3, "0"), first + step * k, text_y, scale, black) for k, c in enumerate("rgb")]
    counted = _text(6, F.lpad(F.col("count").cast("string"), F.col("places"), F.lit("0")), first + step * 3, text_y, scale, black)
    entries = lit.join(at, "chart_id").select("chart_id", "canvas_w", "canvas_h", F.inline(F.concat(F.array(_rect(6, left, row_y, swatch, swatch, F.col("own"))), _inside(7, label(F.col("idx")), left, row_y, swatch, F.col("ink")), *fields, counted)))

    rects = reduce(DataFrame.union, (frame, squares, entries))
    shift = F.col("color.r").cast("long") * (1 << 24) + F.col("color.g") * (1 << 16) + F.col("color.b") * (1 << 8) + F.col("color.a")
    rects = rects.select("chart_id", "canvas_w", "canvas_h", "x", "y", "w", "h", shift.alias("c"), "level")
    size = charts.agg(F.sum(F.col("width").cast("long") * F.col("height"))).first()[0] or 0
    tasks = max(1, -(-size // PAINTED))
    rects = rects.repartition(tasks, "chart_id").sortWithinPartitions("chart_id", "level").drop("level")
    runs = rects.mapInArrow(_painted, RUN)
    byte = lambda k: F.shiftright("color", k).bitwiseAND(F.lit(255).cast("long")).cast("int")
    return runs.select("chart_id", "y", "x", "n", *(byte(k).alias(c) for c, k in zip("rgba", (24, 16, 8, 0))))
