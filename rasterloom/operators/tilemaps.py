"""Tile grids as relations: cell(image_id, col, row, packed) and tile(tile, ty, tx, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import geometry as G
from rasterloom.operators.shapes import line
from rasterloom.tables import dealt


def placed(x: Column, y: Column, u: dict[str, Column], tw: int, th: int) -> tuple[Column, Column]:
    """Where a tile's pixel goes inside its cell: transposed (square tiles only), then flipped across, then down."""
    if tw == th:
        x, y = F.when(u["transpose"], y).otherwise(x), F.when(u["transpose"], x).otherwise(y)
    return F.when(u["flip_h"], tw - 1 - x).otherwise(x), F.when(u["flip_v"], th - 1 - y).otherwise(y)


def render_tilemap(cells: DataFrame, tiles: DataFrame, shape: str, tw: int, th: int, width: int, height: int, ox: int = 0, oy: int = 0) -> DataFrame:
    """Pixels image_id, y, x, r, g, b, a of the cells whose tile exists; an empty cell, or a place outside the canvas, draws nothing.

    Cells of a rectangular grid do not overlap, so every pixel is a projection of the join.
    In the other grids boxes overlap: the pixels of a place are folded from back to front, by
    row and column, or for isometric grids by col + row and then column. A place has at most
    a few of them (the tile's area over the area of a step), so no stack grows with the data.
    """
    u = G.unpack_tile(F.col("packed"))
    drawn = cells.where("packed <> 0").withColumn("tile", u["tile"]).join(tiles, "tile")
    at_x, at_y = placed(F.col("tx"), F.col("ty"), u, tw, th)
    left, top = G.cell_origin(shape, F.col("col"), F.col("row"), tw, th, ox, oy)
    out = drawn.withColumns({"x": (C.half_up(left) + at_x).cast("int"), "y": (C.half_up(top) + at_y).cast("int")})
    out = out.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    if shape not in ("isometric", "hexagonal"):
        return out.select("image_id", "y", "x", "r", "g", "b", "a")
    order = (F.col("col") + F.col("row"), F.col("col")) if shape == "isometric" else (F.col("row"), F.col("col"))
    item = F.struct(order[0].alias("first"), order[1].alias("second"), "r", "g", "b", "a")
    stack = out.where("a > 0").groupBy("image_id", "y", "x").agg(F.array_sort(F.collect_list(item)).alias("stack"))
    zero = F.struct(*(F.lit(0).alias(n) for n in "rgba"))

    def step(s: Column, e: Column) -> Column:
        return F.struct(*(v.alias(n) for n, v in zip("rgba", C.over(tuple(e[n] for n in "rgba"), F.lit(1.0), tuple(s[n] for n in "rgba")))))

    return stack.select("image_id", "y", "x", F.aggregate("stack", zero, step).alias("c")).select("image_id", "y", "x", "c.r", "c.g", "c.b", "c.a")


def translate_tile(raw: Column, index_mask: Column, h_mask: Column, v_mask: Column, d_mask: Column) -> Column:
    """A tile number whose bits a file describes by masks -> our packed id."""
    on = lambda m: (raw.bitwiseAND(m) != 0).cast("int")
    return G.pack_tile(raw.bitwiseAND(index_mask), on(h_mask), on(v_mask), on(d_mask))


def thumbnail(px: DataFrame, width: int, height: int, side: int = 256) -> DataFrame:
    """The image fitted into side x side, centred, nearest pixels; places around it have no row."""
    scale = side / max(width, height)
    w, h = (min(side, max(1, int(n * scale + 0.5))) for n in (width, height))

    def drawn(c: str, n: int, size: int) -> Column:
        """Places of the drawing that show source place c: those t with t * n // size = c."""
        first, after = F.ceil(F.col(c) * size / n), F.ceil((F.col(c) + 1) * size / n)
        return F.when(first < after, F.sequence(first, after - 1)).otherwise(F.array().cast("array<bigint>"))

    rows = px.withColumn("ty", F.explode(drawn("y", height, h))).withColumn("tx", F.explode(drawn("x", width, w)))
    return rows.select("image_id", (F.col("ty") + (side - h) // 2).cast("int").alias("y"), (F.col("tx") + (side - w) // 2).cast("int").alias("x"), "r", "g", "b", "a")


#: Stamps that a task takes; all of a map are one task's.
STAMPS = 100_000


def stamped(strokes: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells that strokes of stamps leave: map_id, row, col, tile; strokes (map_id, stroke, seq, col, row, tile), grids (map_id, cols, rows).

    Between two places of a stroke the cells of the line are stamped too, with the later place's tile;
    the last stamp of a cell stays, and cells outside the grid take none.
    """
    strokes = dealt(strokes, "map_id", STAMPS)
    before = Window.partitionBy("map_id", "stroke").orderBy("seq")
    was = lambda c: F.coalesce(F.lag(c).over(before), F.col(c)).cast("int")
    at = strokes.withColumn("_cells", line(was("col"), was("row"), F.col("col").cast("int"), F.col("row").cast("int")))
    each = at.select("map_id", "stroke", "seq", "tile", F.posexplode("_cells").alias("_n", "_p")).join(grids, "map_id")
    each = each.where("_p.x >= 0 AND _p.y >= 0 AND _p.x < cols AND _p.y < rows")
    return each.groupBy("map_id", F.col("_p.y").alias("row"), F.col("_p.x").alias("col")).agg(F.max_by("tile", F.struct("stroke", "seq", "_n")).alias("tile"))
