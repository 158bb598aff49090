"""Sheets of frames, their metadata, and tile grids for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factors that an exported image may be enlarged by.
SCALES = (1, 2, 4, 8)
#: The flip bits of a tile id, by export format.
FLIP_X, FLIP_Y, FLIP_DIAGONAL = 1 << 31, 1 << 30, 1 << 29


def scale_nearest(px: DataFrame, factor: int) -> DataFrame:
    """Every pixel as factor x factor pixels."""
    if factor not in SCALES:
        raise ValueError(f"the scale is one of {SCALES}, not {factor}")
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    big = px.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
    return big.withColumns({"y": F.col("y") * factor + F.col("_i"), "x": F.col("x") * factor + F.col("_j")}).drop("_i", "_j")


def sheet_columns(frames: Column, wanted: Column) -> Column:
    return F.greatest(F.lit(1), F.least(wanted, frames))


def cell_origin(index: Column, columns: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return (index % columns) * width, F.floor(index / columns) * height


def sheet(frames: DataFrame, columns: int, width: int, height: int) -> DataFrame:
    """(sprite_id, frame, y, x, r, g, b, a), frames from 0 -> one raster a sprite, frames row by row; cells without a frame have no rows."""
    n = F.max("frame").over(Window.partitionBy("sprite_id")) + 1
    ox, oy = cell_origin(F.col("frame"), F.col("_columns"), F.lit(width), F.lit(height))
    out = frames.withColumn("_columns", sheet_columns(n, F.lit(columns)))
    return out.select("sprite_id", (F.col("y") + oy).cast("int").alias("y"), (F.col("x") + ox).cast("int").alias("x"), "r", "g", "b", "a")


def rebased_tags(tags: DataFrame) -> DataFrame:
    """(sprite_id, tag, lo, hi, frames) -> the tag's own sheet: its first and last frame within the frames that it takes."""
    lo = F.least(F.greatest(F.least("lo", "hi"), F.lit(0)), F.col("frames") - 1)
    hi = F.least(F.greatest(F.greatest("lo", "hi"), F.lit(0)), F.col("frames") - 1)
    return tags.withColumns({"first": lo, "taken": hi - lo + 1}).withColumns({"from": F.lit(0), "to": F.greatest(F.lit(0), F.col("taken") - 1)})


def sheet_metadata(sprites: DataFrame, frames: DataFrame, tags: DataFrame) -> DataFrame:
    """sprite_id, json: where each frame lies on the sheet, how long it shows, and the tags.

    sprites (sprite_id, stem, columns, width, height, scale), frames (sprite_id, frame, ms),
    tags (sprite_id, name, from, to, direction).
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("sprite_id")).cast("int")
    rows = frames.join(sprites, "sprite_id").withColumn("n", n).withColumn("columns", sheet_columns(F.col("n"), F.col("columns")))
    w, h = F.col("width") * F.col("scale"), F.col("height") * F.col("scale")
    ox, oy = cell_origin(F.col("frame"), F.col("columns"), w, h)
    rect = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    entry = F.struct(
        F.format_string("%s %d.png", "stem", "frame").alias("filename"), rect(ox, oy).alias("frame"), F.lit(False).alias("rotated"), F.lit(False).alias("trimmed"),
        rect(F.lit(0), F.lit(0)).alias("spriteSourceSize"), F.struct(w.cast("int").alias("w"), h.cast("int").alias("h")).alias("sourceSize"), F.col("ms").alias("duration"),
    )
    size = F.struct((F.first("columns") * F.first(w)).cast("int").alias("w"), (F.ceil(F.first("n") / F.first("columns")) * F.first(h)).cast("int").alias("h"))
    one = rows.groupBy("sprite_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", entry.alias("e")))), lambda e: e["e"]).alias("frames"), size.alias("size"), F.first("stem").alias("stem"), F.first("scale").alias("scale"))
    named = tags.groupBy("sprite_id").agg(F.array_sort(F.collect_list(F.struct("name", "from", "to", "direction"))).alias("tags"))
    meta = F.struct(F.concat("stem", F.lit(".png")).alias("image"), F.lit("RGBA8888").alias("format"), "size", F.col("scale").cast("string").alias("scale"), F.coalesce("tags", F.array().cast("array<struct<name:string,from:int,to:int,direction:string>>")).alias("frameTags"))
    return one.join(named, "sprite_id", "left").select("sprite_id", F.to_json(F.struct("frames", meta.alias("meta"))).alias("json"))


def tile_gid(tile: Column, flip_x: Column, flip_y: Column, diagonal: Column) -> Column:
    """The id of a tile (0: none) in a map file, with the flips in the top bits."""
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0)).cast("long")
    return F.when(tile == 0, F.lit(0).cast("long")).otherwise(tile.cast("long") + bit(flip_x, FLIP_X) + bit(flip_y, FLIP_Y) + bit(diagonal, FLIP_DIAGONAL))


def map_json(grids: DataFrame, tile: tuple[int, int], tiles: DataFrame) -> DataFrame:
    """(map_id, row, col, gid) and (map_id, tiles) -> map_id, json: one layer of ids row by row, and the atlas of tiles in one row."""
    data = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "gid"))), lambda c: c["gid"])
    m = grids.groupBy("map_id").agg(data.alias("data"), (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height")).join(tiles, "map_id")
    layer = F.struct("data", "width", "height", F.lit("tilelayer").alias("type"))
    atlas = F.struct(F.lit(1).alias("firstgid"), F.col("tiles").alias("tilecount"), F.col("tiles").alias("columns"), F.lit(tile[0]).alias("tilewidth"), F.lit(tile[1]).alias("tileheight"), (F.col("tiles") * tile[0]).alias("imagewidth"), F.lit(tile[1]).alias("imageheight"))
    return m.select("map_id", F.to_json(F.struct("width", "height", F.lit(tile[0]).alias("tilewidth"), F.lit(tile[1]).alias("tileheight"), F.array(layer).alias("layers"), F.array(atlas).alias("tilesets"))).alias("json"))


def atlas(tiles: DataFrame, width: int) -> DataFrame:
    """(map_id, tile, y, x, …), tiles from 0 -> the tiles side by side."""
    return tiles.withColumn("x", F.col("x") + F.col("tile") * width).drop("tile")


def tile_pixels(px: DataFrame, rects: DataFrame) -> DataFrame:
    """(image_id, tile, x0, y0, w, h) -> each rectangle's pixels from (0, 0); a rectangle that leaves its image gives none."""
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    good = rects.join(size, "image_id").where("x0 >= 0 AND y0 >= 0 AND x0 + w <= _w AND y0 + h <= _h").drop("_w", "_h")
    near = px.join(good, "image_id").where("x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h")
    return near.select("image_id", "tile", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "r", "g", "b", "a")
