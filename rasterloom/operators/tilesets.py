"""Tile sets: which tiles are the same up to flips and transposition, and map files of every grid shape.

A tile's eight turned versions (four if it is not square) are the same set for all its
turned copies, so the least of them names the whole class: one grouped minimum over that
name finds each class's first tile, whatever the tiles' size and depth, without comparing
tiles with one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.export import tile_gid

#: Turns in the order in which they are tried: transposed first, then flipped across and down; (transpose, down, across).
TURNS = [(t, v, h) for t in (0, 1) for v, h in ((0, 0), (0, 1), (1, 0), (1, 1))]


def _turned(values: Column, w: int, h: int, turn: tuple[int, int, int]) -> Column:
    """A tile's values row by row after a turn."""
    t, down, across = turn

    def source(p: Column) -> Column:
        y, x = F.floor(p / w), p % w
        x, y = (w - 1 - x if across else x), (h - 1 - y if down else y)
        x, y = (y, x) if t else (x, y)
        return F.element_at(values, (y * w + x + 1).cast("int"))

    return values if turn == (0, 0, 0) else F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), source)


def tile_values(px: DataFrame, w: int, h: int, keys: list[str]) -> DataFrame:
    """keys, tile, _v: the pixels of every whole tile (keys, tile, y, x, r, g, b, a) as one array of packed colours, row by row."""
    color = (F.col("r").cast("long") * 16777216 + F.col("g") * 65536 + F.col("b") * 256 + F.col("a")).alias("c")
    one = px.groupBy(*keys, "tile").agg(F.array_sort(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("p"), color))).alias("_s"))
    return one.where(F.size("_s") == w * h).select(*keys, "tile", F.transform("_s", lambda s: s["c"]).alias("_v"))


def identified(px: DataFrame, w: int, h: int, keys: list[str]) -> DataFrame:
    """keys, tile, found, turn: the first tile of the set that this one is a turned copy of, maybe itself, and the first turn of that one which gives this one.

    Tiles are compared by a digest of their class's name; the turn is found on the pixels themselves.
    """
    turns = TURNS if w == h else TURNS[:4]
    tiles = tile_values(px, w, h, keys)
    name = F.least(*(_turned(F.col("_v"), w, h, t) for t in turns))
    tiles = tiles.withColumn("_name", F.sha2(F.to_json(name).cast("binary"), 256))
    first = tiles.groupBy(*keys, "_name").agg(F.min_by("_v", "tile").alias("_first"), F.min("tile").alias("found"))
    both = tiles.join(first, [*keys, "_name"])
    turn = F.coalesce(*(F.when(_turned(F.col("_first"), w, h, t) == F.col("_v"), k) for k, t in enumerate(turns)))
    return both.select(*keys, "tile", "found", turn.alias("turn"))


def tile_set(px: DataFrame, w: int, h: int, keys: list[str]) -> DataFrame:
    """keys, tile, index, turn: tiles by the set that holds each class once; indices count from 1 in the order of first tiles."""
    found = identified(px, w, h, keys)
    index = F.dense_rank().over(Window.partitionBy(*keys).orderBy("found"))
    return found.select(*keys, "tile", index.alias("index"), "turn")


def turn_flags(turn: Column) -> tuple[Column, Column, Column]:
    """Whether a turn flips across, flips down and transposes."""
    return turn % 2 == 1, F.floor(turn / 2) % 2 == 1, turn >= 4


#: How a map file names grids; a hexagon's flat side is half the tile's height, and odd rows are moved.
ORIENTATIONS = {"rectangular": "orthogonal", "isometric": "isometric", "hexagonal": "hexagonal"}
VERSION = "1.10"
SCALES = (1, 2, 4, 8)


def shaped_map_json(maps: DataFrame, cells: DataFrame) -> DataFrame:
    """map_id, json of whole maps (map_id, shape, cols, rows, tile_width, tile_height, tiles, scale, name, image) with cells (map_id, row, col, tile, flip_h, flip_v, transpose).

    A map is given only if it has a cell for every place, a tile, and an allowed scale; the fields of hexagons are left out of others.
    """
    gid = tile_gid(F.col("tile"), F.col("flip_h"), F.col("flip_v"), F.col("transpose"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", gid.alias("gid")))), lambda c: c["gid"])
    m = cells.groupBy("map_id").agg(data.alias("data")).join(maps, "map_id").where((F.size("data") == F.col("cols") * F.col("rows")) & (F.col("tiles") > 0) & F.col("scale").isin(*SCALES))
    hexes = F.col("shape") == "hexagonal"
    only = lambda v: F.when(hexes, v)
    tw, th = (F.col("tile_width") * F.col("scale")).alias("tilewidth"), (F.col("tile_height") * F.col("scale")).alias("tileheight")
    orientation = F.coalesce(*(F.when(F.col("shape") == k, v) for k, v in ORIENTATIONS.items()))
    layer = F.struct(F.lit(1).alias("id"), F.col("name").alias("name"), F.lit("tilelayer").alias("type"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("cols").alias("width"), F.col("rows").alias("height"), F.lit(True).alias("visible"), F.lit(1.0).alias("opacity"), "data")
    tiles = F.struct(F.lit(1).alias("firstgid"), F.col("name").alias("name"), F.col("image").alias("image"), (F.col("tiles") * F.col("tile_width") * F.col("scale")).alias("imagewidth"), (F.col("tile_height") * F.col("scale")).alias("imageheight"), tw, th, F.col("tiles").alias("tilecount"), F.col("tiles").alias("columns"), F.lit(0).alias("margin"), F.lit(0).alias("spacing"))
    whole = F.struct(
        F.lit("map").alias("type"), F.lit(VERSION).alias("version"), orientation.alias("orientation"), F.lit("right-down").alias("renderorder"), F.col("cols").alias("width"), F.col("rows").alias("height"), tw, th,
        only(F.floor(F.col("tile_height") * F.col("scale") / 2).cast("int")).alias("hexsidelength"), only(F.lit("y")).alias("staggeraxis"), only(F.lit("odd")).alias("staggerindex"),
        F.lit(False).alias("infinite"), F.lit(2).alias("nextlayerid"), F.lit(1).alias("nextobjectid"), F.array(layer).alias("layers"), F.array(tiles).alias("tilesets"),
    )
    return m.select("map_id", F.to_json(whole).alias("json"))
