"""Queries over tile sets and map files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import tilesets as T
from rasterloom.registry import query
from rasterloom.sources.rasters import PIXELS, pixels

W = 8
#: Tiles of 8 x 8 from every pixel: a few shapes, mirrored here and there.
_TILED = "SELECT image_id, (y // 8) * 8 + x // 8 tile, y % 8 y, CASE WHEN (x // 8 + y // 8 + image_id) % 2 = 0 THEN 7 - x % 8 ELSE x % 8 END x, x // 8 % 3 k, y // 8 % 4 m, b % 2 c FROM px"
_SHAPES = "SELECT image_id, tile, y, x, CASE WHEN x <= k THEN 255 ELSE 0 END r, CASE WHEN y < m THEN 200 ELSE 10 END g, CASE WHEN x = y AND k = 2 THEN 90 ELSE c END b, CASE WHEN x + y > 12 AND m = 1 THEN 0 ELSE 255 END a FROM t"


def _places(t: int, v: int, h: int) -> list[int]:
    """Where a turned tile takes each of its places from, from 1."""
    out = []
    for p in range(W * W):
        y, x = divmod(p, W)
        x, y = (W - 1 - x if h else x), (W - 1 - y if v else y)
        x, y = (y, x) if t else (x, y)
        out.append(y * W + x + 1)
    return out


@query(f"""WITH {PIXELS}, t AS ({_TILED}), s AS ({_SHAPES}),
v AS (SELECT image_id, tile, list(r::BIGINT * 16777216 + g * 65536 + b * 256 + a ORDER BY y, x) v FROM s GROUP BY ALL HAVING count(*) = 64),
f AS ({" UNION ALL ".join(f"SELECT image_id, tile, {k} turn, list_select(v, {_places(*turn)}) v FROM v" for k, turn in enumerate(T.TURNS))}),
m AS (SELECT v.image_id, v.tile, min(f.tile * 8 + f.turn) best FROM v JOIN f ON f.image_id = v.image_id AND f.v = v.v GROUP BY ALL)
SELECT image_id, tile::BIGINT tile, (best // 8)::BIGINT AS found, (best % 8)::INT turn FROM m""")
def tile_identities(spark: SparkSession, d: str) -> DataFrame:
    """The first 8 x 8 tile of its image that each is a turned copy of, and the turn."""
    px = pixels(spark, d)
    tx, ty = F.floor(F.col("x") / W), F.floor(F.col("y") / W)
    x = F.when((tx + ty + F.col("image_id")) % 2 == 0, 7 - F.col("x") % W).otherwise(F.col("x") % W)
    t = px.select("image_id", (ty * 8 + tx).alias("tile"), (F.col("y") % W).alias("y"), x.alias("x"), (tx % 3).alias("k"), (ty % 4).alias("m"), (F.col("b") % 2).alias("c"))
    shapes = t.select(
        "image_id", "tile", "y", "x", F.when(F.expr("x <= k"), 255).otherwise(0).alias("r"), F.when(F.expr("y < m"), 200).otherwise(10).alias("g"),
        F.when(F.expr("x = y AND k = 2"), 90).otherwise(F.col("c")).alias("b"), F.when(F.expr("x + y > 12 AND m = 1"), 0).otherwise(255).alias("a"),
    )
    return T.identified(shapes, W, W, ["image_id"])


_COMMON = "'infinite': false, 'nextlayerid': 2, 'nextobjectid': 1, 'layers': [{'id': 1, 'name': 'map', 'type': 'tilelayer', 'x': 0, 'y': 0, 'width': w, 'height': h, 'visible': true, 'opacity': 1.0, 'data': d}], 'tilesets': [{'firstgid': 1, 'name': 'map', 'image': 'map.png', 'imagewidth': 800, 'imageheight': 12, 'tilewidth': 16, 'tileheight': 12, 'tilecount': 50, 'columns': 50, 'margin': 0, 'spacing': 0}]"


def _map_sql(shape: str, orientation: str, more: str = "") -> str:
    return f"SELECT map_id, to_json({{'type': 'map', 'version': '1.10', 'orientation': '{orientation}', 'renderorder': 'right-down', 'width': w, 'height': h, 'tilewidth': 16, 'tileheight': 12{more}, {_COMMON}}})::VARCHAR AS json FROM m WHERE shape = '{shape}'"


@query(f"""WITH g AS (SELECT l_suppkey % 12 map_id, l_orderkey // 4 % 9 AS row, (l_linenumber - 1) % 4 AS col, max(l_partkey % 50) tile, max(l_orderkey % 2) h, max(l_suppkey % 3) v FROM lineitem GROUP BY ALL),
i AS (SELECT map_id, row, col, CASE WHEN tile = 0 THEN 0 ELSE tile + h * 2147483648 + (v = 1)::INT * 1073741824 + (v = 2)::INT * 536870912 END::BIGINT gid FROM g),
m AS (SELECT map_id, (['rectangular', 'isometric', 'hexagonal'])[map_id % 3 + 1] shape, list(gid ORDER BY row, col) d, 4 w, 9 h FROM i GROUP BY map_id HAVING count(*) = 36)
{_map_sql("rectangular", "orthogonal")} UNION ALL {_map_sql("isometric", "isometric")} UNION ALL {_map_sql("hexagonal", "hexagonal", ", 'hexsidelength': 6, 'staggeraxis': 'y', 'staggerindex': 'odd'")}""")
def map_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Map files of rectangular, isometric and hexagonal grids at twice the size."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    cells = li.groupBy((F.col("l_suppkey") % 12).alias("map_id"), (F.floor(F.col("l_orderkey") / 4) % 9).alias("row"), ((F.col("l_linenumber") - 1) % 4).alias("col")).agg(
        F.max(F.col("l_partkey") % 50).alias("tile"), (F.max(F.col("l_orderkey") % 2) == 1).alias("flip_h"), (F.max(F.col("l_suppkey") % 3)).alias("v")
    ).withColumns({"flip_v": F.col("v") == 1, "transpose": F.col("v") == 2})
    shape = F.element_at(F.array(F.lit("rectangular"), F.lit("isometric"), F.lit("hexagonal")), (F.col("map_id") % 3 + 1).cast("int"))
    lit = {"cols": 4, "rows": 9, "tile_width": 8, "tile_height": 6, "tiles": 50, "scale": 2, "name": "map", "image": "map.png"}
    maps = cells.select("map_id").distinct().withColumn("shape", shape).withColumns({k: F.lit(v) for k, v in lit.items()})
    return T.shaped_map_json(maps, cells)
