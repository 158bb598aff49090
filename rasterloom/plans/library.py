"""Queries over conversion settings, flattening, effects, indices, sheets, maps and grids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import geometry as G
from rasterloom.operators import cache as H
from rasterloom.operators import compose as K
from rasterloom.operators import convert as V
from rasterloom.operators import export as X
from rasterloom.operators import indexed as N
from rasterloom.operators import raster as R
from rasterloom.plans import sql as S
from rasterloom.plans.pixels import _BOX, _COL, _ROW, _SEP
from rasterloom.registry import query
from rasterloom.sources.palettes import colors
from rasterloom.sources.rasters import PIXELS, SIDE, pixels
from rasterloom.tables import settled

_CGA = ", ".join(f"(r - {c[0]}) * (r - {c[0]}) + (g - {c[1]}) * (g - {c[1]}) + (b - {c[2]}) * (b - {c[2]})" for c in colors("cga"))


@query(f"WITH {PIXELS}, {_BOX} SELECT image_id, y, x, CASE WHEN a < 100 THEN 65535 ELSE list_position([{_CGA}], list_min([{_CGA}])) - 1 END::INT idx, CASE WHEN a < 100 THEN 0 ELSE a END::INT a FROM box")
def convert_srgb(spark: SparkSession, d: str) -> DataFrame:
    """Nearest colours in 8-bit channels, with an alpha threshold of 100 and alpha kept above it."""
    s = V.Settings(24, 24, palette=tuple(colors("cga")), color_space="srgb", alpha_threshold=100, preserve_alpha=True)
    return V.convert(pixels(spark, d), s, SIDE, SIDE)


@query(f"""WITH {PIXELS}, c AS (SELECT image_id, y - 3 y, x - 7 x, r, g, b, CASE WHEN (x + y + image_id) % 9 < 4 AND y > 10 THEN a ELSE 0 END a FROM px WHERE x BETWEEN 7 AND 36 AND y BETWEEN 3 AND 62),
s AS (SELECT image_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM c WHERE a >= 128 GROUP BY 1)
SELECT image_id, (c.y - coalesce(y0, 0))::INT y, (c.x - coalesce(x0, 0))::INT x, r, g, b, a, (coalesce(x1, 29) - coalesce(x0, 0) + 1)::INT w, (coalesce(y1, 59) - coalesce(y0, 0) + 1)::INT h
FROM c LEFT JOIN s USING (image_id) WHERE c.x BETWEEN coalesce(x0, 0) AND coalesce(x1, 29) AND c.y BETWEEN coalesce(y0, 0) AND coalesce(y1, 59)""")
def fitted(spark: SparkSession, d: str) -> DataFrame:
    """Cut to a rectangle, whose edges are cut to whole pixels, then to the bounds of what is opaque."""
    px = V.crop(pixels(spark, d), 7.9, 3.2, 29.3, 200, SIDE, SIDE)
    seen = ((F.col("x") + 7 + F.col("y") + 3 + F.col("image_id")) % 9 < 4) & (F.col("y") + 3 > 10)
    out = V.fit_to_subject(px.withColumn("a", F.when(seen, F.col("a")).otherwise(0)), 30, 60)
    return out.withColumnsRenamed({"_w": "w", "_h": "h"})


_RING = "greatest(max({c}) OVER (" + _ROW(1) + "), max({c}) OVER (" + _COL(1) + "))"


@query(f"""WITH {PIXELS}, o0 AS (SELECT *, (a >= 200)::INT k0 FROM px), o1 AS (SELECT *, {_RING.format(c='k0')} k1 FROM o0), o2 AS (SELECT *, {_RING.format(c='k1')} k2 FROM o1)
SELECT image_id, y, x, CASE WHEN k0 = 1 THEN b % 16 WHEN k2 = 1 THEN 3 ELSE 65535 END::INT idx, CASE WHEN k0 = 1 THEN a WHEN k2 = 1 THEN 90 ELSE 0 END::INT a FROM o2""")
def two_rings(spark: SparkSession, d: str) -> DataFrame:
    """An outline of two rings at an alpha of its own."""
    seen = F.col("a") >= 200
    idx = pixels(spark, d).select("image_id", "y", "x", F.when(seen, F.col("b") % 16).otherwise(R.TRANSPARENT).cast("int").alias("idx"), F.when(seen, F.col("a")).otherwise(0).alias("a"))
    return R.outlined(idx, F.lit(3), 90, thickness=2)


def _merge(n: int, src: str, opacity: float | str, mode: str, into: str, base: str | None = None) -> str:
    """Columns {into}r.. of step n: the source over what is there; with a base clipped to it."""
    if base:
        a, shown, opacity = f"floor({src}a * {opacity}::DOUBLE * ({base} / 255.0::DOUBLE) + 0.5)", f"{src}a > 0 AND {base} > 0", 1.0
    else:
        a, shown = f"{src}a", f"{src}a > 0"
    sa, da = f"({a} / 255.0::DOUBLE * {opacity}::DOUBLE)", f"({into}a / 255.0::DOUBLE)"
    o = f"({sa} + {da} * (1 - {sa}))"

    def channel(c: str) -> str:
        s, t = f"({src}{c} / 255.0::DOUBLE)", f"({into}{c} / 255.0::DOUBLE)"
        mixed = f"{src}{c}" if mode == "normal" else f"(CASE WHEN {da} > 0 THEN ((1 - {da}) * {s} + {da} * ({_SEP[mode].format(d=t, s=s)})) * 255 ELSE {src}{c} END)"
        return f"CASE WHEN {shown} THEN CASE WHEN {o} <= 0 THEN 0 ELSE floor(({mixed} * {sa} + {into}{c} * {da} * (1 - {sa})) / {o} + 0.5) END ELSE {into}{c} END AS {into}{c}"

    return f"f{n + 1} AS (SELECT * REPLACE ({', '.join(map(channel, 'rgb'))}, CASE WHEN {shown} THEN CASE WHEN {o} <= 0 THEN 0 ELSE floor({o} * 255 + 0.5) END ELSE {into}a END AS {into}a) FROM f{n})"


def grouped_sprites(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Sprites, their layers, cels and buffers: a group, clips, a linked cel, and layers that do not show."""
    px = pixels(spark, d)
    sprites = px.select(F.col("image_id").alias("sprite_id")).distinct().withColumns({"width": F.lit(SIDE), "height": F.lit(SIDE)})
    cel = lambda k: (F.col("image_id") * 8 + k).alias("cel_id")
    buffers = px.select(cel(1), "y", "x", "r", "g", "b", "a").union(px.select(cel(3), "y", "x", "g", "b", "r", 255 - F.col("a"))).union(px.select(cel(4), "y", "x", "b", "r", "g", F.floor(F.col("a") / 2).cast("int")))
    cels = "array(struct(1L, 1, 0, 0, cast(null as int)), (3L, 3, 0, 0, null), (4L, 4, -3, 2, null), (5L, 5, -3, 2, 4), (6L, 1, 0, 0, 1), (7L, 3, 0, 0, 3))"
    c = F.expr(f"inline(transform({cels}, c -> struct(c.col1 as layer_id, sprite_id * 8 + c.col2 as cel_id, c.col3 as x, c.col4 as y, cast(sprite_id * 8 + c.col5 as long) as linked_to)))")
    cels = sprites.select("sprite_id", F.lit(1).cast("long").alias("frame_id"), c)
    rows = [(0, 1, None, "raster", True, 1.0, "normal", False), (1, 2, None, "group", True, 0.5, "multiply", False), (0, 3, 2, "raster", True, 0.9, "normal", False), (1, 4, 2, "raster", True, 0.8, "screen", True),
            (2, 6, None, "raster", False, 1.0, "normal", False), (3, 7, None, "raster", True, 0.0, "hue", False), (4, 5, None, "raster", True, 0.75, "difference", True)]
    layers = spark.createDataFrame([(*r, None) for r in rows], "z int, layer_id long, parent_id long, kind string, visible boolean, opacity double, blend string, clipping boolean, effects " + f"array<{K.EFFECT}>")
    return sprites, sprites.select("sprite_id").join(F.broadcast(layers)), cels, buffers  # seven layers


def _flattened(second: str = "0.9") -> str:
    """The sprites flattened, with this opacity of the layer within the group."""
    return f"""WITH {PIXELS}, p AS (SELECT * FROM px), q AS (SELECT image_id, y + 2 y, x - 3 x, b r, r g, g b, a // 2 a FROM p),
g AS (SELECT DISTINCT image_id FROM p), canvas AS (SELECT image_id, y::INT y, x::INT x FROM g, range(64) _(y), range(64) _(x)),
f0 AS (SELECT c.image_id, c.y, c.x, {', '.join(f'coalesce(p.{c}, 0)::DOUBLE p{c}' for c in 'rgba')}, coalesce(p.g, 0)::DOUBLE sr, coalesce(p.b, 0)::DOUBLE sg, coalesce(p.r, 0)::DOUBLE sb, coalesce(255 - p.a, 0)::DOUBLE sa,
  {', '.join(f'coalesce(q.{c}, 0)::DOUBLE q{c}' for c in 'rgba')}, {', '.join(f'0::DOUBLE g{c}, 0::DOUBLE u{c}' for c in 'rgba')} FROM canvas c LEFT JOIN p USING (image_id, y, x) LEFT JOIN q USING (image_id, y, x)),
{_merge(0, 's', second, 'normal', 'g')}, {_merge(1, 'q', 0.8, 'screen', 'g', f'floor(sa * {second}::DOUBLE + 0.5)')},
{_merge(2, 'p', 1.0, 'normal', 'u')}, {_merge(3, 'g', 0.5, 'multiply', 'u')}, {_merge(4, 'q', 0.75, 'difference', 'u', 'floor(ga * 0.5::DOUBLE + 0.5)')}
SELECT image_id sprite_id, 1::BIGINT frame_id, y, x, {', '.join(f'u{c}::INT {c}' for c in 'rgba')} FROM f5"""


FLATTENED = _flattened()


@query(FLATTENED)
def flatten_groups(spark: SparkSession, d: str) -> DataFrame:
    """A raster layer; a group, multiplied at half opacity, of a layer and one clipped to it; a linked cel off the canvas clipped to the group; layers that do not show."""
    return K.flatten(*grouped_sprites(spark, d))


@query(f"""SELECT sprite_id, frame_id, sprite_id % 3 > 0 reused, count(*) pixels, sum((y * 64 + x + 1) * (r + 3 * g + 7 * b + 11 * a))::BIGINT placed
FROM ({_flattened("(CASE WHEN image_id % 3 = 0 THEN 0.4 ELSE 0.9 END)")}) WHERE sprite_id % 5 <> 3 GROUP BY ALL""")
def recomposited(spark: SparkSession, d: str) -> DataFrame:
    """All sprites flattened into a cache, then a layer of every third one changed and some sprites deleted: what is composited anew, and what every frame shows."""
    sprites, layers, cels, px = grouped_sprites(spark, d)
    cached = settled(H.filled(sprites, layers, cels, px), "frames")
    alive = F.col("sprite_id") % 5 != 3
    edited = layers.withColumn("opacity", F.when((F.col("sprite_id") % 3 == 0) & (F.col("layer_id") == 3), 0.4).otherwise(F.col("opacity")))
    now = H.refreshed(cached, sprites.where(alive), edited, cels.where(alive), px)
    placed = (F.col("y") * SIDE + F.col("x") + 1).cast("long") * (F.col("r") + 3 * F.col("g") + 7 * F.col("b") + 11 * F.col("a"))
    return now.groupBy("sprite_id", "frame_id", "reused").agg(F.count(F.lit(1)).alias("pixels"), F.sum(placed).alias("placed"))


def _hsv_sql(h: float, s: float, v: float) -> str:
    n = [f"(({k} + nh / 60.0::DOUBLE) - 6 * floor(({k} + nh / 60.0::DOUBLE) / 6))" for k in (5, 3, 1)]
    out = ", ".join(f"CASE WHEN a > 0 THEN floor((nv - nv * ns * greatest(0::DOUBLE, least({k}, 4 - {k}, 1::DOUBLE))) * 255 + 0.5) ELSE {c} END::INT {c}" for k, c in zip(n, "rgb"))
    return f"""h1 AS (SELECT *, r / 255.0::DOUBLE rn, g / 255.0::DOUBLE gn, b / 255.0::DOUBLE bn, greatest(r, g, b) / 255.0::DOUBLE hi, least(r, g, b) / 255.0::DOUBLE lo FROM px),
h2 AS (SELECT *, CASE WHEN hi = lo THEN 0::DOUBLE WHEN hi = rn THEN 60 * ((gn - bn) / (hi - lo)) WHEN hi = gn THEN 60 * ((bn - rn) / (hi - lo) + 2) ELSE 60 * ((rn - gn) / (hi - lo) + 4) END + {h}::DOUBLE t FROM h1),
h3 AS (SELECT *, t - 360 * floor(t / 360) nh, least(1::DOUBLE, greatest(0::DOUBLE, CASE WHEN hi = 0 THEN 0::DOUBLE ELSE (hi - lo) / hi END + {s}::DOUBLE / 100)) ns, least(1::DOUBLE, greatest(0::DOUBLE, hi + {v}::DOUBLE / 100)) nv FROM h2)
SELECT image_id, y, x, {out}, a FROM h3"""


@query(f"WITH {PIXELS}, {_hsv_sql(37.0, -12.5, 9.5)}")
def hsv_shifted(spark: SparkSession, d: str) -> DataFrame:
    return C.hsv_shift(pixels(spark, d), 37.0, -12.5, 9.5)


@query(f"""WITH {PIXELS}, b AS (SELECT image_id, image_id * 8 + 1 cel_id, y, x, r, g, b, a FROM px UNION ALL SELECT image_id, image_id * 8 + 4, y, x, b, r, g, a // 2 FROM px), {S.labs('b')}, {S.nearest('lab', 'c64')}
SELECT image_id sprite_id, CASE WHEN image_id % 4 = 2 THEN 'already-indexed' END reason, CASE WHEN image_id % 4 <> 2 THEN cel_id END cel_id, CASE WHEN image_id % 4 <> 2 THEN count(*) END pixels,
  CASE WHEN image_id % 4 <> 2 THEN sum(CASE WHEN a = 0 THEN 0 ELSE (i + 1) * (y * 64 + x + 1) END)::BIGINT END placed FROM near GROUP BY image_id, near.cel_id, image_id % 4 HAVING image_id % 4 <> 2 OR near.cel_id % 8 = 1""")
def indexed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents converted to indices of sixteen colours: two buffers that several raster layers show; one of tile grids stays. Every fourth is indexed already."""
    sprites, layers, cels, px = grouped_sprites(spark, d)
    sprites = sprites.select("sprite_id", F.when(F.col("sprite_id") % 4 == 2, "indexed").otherwise("rgba").alias("mode"))
    own = layers.withColumns({"kind": F.when(F.col("layer_id").isin(3, 7), "tilemap").otherwise(F.col("kind")), "layer_id": F.col("sprite_id") * 10 + F.col("layer_id")})
    outcome, buffers, _ = N.converted_documents(sprites, own, cels.withColumn("layer_id", F.col("sprite_id") * 10 + F.col("layer_id")), px, colors("c64"))
    sums = buffers.groupBy("cel_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("i").cast("long") * (F.col("y") * SIDE + F.col("x") + 1)).alias("placed"))
    return outcome.select("sprite_id", "reason").join(sums.withColumn("sprite_id", F.floor(F.col("cel_id") / 8)), "sprite_id", "left")


_C64 = ", ".join(f"({i + 1}, {c[0]}, {c[1]}, {c[2]})" for i, c in enumerate(colors("c64")))


@query(f"""WITH {PIXELS}, {S.labs('px')}, {S.nearest('lab', 'c64')}, pal(k, pr, pg, pb) AS (VALUES {_C64}), n AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE i + 1 END::INT raw, (CASE WHEN a = 0 THEN 0 ELSE i + 1 END + x % 3 * 8)::INT shown FROM near)
SELECT image_id, y, x, raw, shown, coalesce(pr, 0) r, coalesce(pg, 0) g, coalesce(pb, 0) b, CASE WHEN pr IS NULL THEN 0 ELSE 255 END a FROM n LEFT JOIN pal ON k = shown""")
def indexed_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels as indices, and shifted indices, some beyond the palette, as pixels."""
    raw = N.to_indexed(pixels(spark, d), colors("c64")).select("image_id", "y", "x", F.col("i").alias("raw"), (F.col("i") + F.col("x") % 3 * 8).cast("int").alias("i"))
    return N.from_indexed(raw, colors("c64")).withColumnRenamed("i", "shown")


@query(f"""WITH {PIXELS}, f AS (SELECT image_id // 5 sprite_id, image_id % 5 frame, y, x, r, g, b, a FROM px), n AS (SELECT sprite_id, greatest(1, least(3, max(frame) + 1)) c FROM f GROUP BY 1)
SELECT sprite_id, ((y + (frame // c) * 64) * 2 + j)::INT y, ((x + (frame % c) * 64) * 2 + i)::INT x, r, g, b, a FROM f JOIN n USING (sprite_id), range(2) _(i), range(2) __(j)""")
def sheets(spark: SparkSession, d: str) -> DataFrame:
    """Five frames a sprite on sheets of three columns, twice as large."""
    px = pixels(spark, d)
    frames = px.select(F.floor(F.col("image_id") / 5).alias("sprite_id"), (F.col("image_id") % 5).alias("frame"), "y", "x", "r", "g", "b", "a")
    return X.scale_nearest(X.sheet(frames, 3, SIDE, SIDE), 2)


@query("""WITH f AS (SELECT o_custkey s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 f, greatest(o_orderkey % 120, 1) ms FROM orders), n AS (SELECT s, count(*) n, greatest(1, least(s % 4 + 1, count(*))) c FROM f GROUP BY 1),
e AS (SELECT f.s, f, {'filename': 'sprite' || f.s || ' ' || f || '.png', 'frame': {'x': ((f % c) * 32)::INT, 'y': ((f // c) * 48)::INT, 'w': 32, 'h': 48}, 'rotated': false, 'trimmed': false,
  'spriteSourceSize': {'x': 0, 'y': 0, 'w': 32, 'h': 48}, 'sourceSize': {'w': 32, 'h': 48}, 'duration': ms} e FROM f JOIN n ON f.s = n.s),
g AS (SELECT s, list(e ORDER BY f) frames FROM e GROUP BY 1), t AS (SELECT s, 'all' AS name, 0 AS "from", (n - 1)::INT AS "to", 'forward' AS direction FROM n WHERE s % 2 = 0)
SELECT g.s sprite_id, to_json({'frames': frames, 'meta': {'image': 'sprite' || g.s || '.png', 'format': 'RGBA8888', 'size': {'w': (c * 32)::INT, 'h': (((n + c - 1) // c) * 48)::INT}, 'scale': '2',
  'frameTags': CASE WHEN t.s IS NULL THEN [] ELSE [{'name': t.name, 'from': t."from", 'to': t."to", 'direction': t.direction}] END}})::VARCHAR AS json FROM g JOIN n ON g.s = n.s LEFT JOIN t ON t.s = g.s""")
def sheet_json(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of a sheet per customer, a frame per order."""
    from pyspark.sql import Window

    o = spark.read.parquet(f"{d}/orders.parquet")
    place = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    frames = o.select(F.col("o_custkey").alias("sprite_id"), place.alias("frame"), F.greatest(F.col("o_orderkey") % 120, F.lit(1)).alias("ms"))
    sprites = o.select(F.col("o_custkey").alias("sprite_id")).distinct().select("sprite_id", F.format_string("sprite%d", "sprite_id").alias("stem"), (F.col("sprite_id") % 4 + 1).alias("columns"), F.lit(16).alias("width"), F.lit(24).alias("height"), F.lit(2).alias("scale"))
    counts = frames.groupBy("sprite_id").agg(F.count(F.lit(1)).alias("frames")).where("sprite_id % 2 = 0").withColumns({"name": F.lit("all"), "lo": F.lit(0), "hi": F.lit(1 << 20), "direction": F.lit("forward")})
    tags = X.rebased_tags(counts).select("sprite_id", "name", "from", F.col("to").cast("int").alias("to"), "direction")
    return X.sheet_metadata(sprites, frames, tags)


@query("""WITH g AS (SELECT l_suppkey % 10 map_id, l_orderkey // 4 % 12 row, l_linenumber - 1 col, max(l_partkey % 50) tile, max(l_orderkey % 2) h FROM lineitem GROUP BY ALL),
i AS (SELECT map_id, row, col, CASE WHEN tile = 0 THEN 0 ELSE tile + h * 2147483648 END::BIGINT gid FROM g),
m AS (SELECT map_id, list(gid ORDER BY row, col) d, (max(col) + 1)::INT w, (max(row) + 1)::INT h FROM i GROUP BY 1)
SELECT map_id::INT map_id, to_json({'width': w, 'height': h, 'tilewidth': 8, 'tileheight': 6, 'layers': [{'data': d, 'width': w, 'height': h, 'type': 'tilelayer'}],
  'tilesets': [{'firstgid': 1, 'tilecount': 50, 'columns': 50, 'tilewidth': 8, 'tileheight': 6, 'imagewidth': 400, 'imageheight': 6}]})::VARCHAR AS json FROM m""")
def map_files(spark: SparkSession, d: str) -> DataFrame:
    """Grids of tile ids with flips, as map files."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    g = li.groupBy((F.col("l_suppkey") % 10).cast("int").alias("map_id"), (F.floor(F.col("l_orderkey") / 4) % 12).cast("int").alias("row"), (F.col("l_linenumber") - 1).cast("int").alias("col"))
    g = g.agg(F.max(F.col("l_partkey") % 50).alias("tile"), (F.max(F.col("l_orderkey") % 2) == 1).alias("h"))
    grids = g.select("map_id", "row", "col", X.tile_gid(F.col("tile"), F.col("h"), F.lit(False), F.lit(False)).alias("gid"))
    return X.map_json(grids, (8, 6), grids.select("map_id", F.lit(50).alias("tiles")).distinct())


@query(f"""WITH {PIXELS}, r AS (SELECT DISTINCT image_id, t::INT tile, (t * 13 - 5)::INT x0, ((image_id + t * 17) % 58)::INT y0 FROM px, range(6) _(t)), s AS (SELECT image_id, max(x) + 1 w, max(y) + 1 h FROM px GROUP BY 1),
k AS (SELECT r.* FROM r JOIN s USING (image_id) WHERE x0 >= 0 AND x0 + 8 <= w AND y0 + 8 <= h)
SELECT image_id, (y - y0)::INT y, (tile * 8 + x - x0)::INT x, r, g, b, a FROM px JOIN k USING (image_id) WHERE x >= x0 AND x < x0 + 8 AND y >= y0 AND y < y0 + 8""")
def tile_atlas(spark: SparkSession, d: str) -> DataFrame:
    """Tiles cut from images, those that leave them left out, side by side."""
    px = pixels(spark, d)
    t = px.select("image_id").distinct().withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(5))))
    rects = t.withColumns({"x0": F.col("tile") * 13 - 5, "y0": ((F.col("image_id") + F.col("tile") * 17) % 58).cast("int"), "w": F.lit(8), "h": F.lit(8)})
    return X.atlas(X.tile_pixels(px, rects), 8)


def _axis_sql(axis: str, across: str) -> str:
    d = " + ".join(f"abs({c} - lag({c}) OVER (PARTITION BY image_id, {across} ORDER BY {axis}))" for c in "rgba")
    return f"""{axis}0 AS (SELECT image_id, {axis} k, {d} d FROM q), {axis}1 AS (SELECT image_id, k, coalesce(sum(d), 0) d FROM {axis}0 GROUP BY ALL), {axis}2 AS (SELECT image_id, avg(d) FILTER (k > 0) m, max(k) + 1 n FROM {axis}1 GROUP BY 1),
{axis}3 AS (SELECT image_id, p, avg(d) / any_value(m) conf FROM {axis}1 JOIN {axis}2 USING (image_id), range(2, 32) _(p) WHERE k > 0 AND m > 0 AND p <= (n - 1) // 2 AND k % p = 0 GROUP BY ALL HAVING count(*) >= 6),
{axis}4 AS (SELECT *, max(conf) OVER (PARTITION BY image_id) top FROM {axis}3), {axis}5 AS (SELECT image_id, min(p) p, arg_min(conf, p) conf FROM {axis}4 WHERE top >= 3 AND conf >= 0.75 * top GROUP BY 1)"""


@query(f"""WITH {PIXELS}, q AS (SELECT image_id, y, x, CASE WHEN image_id % 3 = 0 THEN (x // 5) * 37 % 256 ELSE 0 END r, CASE WHEN image_id % 3 < 2 THEN (y // (4 + image_id % 3)) * 91 % 256 ELSE 0 END g, 0 b, 255 a FROM px), {_axis_sql('x', 'y')}, {_axis_sql('y', 'x')}
SELECT image_id, (CASE WHEN y5.p IS NULL OR x5.conf >= y5.conf THEN x5.p ELSE y5.p END)::INT period, coalesce(x5.p = y5.p, false) agreement FROM x5 FULL JOIN y5 USING (image_id)""")
def grid_decision(spark: SparkSession, d: str) -> DataFrame:
    """The size of enlarged pixels from both axes, of images enlarged along one, along both, or not."""
    px, third = pixels(spark, d), F.col("image_id") % 3
    r = F.when(third == 0, F.floor(F.col("x") / 5) * 37 % 256).otherwise(0)
    g = F.when(third < 2, F.floor(F.col("y") / (4 + third)) * 91 % 256).otherwise(0)
    return R.detect_grid(px.select("image_id", "y", "x", r.cast("int").alias("r"), g.cast("int").alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a")))


@query("""WITH t AS (SELECT p_partkey k, CASE p_partkey % 4 WHEN 0 THEN printf('#%06x', p_partkey * 7919 % 16777216) WHEN 1 THEN printf(' %06X ', p_partkey * 104729 % 16777216) WHEN 2 THEN printf('%05x', p_partkey) ELSE 'x' || p_partkey END t FROM part),
m AS (SELECT k, regexp_extract(trim(t), '^#?([0-9a-fA-F]{6})$', 1) h FROM t)
SELECT k, CASE WHEN h = '' THEN 0 ELSE ('0x' || h[1:2])::INT END r, CASE WHEN h = '' THEN 0 ELSE ('0x' || h[3:4])::INT END g, CASE WHEN h = '' THEN 0 ELSE ('0x' || h[5:6])::INT END b,
  ['#4d9de0', '#e15554', '#3bb273', '#e1b12c', '#7768ae', '#e67e22'][(k % 6 + 1)::INT] tag_color, CASE WHEN k % 3 = 0 THEN floor((k % 90) / 2.0 - (k % 17) / 2.0 + 0.5) ELSE 0 END::INT off FROM m""")
def parsed_colors(spark: SparkSession, d: str) -> DataFrame:
    """Colours from text, the colour of a new tag, and where a new grid starts."""
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{d}/part.parquet")
    text = F.when(k % 4 == 0, F.concat(F.lit("#"), F.lpad(F.lower(F.hex(k * 7919 % 16777216)), 6, "0"))).when(k % 4 == 1, F.concat(F.lit(" "), F.lpad(F.hex(k * 104729 % 16777216), 6, "0"), F.lit(" "))).when(k % 4 == 2, F.format_string("%05x", k)).otherwise(F.concat(F.lit("x"), k.cast("string")))
    r, g, b = C.from_hex(text)
    off, _ = G.default_grid_offset(F.when(k % 3 == 0, "isometric").otherwise("rectangular"), k % 17, k % 90)
    return p.select(k.alias("k"), r.alias("r"), g.alias("g"), b.alias("b"), G.next_tag_color(k).alias("tag_color"), off.alias("off"))


@query("""WITH c AS (SELECT n_regionkey p, n_nationkey, n_nationkey * 9 % 256 || ',' || n_nationkey * 31 % 256 || ',' || n_nationkey * 77 % 256 || ',255' t FROM nation)
SELECT r_regionkey k, CASE WHEN r_regionkey = 0 THEN '-' ELSE 'p' || r_regionkey || ':' || string_agg(t, '|' ORDER BY n_nationkey) END print FROM region JOIN c ON p = r_regionkey GROUP BY r_regionkey""")
def palette_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    n, k = spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey")
    color = F.array(*((k * m % 256).cast("int") for m in (9, 31, 77)), F.lit(255))
    pals = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(k, color.alias("c")))), lambda e: e["c"]).alias("colors"))
    r = F.col("n_regionkey")
    return pals.select(r.alias("k"), N.palette_fingerprint(F.when(r > 0, F.concat(F.lit("p"), r.cast("string"))), F.col("colors")).alias("print"))


@query(f"""WITH RECURSIVE {PIXELS}, q AS (SELECT image_id * 64 + x k, row_number() OVER (PARTITION BY image_id, x ORDER BY y) n, {{'x': ((x + y) // 2)::INT, 'y': ((y * 3 + x) // 4)::INT}} c FROM px), ends AS (SELECT k, max(n) m FROM q GROUP BY 1),
s(k, n, kept) AS (SELECT k, n, [c] FROM q WHERE n = 1 UNION ALL
 SELECT k, n, CASE WHEN b = c THEN kept WHEN a IS NOT NULL AND abs(a.x - c.x) = 1 AND abs(a.y - c.y) = 1 AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND abs(c.x - b.x) + abs(c.y - b.y) = 1 THEN list_append(kept[:len(kept) - 1], c) ELSE list_append(kept, c) END
 FROM (SELECT q.k, q.n, q.c, s.kept, s.kept[len(s.kept)] b, CASE WHEN len(s.kept) > 1 THEN s.kept[len(s.kept) - 1] END a FROM s JOIN q ON q.k = s.k AND q.n = s.n + 1))
SELECT k image_id, (unnest(range(len(kept))))::INT n, unnest(kept).x x, unnest(kept).y y FROM s JOIN ends USING (k) WHERE s.n = m""")
def pixel_perfect_strokes(spark: SparkSession, d: str) -> DataFrame:
    """Strokes of orders' places, one through each column of an image, without the corners that a fold over them finds redundant."""
    px = pixels(spark, d).withColumn("image_id", F.col("image_id") * SIDE + F.col("x"))
    strokes = px.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x"))), lambda p: F.struct(((p["x"] + p["y"]) / 2).cast("int").alias("x"), ((p["y"] * 3 + p["x"]) / 4).cast("int").alias("y"))).alias("points"))
    return strokes.select("image_id", F.posexplode(G.without_corners(F.col("points"))).alias("n", "p")).select("image_id", "n", "p.x", "p.y")
