"""Queries over tile grids, layer trees, selections and deltas."""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import kernels as K
from rasterloom.operators import tilemaps as M
from rasterloom.operators import trees as T
from rasterloom.registry import query
from rasterloom.sources.rasters import PIXELS, SIDE, pixels

_TILE, _CANVAS, _ISO_X = 4, 40, 14
_CELLS = """c AS (SELECT o_orderkey // 64 image_id, (o_orderkey % 8)::INT col, (o_orderkey // 8 % 8)::INT rw, o_custkey % 12 tile, o_custkey // 12 % 2 h, o_custkey // 24 % 2 v, o_custkey // 48 % 2 t FROM orders),
tp AS (SELECT t.t tile, y.y ty, x.x tx, (t.t * 37 + x.x * 50) % 256 r, (t.t * 11 + y.y * 60) % 256 g, (x.x * y.y * 9 + t.t) % 256 b, CASE (t.t + x.x + y.y) % 3 WHEN 0 THEN 0 WHEN 1 THEN 128 ELSE 255 END a FROM range(11) t(t), range(4) y(y), range(4) x(x)),
p AS (SELECT image_id, col, rw, CASE WHEN h = 1 THEN 3 - (CASE WHEN t = 1 THEN ty ELSE tx END) ELSE CASE WHEN t = 1 THEN ty ELSE tx END END x, CASE WHEN v = 1 THEN 3 - (CASE WHEN t = 1 THEN tx ELSE ty END) ELSE CASE WHEN t = 1 THEN tx ELSE ty END END y, r, g, b, a
  FROM c JOIN tp USING (tile) WHERE tile + h + v + t > 0)"""


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bit = lambda n: F.floor(c / n) % 2
    cells = spark.read.parquet(f"{d}/orders.parquet").select(
        F.floor(k / 64).alias("image_id"), (k % 8).cast("int").alias("col"), (F.floor(k / 8) % 8).cast("int").alias("row"), G.pack_tile(c % 12, bit(12), bit(24), bit(48)).alias("packed")
    )
    i, n = F.col("id"), _TILE * _TILE
    t = spark.range(11 * n).select(F.floor(i / n).alias("tile"), (F.floor(i / _TILE) % _TILE).alias("ty"), (i % _TILE).alias("tx"))
    r, g, b = (F.col("tile") * 37 + F.col("tx") * 50) % 256, (F.col("tile") * 11 + F.col("ty") * 60) % 256, (F.col("tx") * F.col("ty") * 9 + F.col("tile")) % 256
    three = (F.col("tile") + F.col("tx") + F.col("ty")) % 3
    return cells, t.select("tile", "ty", "tx", r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), F.when(three == 0, 0).when(three == 1, 128).otherwise(255).alias("a"))


def _stacked(x: str, y: str, first: str, second: str) -> str:
    """Drawn pixels in layers, folded: a place has two at most, a third is folded to be sure."""
    out = f"""s AS (SELECT image_id, {y} y, {x} x, row_number() OVER (PARTITION BY image_id, {y}, {x} ORDER BY {first}, {second}) k, r, g, b, a FROM p WHERE a > 0 AND {x} BETWEEN 0 AND {_CANVAS - 1} AND {y} BETWEEN 0 AND {_CANVAS - 1}),
f0 AS (SELECT image_id, y, x, {", ".join(f"max(CASE WHEN k = {n + 1} THEN {c} END) {c}{n}" for n in range(3) for c in "rgba")}, 0 cr, 0 cg, 0 cb, 0 ca FROM s GROUP BY ALL)"""
    for n in range(3):
        sa, da = f"(a{n} / 255.0::DOUBLE)", "(ca / 255.0::DOUBLE)"
        o = f"({sa} + {da} * (1 - {sa}))"
        ch = ", ".join(f"CASE WHEN a{n} IS NULL THEN c{c} ELSE floor(({c}{n} * {sa} + c{c} * {da} * (1 - {sa})) / {o} + 0.5) END::INT AS c{c}" for c in "rgb")
        out += f", f{n + 1} AS (SELECT * REPLACE ({ch}, CASE WHEN a{n} IS NULL THEN ca ELSE floor({o} * 255 + 0.5) END::INT AS ca) FROM f{n})"
    return f"WITH {_CELLS}, {out} SELECT image_id, y::INT y, x::INT x, cr r, cg g, cb b, ca a FROM f3"


@query(f"WITH {_CELLS} SELECT image_id, (rw * 4 + y)::INT y, (col * 4 + x)::INT x, r::INT r, g::INT g, b::INT b, a FROM p")
def tilemap_rect(spark: SparkSession, d: str) -> DataFrame:
    return M.render_tilemap(*_cells(spark, d), "rect", _TILE, _TILE, _CANVAS, _CANVAS)


@query(_stacked(f"({_ISO_X} + (col - rw) * 2 + x)", "((col + rw) * 2 + y)", "col + rw", "col"))
def tilemap_isometric(spark: SparkSession, d: str) -> DataFrame:
    return M.render_tilemap(*_cells(spark, d), "isometric", _TILE, _TILE, _CANVAS, _CANVAS, ox=_ISO_X)


@query(_stacked("(col * 4 + rw % 2 * 2 + x)", "(rw * 3 + y)", "rw", "col"))
def tilemap_hexagonal(spark: SparkSession, d: str) -> DataFrame:
    return M.render_tilemap(*_cells(spark, d), "hexagonal", _TILE, _TILE, _CANVAS, _CANVAS)


@query("""SELECT l_orderkey k, l_linenumber n, (l_partkey % 1000 + (l_suppkey % 2) * 268435456 + (l_orderkey % 2) * 536870912 + (l_linenumber % 2) * 1073741824)::BIGINT packed FROM lineitem""")
def tile_translation(spark: SparkSession, d: str) -> DataFrame:
    """Tile numbers with a file's own bits (28 index bits, across 31, down 30, diagonal 29) -> packed ids."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    on = lambda c, k: (F.col(c) % 2).cast("long") * F.lit(1 << k)
    raw = (F.col("l_partkey") % 1000).cast("long") + on("l_suppkey", 31) + on("l_orderkey", 30) + on("l_linenumber", 29)
    masks = [F.lit(m).cast("long") for m in ((1 << 28) - 1, 1 << 31, 1 << 30, 1 << 29)]
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), M.translate_tile(raw, *masks).alias("packed"))


@query(f"""WITH {PIXELS}, v AS (SELECT t, t * 64 // 256 s FROM range(256) r(t)), h AS (SELECT t, t * 64 // 256 s FROM range(256) r(t))
SELECT image_id, v.t::INT y, h.t::INT x, r, g, b, a FROM px JOIN v ON v.s = px.y JOIN h ON h.s = px.x""")
def thumbnails(spark: SparkSession, d: str) -> DataFrame:
    return M.thumbnail(pixels(spark, d), SIDE, SIDE)


_ANGLE, _SCALE = 0.5, 1.3
_AT = f"(x.x - 32.0::DOUBLE) * ({math.cos(_ANGLE)!r}::DOUBLE) - (y.y - 32.0::DOUBLE) * ({math.sin(_ANGLE)!r}::DOUBLE)", f"(x.x - 32.0::DOUBLE) * ({math.sin(_ANGLE)!r}::DOUBLE) + (y.y - 32.0::DOUBLE) * ({math.cos(_ANGLE)!r}::DOUBLE)"


def _alike(p: str, q: str) -> str:
    return f"(({' AND '.join(f'abs({p}{c} - {q}{c}) <= {K.SIMILAR!r}::DOUBLE' for c in 'rgba')}) OR ({p}a = 0 AND {q}a = 0))"


@query(f"""WITH {PIXELS}, t AS (SELECT i.image_id, y.y::INT y, x.x::INT x, 32 + ({_AT[0]}) / {_SCALE}::DOUBLE sx, 32 + ({_AT[1]}) / {_SCALE}::DOUBLE sy FROM (SELECT DISTINCT image_id FROM px) i, range(64) y(y), range(64) x(x)),
n AS (SELECT *, floor(sx + 0.5)::INT nx, floor(sy + 0.5)::INT ny, sx - floor(sx + 0.5) lx, sy - floor(sy + 0.5) ly FROM t),
q AS MATERIALIZED (SELECT *, nx + CASE WHEN lx >= 0 THEN 1 ELSE -1 END qx, ny + CASE WHEN ly >= 0 THEN 1 ELSE -1 END qy FROM n),
w AS (SELECT q.*, {", ".join(f"coalesce({s}.{c}, 0) {s}{c}" for s in "cfde" for c in "rgba")} FROM q LEFT JOIN px c ON c.image_id = q.image_id AND c.y = ny AND c.x = nx LEFT JOIN px f ON f.image_id = q.image_id AND f.y = ny AND f.x = qx
  LEFT JOIN px d ON d.image_id = q.image_id AND d.y = qy AND d.x = nx LEFT JOIN px e ON e.image_id = q.image_id AND e.y = qy AND e.x = qx),
v AS (SELECT *, CASE WHEN (lx = 0 AND ly = 0) OR NOT {_alike('f', 'd')} OR (NOT {_alike('c', 'f')} AND NOT {_alike('c', 'd')} AND {_alike('c', 'e')}) OR abs(lx) = abs(ly) THEN 0 WHEN abs(lx) > abs(ly) THEN 1 ELSE 2 END k FROM w)
SELECT image_id, y, x, {", ".join(f"(CASE k WHEN 0 THEN c{c} WHEN 1 THEN f{c} ELSE d{c} END)::INT {c}" for c in "rgba")} FROM v""")
def rotated_scaled(spark: SparkSession, d: str) -> DataFrame:
    return K.clean_edge(pixels(spark, d), SIDE, SIDE, _ANGLE, _SCALE)


_LAYERS = """l AS (SELECT p_partkey // 12 sprite_id, p_partkey layer_id, CASE WHEN p_partkey % 12 < 3 OR p_partkey % 12 % 5 = 4 THEN NULL ELSE p_partkey // 12 * 12 + (p_partkey % 12 - 1) // 3 * 3 END parent_id,
  CASE WHEN p_partkey % 12 % 3 = 0 THEN 'group' ELSE 'raster' END kind, ((p_size % 7) * 100 + p_partkey % 12)::INT z FROM part), s AS (SELECT DISTINCT sprite_id FROM l)"""


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Layers and their documents."""
    k = F.col("p_partkey").cast("long")
    n, doc = k % 12, F.floor(k / 12)
    parent = F.when((n < 3) | (n % 5 == 4), F.lit(None)).otherwise(doc * 12 + F.floor((n - 1) / 3) * 3)
    layers = spark.read.parquet(f"{d}/part.parquet").select(
        doc.alias("sprite_id"), k.alias("layer_id"), parent.cast("long").alias("parent_id"), F.when(n % 3 == 0, "group").otherwise("raster").alias("kind"), ((F.col("p_size") % 7) * 100 + n).cast("int").alias("z")
    )
    return layers, layers.select("sprite_id").distinct()


@query(f"""WITH RECURSIVE {_LAYERS}, e AS (SELECT sprite_id, sprite_id * 12 + sprite_id % 12 layer_id, CASE WHEN sprite_id % 4 = 3 THEN NULL ELSE sprite_id * 12 + (sprite_id * 5 % 4) * 3 END target FROM s),
u AS (SELECT sprite_id, target up FROM e WHERE target IS NOT NULL UNION SELECT u.sprite_id, l.parent_id FROM u JOIN l ON l.layer_id = u.up WHERE l.parent_id IS NOT NULL),
ok AS (SELECT e.* FROM e JOIN l USING (layer_id) LEFT JOIN l g ON g.layer_id = e.target LEFT JOIN u ON u.sprite_id = e.sprite_id AND u.up = e.layer_id WHERE e.target IS DISTINCT FROM l.parent_id AND (e.target IS NULL OR (g.kind = 'group' AND u.up IS NULL)))
SELECT l.sprite_id, l.layer_id, CASE WHEN ok.layer_id IS NULL THEN l.parent_id ELSE ok.target END parent_id, l.kind, l.z FROM l LEFT JOIN ok ON ok.layer_id = l.layer_id""")
def layers_reparented(spark: SparkSession, d: str) -> DataFrame:
    layers, docs = _layers(spark, d)
    s = F.col("sprite_id")
    return T.reparent(layers, docs.select("sprite_id", (s * 12 + s % 12).alias("layer_id"), F.when(s % 4 != 3, s * 12 + (s * 5 % 4) * 3).alias("target")))


@query(f"""WITH RECURSIVE {_LAYERS}, w AS (SELECT sprite_id, layer_id FROM l WHERE layer_id = sprite_id * 12 + sprite_id % 12 UNION SELECT l.sprite_id, l.layer_id FROM w JOIN l ON l.parent_id = w.layer_id),
n AS (SELECT sprite_id FROM l LEFT JOIN w USING (sprite_id, layer_id) GROUP BY 1 HAVING count(w.layer_id) < count(*)) SELECT l.* FROM l ANTI JOIN (SELECT * FROM w WHERE sprite_id IN (FROM n)) g USING (sprite_id, layer_id)""")
def layers_deleted(spark: SparkSession, d: str) -> DataFrame:
    layers, docs = _layers(spark, d)
    return T.delete_cascade(layers, docs.select("sprite_id", (F.col("sprite_id") * 12 + F.col("sprite_id") % 12).alias("layer_id")))


@query(f"""WITH {_LAYERS}, g AS (SELECT * FROM l WHERE kind = 'group' AND layer_id = sprite_id * 12 + sprite_id % 5 * 3)
SELECT l.sprite_id, l.layer_id, CASE WHEN g.layer_id IS NULL THEN l.parent_id ELSE g.parent_id END parent_id, l.kind, l.z FROM l LEFT JOIN g ON g.layer_id = l.parent_id WHERE l.layer_id NOT IN (SELECT layer_id FROM g)""")
def layers_ungrouped(spark: SparkSession, d: str) -> DataFrame:
    layers, docs = _layers(spark, d)
    return T.ungroup(layers, docs.select("sprite_id", (F.col("sprite_id") * 12 + F.col("sprite_id") % 5 * 3).alias("layer_id")))


@query(f"""WITH {_LAYERS}, n AS (SELECT *, row_number() OVER (PARTITION BY sprite_id ORDER BY z, layer_id) - 1 place, row_number() OVER (PARTITION BY sprite_id, parent_id ORDER BY z, layer_id) k FROM l),
m AS (SELECT a.sprite_id, a.place f, b.place t FROM n a JOIN n b ON a.sprite_id = b.sprite_id AND a.parent_id IS NOT DISTINCT FROM b.parent_id AND b.k = a.k + a.sprite_id % 5 - 2 WHERE a.layer_id = a.sprite_id * 12 + a.sprite_id % 12)
SELECT n.sprite_id, layer_id, parent_id, kind, (CASE WHEN f IS NULL THEN place WHEN place = f THEN t WHEN place > f AND place <= t THEN place - 1 WHEN place < f AND place >= t THEN place + 1 ELSE place END)::INT z FROM n LEFT JOIN m USING (sprite_id)""")
def layers_moved(spark: SparkSession, d: str) -> DataFrame:
    layers, docs = _layers(spark, d)
    s = F.col("sprite_id")
    return T.move_among_siblings(layers, docs.select("sprite_id", (s * 12 + s % 12).alias("layer_id"), (s % 5 - 2).alias("delta")))


@query("""WITH c AS (SELECT o_orderkey cel_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 3 END linked_to, o_custkey % 4 = 0 gone FROM orders)
SELECT cel_id FROM c WHERE gone AND linked_to IS NULL AND cel_id NOT IN (SELECT linked_to FROM c WHERE NOT gone AND linked_to IS NOT NULL)""")
def cels_released(spark: SparkSession, d: str) -> DataFrame:
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    return T.released_cels(o.select(k.alias("cel_id"), F.when(k % 5 == 0, k - 3).alias("linked_to")), o.where("o_custkey % 4 = 0").select(k.alias("cel_id")))


_SEED = 32


@query(f"""WITH RECURSIVE {PIXELS}, m AS (SELECT image_id, y, x, r < 180 k FROM px), e AS (SELECT image_id, k FROM m WHERE y = {_SEED} AND x = {_SEED}), n AS (SELECT m.* FROM m JOIN e USING (image_id, k)),
w AS (SELECT image_id, y, x FROM n WHERE y = {_SEED} AND x = {_SEED} UNION SELECT n.image_id, n.y, n.x FROM w CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) JOIN n ON n.image_id = w.image_id AND n.y = w.y + dy AND n.x = w.x + dx)
SELECT image_id, y, x, (CASE WHEN w.x IS NULL THEN (CASE WHEN k THEN 1 ELSE 0 END) ELSE 9 END)::INT r FROM m LEFT JOIN w USING (image_id, y, x)""")
def contiguous_fill(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0)
    two = pixels(spark, d).select("image_id", "y", "x", (F.col("r") < 180).cast("int").alias("r"), zero.alias("g"), zero.alias("b"), zero.alias("a"))
    return K.fill(two, _SEED, _SEED, (9, 9, 9, 255)).select("image_id", "y", "x", "r")


@query("""WITH d AS (SELECT l_suppkey cel, l_partkey % 50 place, l_orderkey * 10 + l_linenumber seq, l_quantity before, l_extendedprice after FROM lineitem)
SELECT cel, place, min({'s': seq, 'v': before}).v before, max({'s': seq, 'v': after}).v after FROM d GROUP BY ALL""")
def merged_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of a cel as one: what was there before the oldest, and what the newest left."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return li.groupBy(F.col("l_suppkey").alias("cel"), (F.col("l_partkey") % 50).alias("place")).agg(F.min(F.struct("seq", "l_quantity"))["l_quantity"].alias("before"), F.max(F.struct("seq", "l_extendedprice"))["l_extendedprice"].alias("after"))


@query(f"""WITH {PIXELS}, s AS (SELECT * REPLACE (CASE WHEN (x - 30) * (x - 30) + (y - 25) * (y - 25) < 150 + image_id % 100 AND image_id % 7 <> 3 THEN a ELSE 0 END AS a) FROM px),
box AS (SELECT *, min(CASE WHEN a >= 128 THEN x END) OVER w x0, max(CASE WHEN a >= 128 THEN x END) OVER w x1, min(CASE WHEN a >= 128 THEN y END) OVER w y0, max(CASE WHEN a >= 128 THEN y END) OVER w y1 FROM s WINDOW w AS (PARTITION BY image_id))
SELECT image_id, (y - coalesce(greatest(0, y0 - 2), 0))::INT y, (x - coalesce(greatest(0, x0 - 2), 0))::INT x, a FROM box WHERE x0 IS NULL OR (x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2)""")
def fitted_to_subject(spark: SparkSession, d: str) -> DataFrame:
    """Each image cut to its opaque pixels and two around, inside the image; without any it stays."""
    px, x, y = pixels(spark, d), F.col("x"), F.col("y")
    near = ((x - 30) * (x - 30) + (y - 25) * (y - 25) < 150 + F.col("image_id") % 100) & (F.col("image_id") % 7 != 3)
    px = px.withColumn("a", F.when(near, F.col("a")).otherwise(0))
    image = Window.partitionBy("image_id")
    bound = lambda f, c: f(F.when(F.col("a") >= 128, F.col(c))).over(image)
    px = px.withColumns({"x0": bound(F.min, "x") - 2, "x1": bound(F.max, "x") + 2, "y0": bound(F.min, "y") - 2, "y1": bound(F.max, "y") + 2})
    out = px.where(F.col("x0").isNull() | (x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1"))))
    start = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    return out.select("image_id", (y - start("y0")).cast("int").alias("y"), (x - start("x0")).cast("int").alias("x"), "a")


@query(f"""WITH {_LAYERS}, e AS (SELECT sprite_id, sprite_id * 12 + sprite_id % 13 layer_id, 1000000 + sprite_id group_id, sprite_id % 2 = 0 wrap FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY sprite_id ORDER BY z, layer_id) - 1 n FROM l), g AS (SELECT e.*, r.parent_id up, coalesce(r.n, -1) n0 FROM e LEFT JOIN r ON r.sprite_id = e.sprite_id AND r.layer_id = e.layer_id WHERE NOT wrap OR r.n IS NOT NULL)
SELECT r.sprite_id, r.layer_id, CASE WHEN g.wrap AND g.layer_id = r.layer_id THEN g.group_id ELSE r.parent_id END parent_id, CASE WHEN r.layer_id % 5 = 0 THEN 'other' ELSE r.kind END kind, (n + CASE WHEN n > n0 THEN 1 ELSE 0 END)::INT z FROM r LEFT JOIN g USING (sprite_id)
UNION ALL SELECT sprite_id, group_id, up, 'group', (n0 + 1)::INT FROM g""")
def layers_grouped(spark: SparkSession, d: str) -> DataFrame:
    """A new group in each document, around a layer or beside it, and another kind for some layers."""
    layers, docs = _layers(spark, d)
    s = F.col("sprite_id")
    other = layers.where("layer_id % 5 = 0").select("sprite_id", "layer_id", F.lit("other").alias("kind"))
    edits = docs.select("sprite_id", (s * 12 + s % 13).alias("layer_id"), (s + 1000000).alias("group_id"), (s % 2 == 0).alias("wrap"))
    return T.add_groups(T.with_properties(layers, other), edits)
