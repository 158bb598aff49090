"""Queries over generated images, rotation, sampling, charts, stamps and small parts of imports."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import chart as H
from rasterloom.operators import commands as E
from rasterloom.operators import compose as K
from rasterloom.operators import documents as D
from rasterloom.operators import raster as R
from rasterloom.operators import rotate as O
from rasterloom.operators import shapes as W
from rasterloom.operators import tilemaps as T
from rasterloom.plans import sql as S
from rasterloom.plans.library import FLATTENED, grouped_sprites
from rasterloom.registry import query
from rasterloom.sources import archives as A
from rasterloom.sources import generated as N
from rasterloom.sources import images as I
from rasterloom.sources import layered as L
from rasterloom.sources import palettes as P
from rasterloom.sources.rasters import PIXELS, SIDE, pixels
from rasterloom.tables import dealt, settled


def _draw(name: str, n: str) -> str:
    """CTEs that add d, the number of a place in the stream of an image's seed, to its places."""
    low, times = "4294967296", lambda a, b: f"((({a})::HUGEINT * ({b})::HUGEINT) % 4294967296)::BIGINT"
    k = name.replace("-", "_")
    return f"""{k}_a AS (SELECT *, ({N.SEEDS[name]}::BIGINT + ({n} + 1) * {N.STEP}::BIGINT) % {low} s FROM place WHERE image = '{name}'),
{k}_b AS (SELECT *, {times("xor(s, s >> 15)", "s | 1")} t FROM {k}_a), {k}_c AS (SELECT *, xor(t, (t + {times("xor(t, t >> 7)", "t | 61")}) % {low}) e FROM {k}_b),
{k} AS (SELECT *, xor(e, e >> 14) / {low}::DOUBLE d FROM {k}_c)"""


def _list(colors: list, k: int) -> str:
    return "[" + ", ".join(str(c[k]) for c in colors) + "]"


_SIZES = ", ".join(f"('{n}', {w}, {h})" for n, (w, h) in N.SIZES.items())
_SHADE = "(0.35::DOUBLE + 0.65::DOUBLE * pow(greatest(0::DOUBLE, 1 - sqrt(pow(x / 96::DOUBLE - 0.5, 2) * 1.8::DOUBLE + pow(y / 128::DOUBLE - 0.42::DOUBLE, 2)) * 2.4::DOUBLE), 0.7::DOUBLE))"
_SUN = "greatest(0::DOUBLE, 1 - sqrt(pow(x / 128::DOUBLE - 0.72::DOUBLE, 2) + pow(y / 52::DOUBLE - 0.25::DOUBLE, 2)) * 3.2::DOUBLE)"
_DISC = "sqrt(pow(x / 96::DOUBLE - 0.38::DOUBLE, 2) + pow(y / 96::DOUBLE - 0.4::DOUBLE, 2)) < 0.26::DOUBLE"
_FLAT = f"CASE WHEN {_DISC} THEN 3 WHEN x / 96::DOUBLE + y / 96::DOUBLE > 1.35::DOUBLE THEN 5 WHEN y / 96::DOUBLE > 0.72::DOUBLE THEN 2 WHEN x / 96::DOUBLE > 0.7::DOUBLE AND y / 96::DOUBLE < 0.3::DOUBLE THEN 4 ELSE 1 END"
_SOFT = "greatest(0::DOUBLE, least(1::DOUBLE, (0.36::DOUBLE - sqrt(pow(x / 96::DOUBLE - 0.5::DOUBLE, 2) + pow(y / 96::DOUBLE - 0.5::DOUBLE, 2))) / 0.08::DOUBLE)) * 255"
_DRAWN = ["................", "................", "...1111111111...", "...1255555521...", "...1222222221...", "...1221221221...", "...1221221221...", "...1222222221...", "...1222222221...", "...1223333221...", "...1222222221...", "...1111111111..."] + ["....44444444...."] * 4
_KEYS = "".join(_DRAWN).replace(".", "0")


@query(f"""WITH size(image, w, h) AS (VALUES {_SIZES}), place AS (SELECT image, y::INT y, x::INT x FROM size, range(128) _(y), range(128) _(x) WHERE x < w AND y < h),
{_draw('photo-portrait', 'y * 96 + x')}, {_draw('photo-landscape', 'greatest(y - 52, 0) * 128 + x')},
v AS (SELECT image, y, x, 228 * {_SHADE} + (d - 0.5) * 14 + 18 * (1 - {_SHADE}) r, 176 * {_SHADE} + (d - 0.5) * 14 + 26 * (1 - {_SHADE}) g, 150 * {_SHADE} + (d - 0.5) * 14 + 44 * (1 - {_SHADE}) b, 255::DOUBLE a FROM photo_portrait
UNION ALL SELECT image, y, x, CASE WHEN y < 52 THEN 60 + 150 * (y / 52::DOUBLE) + 190 * {_SUN} ELSE 70 + 60 * ((y - 52) / 44::DOUBLE) + (d - 0.5) * 34 END,
  CASE WHEN y < 52 THEN 110 + 110 * (y / 52::DOUBLE) + 160 * {_SUN} ELSE 95 + 70 * ((y - 52) / 44::DOUBLE) + (d - 0.5) * 34 END, CASE WHEN y < 52 THEN 200 - 30 * (y / 52::DOUBLE) + 90 * {_SUN} ELSE 48 + 30 * ((y - 52) / 44::DOUBLE) + (d - 0.5) * 34 END, 255 FROM photo_landscape
UNION ALL SELECT image, y, x, {', '.join(f'{_list(N.FLAT, k)}[{_FLAT}]' for k in range(3))}, 255 FROM place WHERE image = 'flat-illustration'
UNION ALL SELECT image, y, x, {', '.join(f"{_list(N.SPRITE, k)}[substr('{_KEYS}', y // 8 * 16 + x // 8 + 1, 1)::INT + 1]" for k in range(4))} FROM place WHERE image = 'pixel-art'
UNION ALL SELECT image, y, x, CASE WHEN {_SOFT} > 0 THEN 245 ELSE 0 END, CASE WHEN {_SOFT} > 0 THEN 120 ELSE 255 END, CASE WHEN {_SOFT} > 0 THEN 40 ELSE 0 END, {_SOFT} FROM place WHERE image = 'alpha'
UNION ALL SELECT image, y, x, c, c, c, 255 FROM (SELECT *, CASE WHEN CASE WHEN y > 67 THEN x // 2 % 2 = 0 ELSE (x // 3 + y // 3) % 2 = 0 END THEN 255 ELSE 0 END c FROM place WHERE image = 'high-contrast')
UNION ALL SELECT image, y, x, 255 * (x / 127::DOUBLE), 255 * (y / 63::DOUBLE), 255 * (1 - (x / 127::DOUBLE) * (y / 63::DOUBLE)), 255 FROM place WHERE image = 'gradient'),
gold AS (SELECT image, y, x, {', '.join(f'greatest(0, least(255, floor({c} + 0.5)))::INT {c}' for c in 'rgba')} FROM v), {PIXELS}
SELECT image, image_id, count(*) compared, {', '.join(f'sum(abs(gold.{c} - px.{c}))::BIGINT {c}' for c in 'rgba')} FROM gold JOIN px ON gold.y = px.y AND gold.x = px.x GROUP BY ALL""")
def golden_images(spark: SparkSession, d: str) -> DataFrame:
    """How far every derived image is from each of the seven synthetic ones, channel by channel, where both have pixels."""
    gold = F.broadcast(N.all_generated(spark).select("image", F.col("y").alias("gy"), F.col("x").alias("gx"), *(F.col(c).alias(f"g{c}") for c in "rgba")))  # seven images of at most 128 x 128
    met = pixels(spark, d).join(gold, (F.col("y") == F.col("gy")) & (F.col("x") == F.col("gx")))
    return met.groupBy("image", "image_id").agg(F.count(F.lit(1)).alias("compared"), *(F.sum(F.abs(F.col(f"g{c}") - F.col(c))).alias(c) for c in "rgba"))


def _alike(p: str, q: str) -> str:
    return "((" + " AND ".join(f"abs({p}.{c} - {q}.{c}) <= 100" for c in "rgba") + f") OR ({p}.a = 0 AND {q}.a = 0))"


_ANGLE = 0.6
_NINE = {"u": (0, -1), "l": (-1, 0), "r": (1, 0), "d": (0, 1), "ul": (-1, -1), "ur": (1, -1), "dl": (-1, 1), "dr": (1, 1)}
_SPOTS = ", ".join(
    f"struct_pack(x := floor(97 + sqrt(pow(3 * (x - 32) + {k % 3 - 1}, 2) + pow(3 * (y - 32) + {k // 3 - 1}, 2)) * cos(atan2(3 * (y - 32) + {k // 3 - 1}, 3 * (x - 32) + {k % 3 - 1}) + {_ANGLE}::DOUBLE) + 0.5)::INT, "
    f"y := floor(97 + sqrt(pow(3 * (x - 32) + {k % 3 - 1}, 2) + pow(3 * (y - 32) + {k // 3 - 1}, 2)) * sin(atan2(3 * (y - 32) + {k // 3 - 1}, 3 * (x - 32) + {k % 3 - 1}) + {_ANGLE}::DOUBLE) + 0.5)::INT)"
    for k in range(9)
)
_CORNER = {"ul": ("l", "u", "d", "r"), "ur": ("r", "u", "d", "l"), "dl": ("l", "d", "u", "r"), "dr": ("r", "d", "u", "l")}
_HOLDS = ", ".join(f"({_alike(a, b)} AND NOT {_alike(a, c)} AND NOT {_alike(b, e)}) k{n}" for n, (a, b, c, e) in _CORNER.items())
_PICKED = "CASE part WHEN 0 THEN CASE WHEN kul THEN l ELSE e END WHEN 2 THEN CASE WHEN kur THEN r ELSE e END WHEN 6 THEN CASE WHEN kdl THEN l ELSE e END WHEN 8 THEN CASE WHEN kdr THEN r ELSE e END " + " ".join(
    f"WHEN {n} THEN CASE WHEN (k{p} AND NOT {_alike('e', q)}) OR (k{q} AND NOT {_alike('e', p)}) THEN {side} ELSE e END" for n, side, p, q in ((1, "u", "ul", "ur"), (3, "l", "ul", "dl"), (5, "r", "ur", "dr"), (7, "d", "dl", "dr"))
) + " ELSE e END"


@query(f"""WITH {PIXELS}, im AS (SELECT image_id, y, x, struct_pack(r, g, b, a) p FROM px), spot AS (SELECT y::INT y, x::INT x FROM range(64) _(y), range(64) _(x)),
hit AS (SELECT y, x, list_filter([{_SPOTS}], lambda s: s.x BETWEEN 0 AND 191 AND s.y BETWEEN 0 AND 191)[1] s FROM spot),
way AS (SELECT y ty, x tx, coalesce(floor((s.y - 1) / 3.0 + 0.5)::INT, 0) y, coalesce(floor((s.x - 1) / 3.0 + 0.5)::INT, 0) x, s.x % 3 + s.y % 3 * 3 part FROM hit),
n AS (SELECT i.image_id, i.y, i.x, i.p e, {', '.join(f"coalesce({k}_.p, struct_pack(r := 0, g := 0, b := 0, a := 0)) {k}" for k in _NINE)} FROM im i {' '.join(f"LEFT JOIN im {k}_ ON {k}_.image_id = i.image_id AND {k}_.x = i.x + {v[0]} AND {k}_.y = i.y + {v[1]}" for k, v in _NINE.items())}),
h AS (SELECT *, {_HOLDS} FROM n), turned AS (SELECT image_id, ty, tx, CASE WHEN part IS NULL THEN struct_pack(r := 0, g := 0, b := 0, a := 0) WHEN x IN (0, 63) OR y IN (0, 63) THEN e ELSE {_PICKED} END p FROM h JOIN way USING (y, x))
SELECT image_id, ty y, tx x, p.r r, p.g g, p.b b, p.a a FROM turned""")
def rotated_nine(spark: SparkSession, d: str) -> DataFrame:
    """Images turned about their middle, each pixel by nine samples."""
    return O.rotate(pixels(spark, d), SIDE, SIDE, _ANGLE)


@query(f"WITH {PIXELS} SELECT image_id, x::INT y, (63 - y)::INT x, r, g, b, a FROM px")
def rotated_quarter(spark: SparkSession, d: str) -> DataFrame:
    """Images turned by three quarters."""
    return O.rotate(pixels(spark, d), SIDE, SIDE, -math.pi / 2)


@query(f"SELECT * FROM ({FLATTENED}) WHERE y = sprite_id * 7 % 22 AND x = sprite_id * 5 % 24")
def sampled_points(spark: SparkSession, d: str) -> DataFrame:
    """One point of each sprite through its layers, some below the canvas."""
    sprites, *rest = grouped_sprites(spark, d)
    return K.sample(sprites, *rest, sprites.select("sprite_id", (F.col("sprite_id") * 5 % 24).alias("x"), (F.col("sprite_id") * 7 % 22).alias("y")))


@query(f"""SELECT p_partkey, coalesce({list(L.BLENDS)}[p_partkey % 19 + 1], 'normal') blend, CASE WHEN p_partkey % 19 > 15 THEN 'layer ''' || p_name || ''': number ' || p_partkey % 19 || ' is not known here; taken for normal' END blend_warning,
CASE p_size % 4 WHEN 0 THEN 'forward' WHEN 1 THEN 'reverse' ELSE 'pingpong' END direction, CASE WHEN p_size % 4 = 3 THEN 'tag ''' || p_name || ''': number 3 is not known here; taken for pingpong' END tag_warning FROM part""")
def foreign_names(spark: SparkSession, d: str) -> DataFrame:
    """Blend modes and tag directions by their numbers in files, with warnings for those without a counterpart."""
    blend, one = L.blend_mode(F.col("p_partkey") % 19, F.col("p_name"))
    way, two = L.tag_direction(F.col("p_size") % 4, F.col("p_name"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", blend.alias("blend"), one.alias("blend_warning"), way.alias("direction"), two.alias("tag_warning"))


@query("""WITH a AS (SELECT o_custkey, list(['p' || o_orderkey % 3 || CASE WHEN o_orderkey % 5 = 0 THEN '-2' ELSE '' END] ORDER BY o_orderkey) ids, list(o_orderkey % 4 ORDER BY o_orderkey) colors FROM orders GROUP BY 1),
k AS (SELECT o_custkey, list_reduce(ids, lambda s, n: list_append(s, CASE WHEN list_contains(s, n[1]) THEN list_filter(list_transform(range(2, len(s) + 3), lambda i: n[1] || '-' || i), lambda t: NOT list_contains(s, t))[1] ELSE n[1] END), ['p1']) kept,
  list_filter(list_transform([0, 1, 2, 3], lambda c: list_position(colors, c)), lambda i: i IS NOT NULL) firsts, colors FROM a)
SELECT o_custkey, array_to_string(kept, ',') kept, len(firsts) n_colors, array_to_string(list_transform(list_sort(firsts)[2:], lambda i: colors[i]), ',') colors FROM k""")
def palette_ids(spark: SparkSession, d: str) -> DataFrame:
    """Palettes added to registries under ids of their own, and custom colours, the first one removed again."""
    o = F.array_sort(F.collect_list(F.struct("o_orderkey")))
    g = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(o.alias("o"))
    name = lambda k: F.concat(F.lit("p"), (k % 3).cast("string"), F.when(k % 5 == 0, "-2").otherwise(""))
    ids = F.concat(F.array(F.lit("p1")), F.transform("o", lambda s: name(s["o_orderkey"])))
    colors = P.custom_colors(F.transform("o", lambda s: s["o_orderkey"] % 4))
    rest = F.transform(P.without_color(colors, F.lit(0)), lambda c: c.cast("string"))
    return g.select("o_custkey", F.array_join(P.registered_ids(ids), ",").alias("kept"), F.size(colors).cast("long").alias("n_colors"), F.array_join(rest, ",").alias("colors"))


@query("""WITH s AS (SELECT o_custkey map_id, o_orderkey % 3 stroke, o_orderkey seq, (o_orderkey * 7 % 40 - 4)::INT col, (o_orderkey // 3 * 11 % 30 - 3)::INT row, (o_orderkey % 100)::INT tile FROM orders),
l AS (SELECT *, coalesce(lag(col) OVER w, col) c0, coalesce(lag(row) OVER w, row) r0 FROM s WINDOW w AS (PARTITION BY map_id, stroke ORDER BY seq)), n AS (SELECT *, greatest(abs(col - c0), abs(row - r0)) n FROM l),
p AS (SELECT map_id, stroke, seq, tile, k, c0 + sign(col - c0) * CASE WHEN n = 0 THEN 0 ELSE (2 * k * abs(col - c0) + n) // (2 * n) END col, r0 + sign(row - r0) * CASE WHEN n = 0 THEN 0 ELSE (2 * k * abs(row - r0) + n) // (2 * n) END row FROM n, range(60) _(k) WHERE k <= n)
SELECT map_id, row::INT row, col::INT col, max_by(tile, (stroke, seq, k)) tile FROM p WHERE col BETWEEN 0 AND 31 AND row BETWEEN 0 AND 23 GROUP BY ALL""")
def stamped_cells(spark: SparkSession, d: str) -> DataFrame:
    """Tiles stamped along strokes on grids of 32 x 24 cells."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    strokes = o.select(F.col("o_custkey").alias("map_id"), (k % 3).alias("stroke"), k.alias("seq"), (k * 7 % 40 - 4).cast("int").alias("col"), (F.floor(k / 3) * 11 % 30 - 3).cast("int").alias("row"), (k % 100).cast("int").alias("tile"))
    grids = strokes.select("map_id").distinct().withColumns({"cols": F.lit(32), "rows": F.lit(24)})
    return T.stamped(strokes, grids)


@query("""WITH s AS (SELECT n_nationkey::BIGINT sprite_id, greatest(1, floor(n_nationkey * 0.75::DOUBLE - 2 + 0.5))::INT w, greatest(1, n_nationkey % 6 - 1)::INT h FROM nation)
SELECT sprite_id, y::INT y, x::INT x, 0 r, 0 g, 0 b, 0 a FROM s, range(6) _(y), range(24) _(x) WHERE x < w AND y < h""")
def blank_documents(spark: SparkSession, d: str) -> DataFrame:
    """New documents of sizes that are brought into bounds."""
    k = F.col("n_nationkey")
    return D.blank(spark.read.parquet(f"{d}/nation.parquet").select(k.cast("long").alias("sprite_id"), (k * 0.75 - 2).alias("width"), (k % 6 - 1).alias("height")))


@query("""WITH f AS (SELECT l_orderkey drop_id, l_linenumber::BIGINT * 1000000000 + l_partkey pos, 'a.png/' || l_partkey || ['.txt', '.PNG', '', '.jpeg', '.webp', '.jpg.bak', '.Jpg'][l_partkey % 7 + 1] path FROM lineitem)
SELECT drop_id, min_by(path, pos) FILTER (lower(path) SIMILAR TO '.*[.](png|jpg|jpeg)') path FROM f GROUP BY 1""")
def dropped_images(spark: SparkSession, d: str) -> DataFrame:
    """The first image of each drop of files."""
    ends = F.element_at(F.array(*map(F.lit, (".txt", ".PNG", "", ".jpeg", ".webp", ".jpg.bak", ".Jpg"))), (F.col("l_partkey") % 7 + 1).cast("int"))
    files = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("drop_id"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("pos"), F.concat(F.lit("a.png/"), F.col("l_partkey").cast("string"), ends).alias("path"))
    return I.first_images(files)


def _chart(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    px = pixels(spark, d)
    chart = F.col("image_id") * 16 + F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16)
    cells = px.select(chart.alias("chart_id"), (F.col("y") % 16).alias("row"), (F.col("x") % 16).alias("col"), ((F.col("r") + F.col("x")) % 12 - 1).cast("int").alias("idx"))
    charts = cells.select("chart_id").distinct().withColumns({"width": F.lit(16), "height": F.lit(16)})
    counts = cells.where("idx >= 0").groupBy("chart_id", "idx").agg(F.count(F.lit(1)).alias("count"))
    legend = counts.select("chart_id", "idx", (F.col("idx") * 23 % 256).alias("r"), (F.col("idx") * 71 % 256).alias("g"), (F.col("idx") * 9 % 256).alias("b"), "count")
    return charts, cells, legend


_GLYPHS = ", ".join(f"({d}, {c}, {r})" for d, rows in enumerate(H.DIGITS) for r in range(5) for c in range(3) if rows[r] >> (2 - c) & 1)
_INK = "struct_pack(r := 0, g := 0, b := 0, a := 255)"
_OWN = "struct_pack(r := r::INT, g := g::INT, b := b::INT, a := 255)"
_LINE = "CASE WHEN i % 10 = 0 THEN struct_pack(r := 70, g := 70, b := 70, a := 255) ELSE struct_pack(r := 200, g := 200, b := 200, a := 255) END"


@query(f"""WITH {PIXELS}, cell AS (SELECT image_id * 16 + y // 16 * 4 + x // 16 k, (y % 16)::INT cy, (x % 16)::INT cx, ((r + x) % 12 - 1)::INT idx FROM px), chart AS (SELECT DISTINCT k FROM cell),
leg AS (SELECT k, idx, idx * 23 % 256 r, idx * 71 % 256 g, idx * 9 % 256 b, count(*) n FROM cell WHERE idx >= 0 GROUP BY ALL), {S.labs('leg')},
known AS (SELECT *, CASE WHEN l > 0.6 THEN {_INK} ELSE struct_pack(r := 255, g := 255, b := 255, a := 255) END ink, length(max(n) OVER (PARTITION BY k)::VARCHAR) places FROM lab),
size AS (SELECT k, 237 + CASE WHEN count(idx) > 0 THEN count(idx) * 18 + 8 ELSE 0 END h FROM chart LEFT JOIN leg USING (k) GROUP BY 1),
box(k, z, x, y, w, h, c) AS (SELECT k, 0, 0, 0, 237, h, struct_pack(r := 255, g := 255, b := 255, a := 255) FROM size UNION ALL SELECT k, 2, 11 + cx * 14, 9 + cy * 14, 14, 14, {_OWN} FROM cell JOIN known USING (k, idx)
  UNION ALL SELECT k, 4, 11 + i * 14, 9, 1, 224, {_LINE} FROM chart, range(17) _(i) UNION ALL SELECT k, 5, 11, 9 + i * 14, 224, 1, {_LINE} FROM chart, range(17) _(i) UNION ALL SELECT k, 6, 11, 243 + idx * 18, 14, 14, {_OWN} FROM known),
word(k, z, t, x, y, c) AS (SELECT k, 1, (i + 1)::VARCHAR, 11 + i * 14 + (15 - 4 * length((i + 1)::VARCHAR)) // 2, 2, {_INK} FROM chart, range(16) _(i) UNION ALL SELECT k, 1, (i + 1)::VARCHAR, 10 - 4 * length((i + 1)::VARCHAR), 13 + i * 14, {_INK} FROM chart, range(16) _(i)
  UNION ALL SELECT k, 3, (idx + 1)::VARCHAR, 11 + cx * 14 + (15 - 4 * length((idx + 1)::VARCHAR)) // 2, 13 + cy * 14, ink FROM cell JOIN known USING (k, idx)
  UNION ALL SELECT k, 7, (idx + 1)::VARCHAR, 11 + (15 - 4 * length((idx + 1)::VARCHAR)) // 2, 247 + idx * 18, ink FROM known
  UNION ALL SELECT k, 6, unnest([lpad(r::VARCHAR, 3, '0'), lpad(g::VARCHAR, 3, '0'), lpad(b::VARCHAR, 3, '0'), lpad(n::VARCHAR, places::INT, '0')]), unnest([31, 48, 65, 82]), 247 + idx * 18, {_INK} FROM known),
glyph(d, gx, gy) AS (VALUES {_GLYPHS}), dot AS (SELECT k, z, x + i * 4 + gx x, y + gy y, c FROM word, range(8) _(i), glyph WHERE i < length(t) AND d = substr(t, i + 1, 1)::INT),
every AS (SELECT k, z, x + i x, y + j y, c FROM box, range(237) _(i), range(500) __(j) WHERE i < w AND j < box.h UNION ALL SELECT * FROM dot),
top AS (SELECT k, y, x, max_by(c, z) c FROM every GROUP BY ALL)
SELECT k chart_id, y::INT y, count(*) pixels, sum((x + 1) * (c.r + c.g * 3 + c.b * 7 + c.a * 11))::BIGINT "sum" FROM top GROUP BY ALL""")
def charts(spark: SparkSession, d: str) -> DataFrame:
    """Printable charts of 16 x 16 cells with up to eleven colours, sixteen an image; a checksum of each row of their pixels."""
    runs = H.chart_runs(*_chart(spark, d), 14)
    n, color = F.col("n").cast("long"), F.col("r") + F.col("g") * 3 + F.col("b") * 7 + F.col("a") * 11
    places = n * (F.col("x") + 1) + F.expr("cast(n as long) * (n - 1) div 2")  # the sum of x + 1 along a run
    return runs.groupBy("chart_id", "y").agg(F.sum(n).alias("pixels"), F.sum(places * color).alias("sum"))


@query(f"WITH {PIXELS} SELECT image_id archive_id, 1 AS format, 'multiply' blend, 120 ms, y, x, coalesce(r, 0) r, coalesce(g, 0) g, coalesce(b, 0) b, coalesce(a, 0) a FROM (SELECT image_id, y::INT y, x::INT x FROM (SELECT image_id, max(y) + 1 h FROM px GROUP BY 1), range(64) _(y), range(64) _x(x) WHERE y < h) LEFT JOIN px USING (image_id, y, x)")
def project_archives(spark: SparkSession, d: str) -> DataFrame:
    """Projects of one layer, an image each, written as archives and opened again; a row of pixels that ends early is filled up."""
    each = settled(A.canvases(dealt(pixels(spark, d), "image_id", 500_000), SIDE).withColumnRenamed("image_id", "archive_id"), "canvases")
    text = """{"width": 64, "height": %d, "layers": [{"kind": "raster", "id": "l", "name": "one", "visible": true, "locked": false, "opacity": 1, "blendMode": "multiply"}],
        "frames": [{"id": "f", "durationMs": 120}], "cels": [{"id": "c", "layerId": "l", "frameId": "f", "x": 0, "y": 0, "width": 64, "height": %d}], "tags": [], "tilesets": []}"""
    document = each.select("archive_id", F.from_json(F.format_string(text, "height", "height"), A.DOCUMENT).alias("sprite"), F.lit(None).cast("string").alias("error"))
    content = each.select("archive_id", F.lit("cel").alias("kind"), F.lit("l").alias("owner"), F.lit("c").alias("id"), A.cel_entry(F.lit("c"), F.lit(False)).alias("name"), F.lit(False).alias("raw"), F.lit(SIDE).alias("width"), "height", "data", F.lit(None).cast("string").alias("warning"))
    # an archive is small and holds many pixels: tasks have a set number of archives, and rows are made last
    entry = settled(A.entries(A.packed(document, content)), "entries")
    opened = settled(A.documents(entry), "opened")
    heads = opened.select("archive_id", "format", F.get("sprite.layers", F.lit(0))["blendMode"].alias("blend"), F.get("sprite.frames", F.lit(0))["durationMs"].alias("ms"))
    found = heads.join(A.contents(opened, entry).select("archive_id", "width", "data"), "archive_id")
    return A.content_pixels(found.repartition(max(1, -(-each.count() // 100)), "archive_id"))


def _edit_log(spark: SparkSession, d: str) -> DataFrame:
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    names = ["add frame", "set duration", "add tag", "delete frame", "swap frames", "update tag", "set duration", "delete tag"]
    command = F.element_at(F.array(*map(F.lit, names)), (k * 7 % 8 + 1).cast("int"))
    what = F.when(k % 11 == 0, "undo").when(k % 13 == 0, "redo").otherwise("do")
    return o.select(
        F.col("o_custkey").alias("owner"), k.alias("seq"), what.alias("what"), F.when(command == "set duration", "duration").alias("key"), command.alias("command"),
        (k * 3 % 7).alias("id"), (k * 5 % 7).alias("other"), (k % 5).cast("int").alias("at"), (k % 5 + k % 3).cast("int").alias("to"), (k % 90 + 1).cast("int").alias("ms"),
    )


_LOG = "SELECT o_custkey o, o_orderkey q, CASE WHEN o_orderkey % 11 = 0 THEN 'undo' WHEN o_orderkey % 13 = 0 THEN 'redo' ELSE 'do' END w, CASE WHEN o_orderkey * 7 % 8 IN (1, 6) THEN 'duration' END k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) n FROM orders"
_LAST = "past[len(past)]"
_HISTORY = f"""e AS ({_LOG}), ends AS (SELECT o, max(n) m FROM e GROUP BY 1),
s(o, n, past, future, dropped, count, fixed) AS (SELECT DISTINCT o, 0::BIGINT, []::STRUCT(n BIGINT, k VARCHAR, q BIGINT[])[], []::STRUCT(n BIGINT, k VARCHAR, q BIGINT[])[], []::BIGINT[], 0::BIGINT, 0::BIGINT FROM e UNION ALL
 SELECT o, n, p, CASE WHEN w = 'do' THEN [] WHEN goes THEN list_append(future, {_LAST}) WHEN comes THEN future[:len(future) - 1] ELSE future END, CASE WHEN w = 'do' THEN list_concat(dropped, flatten(list_transform(future, lambda f: f.q))) ELSE dropped END,
  count + CASE WHEN w = 'do' AND NOT joins THEN 1 ELSE 0 END, CASE WHEN w = 'do' THEN greatest(fixed, len(p) - 200) ELSE fixed END
 FROM (SELECT *, CASE WHEN joins THEN list_append(past[:len(past) - 1], {{'n': {_LAST}.n, 'k': {_LAST}.k, 'q': list_append({_LAST}.q, q)}}) WHEN w = 'do' THEN list_append(past, {{'n': count, 'k': k, 'q': [q]}})
   WHEN goes THEN past[:len(past) - 1] WHEN comes THEN list_append(past, future[len(future)]) ELSE past END p
  FROM (SELECT s.o, e.n, e.w, e.k, e.q, past, future, dropped, count, fixed, e.w = 'do' AND len(past) > fixed AND coalesce(e.k = {_LAST}.k, false) joins, e.w = 'undo' AND len(past) > fixed goes, e.w = 'redo' AND len(future) > 0 comes FROM s JOIN e ON e.o = s.o AND e.n = s.n + 1))),
final AS (SELECT s.* FROM s JOIN ends ON ends.o = s.o AND ends.m = s.n),
fates AS (SELECT o owner, unnest(f.q) seq, f.n step, 'done' fate FROM (SELECT o, unnest(past) f FROM final) UNION ALL SELECT o, unnest(f.q), f.n, 'undone' FROM (SELECT o, unnest(future) f FROM final) UNION ALL SELECT o, unnest(dropped), NULL, 'dropped' FROM final)"""


@query(f"WITH RECURSIVE {_HISTORY} SELECT owner, seq::BIGINT seq, step, fate FROM fates")
def undo_steps(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as commands with undo and redo: which stand."""
    return E.history(_edit_log(spark, d).select("owner", "seq", F.col("what").alias("command"), "key"))


@query()
def edited_documents(spark: SparkSession, d: str) -> DataFrame:
    """Frames and tags after the commands that stand."""
    log = _edit_log(spark, d)
    stands = E.history(log.select("owner", "seq", F.col("what").alias("command"), "key")).where("fate = 'done'").select("owner", "seq")
    base = log.select("owner").distinct().select("owner", F.expr("transform(sequence(0, 3), i -> struct(cast(i as long) as id, 100 as ms))").alias("frames"), F.expr("array(struct(9L as id, 1 as lo, 2 as hi))").alias("tags"))
    out = E.edited(base, log.join(stands, ["owner", "seq"]))
    text = lambda c, *names: F.array_join(F.transform(c, lambda i: F.concat_ws(":", *(i[n].cast("string") for n in names))), " ")
    return out.select("owner", text("frames", "id", "ms").alias("frames"), text("tags", "id", "lo", "hi").alias("tags"))


@query("""WITH s AS (SELECT o_orderkey k, (o_orderkey % 13)::INT x0, (o_custkey % 11)::INT y0, (o_orderkey // 13 % 13)::INT x1, (o_custkey // 11 % 11)::INT y1 FROM orders)
SELECT k, kind, x::INT x, y::INT y FROM s, range(13) _(x), range(11) __(y), (VALUES ('full'), ('rim')) v(kind) WHERE x BETWEEN least(x0, x1) AND greatest(x0, x1) AND y BETWEEN least(y0, y1) AND greatest(y0, y1) AND (kind = 'full' OR x IN (x0, x1) OR y IN (y0, y1))""")
def rectangles_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Rims and areas of rectangles, some of one row, column or point."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    corners = [e.cast("int") for e in (k % 13, c % 11, F.floor(k / 13) % 13, F.floor(c / 11) % 11)]
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), W.rectangle(*corners, full).alias("points")) for n, full in (("full", True), ("rim", False))))
    rows = o.select(k.alias("k"), F.inline(kinds)).select("k", "kind", F.explode("points").alias("p"))
    return rows.select("k", "kind", "p.x", "p.y")


@query(f"""WITH {PIXELS}, e AS (SELECT t FROM range(48) _(t))
SELECT image_id, j.t::INT y, i.t::INT x, floor(sum(a) / count(*)::DOUBLE + 0.5)::INT a FROM px, e i, e j WHERE {S.cells(48, 64, 'x').replace('(t ', '(i.t ').replace('((t ', '((i.t ')} AND {S.cells(48, 64, 'y').replace('(t ', '(j.t ').replace('((t ', '((j.t ')} GROUP BY 1, 2, 3""")
def proxies(spark: SparkSession, d: str) -> DataFrame:
    """Alpha of stand-ins whose longest edge is 48."""
    return R.preview_proxy(pixels(spark, d), SIDE, SIDE, 48).select("image_id", "y", "x", "a")


@query(f"WITH {PIXELS} SELECT image_id, CASE WHEN x BETWEEN 40 AND 63 AND y BETWEEN 2 AND 16 THEN 18 - y ELSE y END::INT y, CASE WHEN x BETWEEN 40 AND 63 AND y BETWEEN 2 AND 16 THEN 103 - x ELSE x END::INT x, r, g, b, a FROM px")
def turned_selection(spark: SparkSession, d: str) -> DataFrame:
    """A selection that leaves the image turned by half."""
    return O.transformed(pixels(spark, d), SIDE, SIDE, (40, 2, 50, 15), 180.0)
