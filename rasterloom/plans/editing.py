"""Queries over conversion, drawing, tiles and compositing."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import geometry as G
from rasterloom.operators import convert as V
from rasterloom.operators import export as X
from rasterloom.operators import raster as R
from rasterloom.operators import shapes as H
from rasterloom.plans import sql as S
from rasterloom.plans.pixels import _BOX
from rasterloom.registry import query
from rasterloom.tables import dealt
from rasterloom.sources import images as I
from rasterloom.sources import palettes as P
from rasterloom.sources.rasters import PIXELS, SIDE, pixels

_C64 = ", ".join(f"({i}, {c[0]}, {c[1]}, {c[2]})" for i, c in enumerate(P.colors("c64")))


@query(f"""WITH {PIXELS}, {_BOX}, {S.labs('box')}, {S.nearest('lab', 'c64')}, pal(i, pr, pg, pb) AS (VALUES {_C64})
SELECT image_id, y, x, idx, coalesce(pr, 0) r, coalesce(pg, 0) g, coalesce(pb, 0) b, CASE WHEN idx = 65535 THEN 0 ELSE 255 END a FROM near n LEFT JOIN pal ON pal.i = n.idx""")
def convert_render(spark: SparkSession, d: str) -> DataFrame:
    """Convert to 24 x 24 with a fixed palette, and render the indices."""
    out = V.convert(pixels(spark, d), V.Settings(24, 24, palette=tuple(P.colors("c64"))), SIDE, SIDE)
    return V.render(out, P.builtin_palettes(spark).where("palette_id = 'c64'"))


@query()
def convert_full(spark: SparkSession, d: str) -> DataFrame:
    """Every step of the conversion at once."""
    s = V.Settings(20, 20, "dominant", tuple(P.colors("nes")), dither="floyd-steinberg", background=0.05, crop=(2, 2, 60, 60), contrast=0.1, hue=20.0, despeckle=2, outline=0, corners=True)
    return V.convert(pixels(spark, d), s, SIDE, SIDE)


@query()
def convert_automatic(spark: SparkSession, d: str) -> DataFrame:
    """Convert to 24 x 24 with a palette of each image's own twelve colours, dithered in a pattern, and render."""
    s = V.Settings(24, 24, max_colors=12, dither="bayer4")
    px = V.prepare(pixels(spark, d), s, SIDE, SIDE)
    palettes = V.colors_of(px, s)
    return V.render(V.quantized(px, s, palettes), palettes)


@query(f"""WITH {PIXELS} SELECT image_id, y - 10 y, x - 5 x, r, g, b, a FROM px WHERE x BETWEEN 5 AND 44 AND y BETWEEN 10 AND 39""")
def cropped(spark: SparkSession, d: str) -> DataFrame:
    return V.crop(pixels(spark, d), 5, 10, 40, 30)


@query("""WITH t AS (SELECT l_orderkey k, l_linenumber n, l_partkey % 1000 tile, l_linenumber % 2 h, l_suppkey % 2 v, l_orderkey % 2 t FROM lineitem)
SELECT k, n, (CASE WHEN tile = 0 THEN 0 ELSE tile + h * 2147483648 + v * 1073741824 + t * 536870912 END)::BIGINT gid FROM t""")
def tile_gids(spark: SparkSession, d: str) -> DataFrame:
    """Packed tile ids -> ids of the map format, whose flags are the upper bits; tile 0 is empty."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    odd = lambda c: F.col(c) % 2
    u = G.unpack_tile(G.pack_tile(F.col("l_partkey") % 1000, odd("l_linenumber"), odd("l_suppkey"), odd("l_orderkey")))
    gid = X.tile_gid(u["tile"], u["flip_h"], u["flip_v"], u["transpose"])
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), gid.alias("gid"))


_FORMS = [(t, v, h) for t in (0, 1) for v, h in ((0, 0), (0, 1), (1, 0), (1, 1))]


def _turned(x: str, y: str, t: int, v: int, h: int) -> tuple[str, str]:
    x, y = (y, x) if t else (x, y)
    return (f"1 - {x}" if h else x), (f"1 - {y}" if v else y)


@query(f"""WITH {PIXELS}, t AS (SELECT image_id, (y // 2) * 32 + x // 2 tile, x % 2 i, y % 2 j, (b // 8) % 2 c FROM px),
s AS (SELECT image_id, tile, sum(CASE WHEN i = 0 AND j = 0 THEN c WHEN i = 1 AND j = 0 THEN c * 2 WHEN i = 0 THEN c * 4 ELSE c * 8 END) k FROM t GROUP BY ALL HAVING count(*) = 4),
f AS ({" UNION ALL ".join(f"SELECT image_id, {n} form, tile, sum(c * (1 << (({_turned('i', 'j', *f)[0]}) + 2 * ({_turned('i', 'j', *f)[1]}))::INT)) k FROM t GROUP BY ALL HAVING count(*) = 4" for n, f in enumerate(_FORMS))})
SELECT s.image_id, s.tile::BIGINT tile, arg_min(f.tile, f.tile * 8 + form)::BIGINT found, (min(f.tile * 8 + form) % 8)::INT form FROM s JOIN f ON f.image_id = s.image_id AND f.k = s.k GROUP BY ALL""")
def tile_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each 2 x 2 tile's first equal tile of the image under flips and transposition, and the first such form."""
    px = pixels(spark, d)
    t = px.select("image_id", (F.floor(F.col("y") / 2) * 32 + F.floor(F.col("x") / 2)).alias("tile"), (F.col("x") % 2).alias("i"), (F.col("y") % 2).alias("j"), (F.floor(F.col("b") / 8) % 2).alias("c"))
    corner = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("c")))
    tiles = t.groupBy("image_id", "tile").agg(F.count(F.lit(1)).alias("n"), *(corner(i, j).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1))).where("n = 4")

    def code(t_: int, v: int, h: int) -> F.Column:
        """Bits of the tile's corners after the turn: the corner at (i, j) moves to the turned place."""
        out = F.lit(0)
        for i in (0, 1):
            for j in (0, 1):
                a, b = (j, i) if t_ else (i, j)
                a, b = (1 - a if h else a), (1 - b if v else b)
                out = out + F.col(f"c{i}{j}") * (1 << (a + 2 * b))
        return out

    forms = tiles.select("image_id", F.col("tile").alias("found"), F.posexplode(F.array(*(code(*f) for f in _FORMS))).alias("form", "k"))
    least = forms.groupBy("image_id", "k").agg(F.min(F.struct("found", "form")).alias("m"))  # a row per distinct tile
    own = tiles.select("image_id", "tile", code(0, 0, 0).alias("k"))
    return own.join(least, ["image_id", "k"]).select("image_id", "tile", F.col("m.found").alias("found"), F.col("m.form").cast("int").alias("form"))


_POLY = "p AS (SELECT c_custkey polygon, i, ((c_custkey * (3 + i * 7) + i * 11) % 29)::DOUBLE + 0.25 x, ((c_custkey * (5 + i * 3) + i * 17) % 23)::DOUBLE y FROM customer, range(5) r(i))"


@query(f"""WITH {_POLY}, e AS (SELECT a.polygon, a.i, a.x ax, a.y ay, b.x bx, b.y by_ FROM p a JOIN p b ON a.polygon = b.polygon AND b.i = (a.i + 1) % 5 WHERE a.y <> b.y),
x AS (SELECT polygon, s.r, ax + (s.r + 0.5 - ay) / (by_ - ay) * (bx - ax) c, i FROM e, range(23) s(r) WHERE s.r + 0.5 >= least(ay, by_) AND s.r + 0.5 < greatest(ay, by_)),
n AS (SELECT *, row_number() OVER w k, lead(c) OVER w c2 FROM x WINDOW w AS (PARTITION BY polygon, r ORDER BY c, i))
SELECT DISTINCT polygon, g.x::INT x, r::INT y FROM n, range(30) g(x) WHERE k % 2 = 1 AND c2 IS NOT NULL AND g.x >= floor(c + 0.5) AND g.x <= ceil(c2) - 1""")
def polygon_fill(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    k, i = F.col("c_custkey"), F.col("i")
    return H.polygon_fill(c.select(k.alias("polygon"), "i", ((k * (3 + i * 7) + i * 11) % 29 + 0.25).alias("x"), ((k * (5 + i * 3) + i * 17) % 23).cast("double").alias("y")))


def _strokes(spark: SparkSession, d: str, curve: Callable[..., Column]) -> DataFrame:
    p, k = spark.read.parquet(f"{d}/part.parquet"), F.col("stroke").cast("int")
    return dealt(p.select(F.col("p_partkey").alias("stroke")), "stroke", H.MADE).select("stroke", curve(k % 13, k % 7, k % 17 + 2, k % 11).alias("points"))


_BOXES = "s AS (SELECT p_partkey stroke, p_partkey % 13 x0, p_partkey % 7 y0, p_partkey % 17 + 2 x1, p_partkey % 11 y1 FROM part)"


@query(f"""WITH {_BOXES}, l AS (SELECT *, abs(x1 - x0) dx, abs(y1 - y0) dy, greatest(abs(x1 - x0), abs(y1 - y0)) n FROM s),
p AS (SELECT stroke, CASE WHEN n = 0 THEN x0 ELSE x0 + sign(x1 - x0) * ((2 * k * dx + n) // (2 * n)) END x, CASE WHEN n = 0 THEN y0 ELSE y0 + sign(y1 - y0) * ((2 * k * dy + n) // (2 * n)) END y FROM l, range(40) r(k) WHERE k <= n)
SELECT DISTINCT stroke, (x + i)::INT x, (y + j)::INT y FROM p, range(2) a(i), range(2) b(j)""")
def line_strokes(spark: SparkSession, d: str) -> DataFrame:
    return H.stamp(_strokes(spark, d, H.line), 2)


@query(f"""WITH {_BOXES}, e AS (SELECT stroke, least(x0, x1) l, least(y0, y1) t, abs(x1 - x0) w, abs(y1 - y0) h FROM s),
u AS (SELECT stroke, l, t, w, h, v, k, abs(k * k * h * h - w * w * (h * h - v * v)) off FROM e, range(40) a(v), range(40) b(k) WHERE w > 0 AND h > 0 AND v <= h AND k <= w AND (v - h) % 2 = 0 AND (k - w) % 2 = 0),
rows_ AS (SELECT stroke, l, t, w, h, v, arg_min(k, (off, k)) k FROM u GROUP BY ALL),
c AS (SELECT stroke, l, t, w, h, k, v, abs(v * v * w * w - h * h * (w * w - k * k)) off FROM u WHERE NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.stroke = u.stroke AND r.k = u.k)),
q AS (SELECT * FROM rows_ UNION ALL SELECT stroke, l, t, w, h, arg_min(v, (off, -v)) v, k FROM c GROUP BY stroke, l, t, w, h, k),
o AS (SELECT stroke, (2 * l + w + i * k) // 2 x, (2 * t + h + j * v) // 2 y FROM q, (VALUES (-1), (1)) a(i), (VALUES (-1), (1)) b(j)
  UNION ALL SELECT stroke, l + i, t + j FROM e, range(40) a(i), range(40) b(j) WHERE (w = 0 OR h = 0) AND i <= w AND j <= h),
spans AS (SELECT stroke, y, min(x) a, max(x) b FROM o GROUP BY ALL)
SELECT stroke, unnest(range(a, b + 1))::INT x, y::INT y FROM spans""")
def filled_ellipses(spark: SparkSession, d: str) -> DataFrame:
    return H.fill_spans(_strokes(spark, d, H.ellipse).select("stroke", F.explode("points").alias("p")).select("stroke", "p.x", "p.y"))


@query(f"""WITH {PIXELS}, s AS (SELECT * FROM px WHERE a >= 128), d(side, dx, dy) AS (VALUES ('left', -1, 0), ('right', 1, 0), ('top', 0, -1), ('bottom', 0, 1))
SELECT s.image_id, s.y, s.x, side FROM s, d WHERE NOT EXISTS (SELECT 1 FROM s q WHERE q.image_id = s.image_id AND q.x = s.x + dx AND q.y = s.y + dy)""")
def selection_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Sides of selected pixels without a selected neighbour: windows over rows and columns instead of four joins."""
    s = pixels(spark, d).where("a >= 128").select("image_id", "y", "x")
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    apart = lambda c, f, w, by: F.coalesce(f(c).over(w) != F.col(c) + by, F.lit(True))
    sides = F.array(
        F.when(apart("x", F.lag, row, -1), "left"), F.when(apart("x", F.lead, row, 1), "right"), F.when(apart("y", F.lag, col, -1), "top"), F.when(apart("y", F.lead, col, 1), "bottom")
    )
    return s.withColumn("sides", F.array_compact(sides)).select("image_id", "y", "x", F.explode("sides").alias("side"))


@query(f"WITH {PIXELS}, m AS (SELECT image_id, y, x + 7 x, r, 1 k FROM px WHERE a > 0 AND x < 20 UNION ALL SELECT image_id, y, x, CASE WHEN x < 20 THEN 0 ELSE r END, 0 FROM px) SELECT image_id, y, x, arg_max(r, k) r FROM m GROUP BY ALL")
def moved_region(spark: SparkSession, d: str) -> DataFrame:
    """A selection is cleared and pasted seven to the right; pasted pixels win."""
    px = pixels(spark, d)
    cleared = px.select("image_id", "y", "x", F.when(F.col("x") < 20, 0).otherwise(F.col("r")).alias("r"), F.lit(0).alias("k"))
    pasted = px.where("a > 0 AND x < 20").select("image_id", "y", (F.col("x") + 7).alias("x"), "r", F.lit(1).alias("k"))
    return cleared.union(pasted).groupBy("image_id", "y", "x").agg(F.max_by("r", "k").alias("r"))


@query(f"""WITH {PIXELS}, h AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE v, least(r, g, b) / 255.0::DOUBLE n FROM px),
k AS (SELECT *, CASE WHEN v = n THEN 0 WHEN r / 255.0::DOUBLE = v THEN 60 * (CASE WHEN g < b THEN (g / 255.0::DOUBLE - b / 255.0::DOUBLE) / (v - n) + 6 ELSE (g / 255.0::DOUBLE - b / 255.0::DOUBLE) / (v - n) END) WHEN g / 255.0::DOUBLE = v THEN 60 * ((b / 255.0::DOUBLE - r / 255.0::DOUBLE) / (v - n) + 2) ELSE 60 * ((r / 255.0::DOUBLE - g / 255.0::DOUBLE) / (v - n) + 4) END hue, CASE WHEN v = 0 THEN 0 ELSE (v - n) / v END s FROM h)
SELECT image_id, y, x, floor(hue + 0.5)::INT hue, floor(s * 1000 + 0.5)::INT s, floor(v * 1000 + 0.5)::INT v FROM k""")
def hsv(spark: SparkSession, d: str) -> DataFrame:
    h, s, v = C.to_hsv(*(F.col(c) / 255.0 for c in "rgb"))
    r = lambda c, k: C.half_up(c * k).cast("int")
    return pixels(spark, d).select("image_id", "y", "x", r(h, 1).alias("hue"), r(s, 1000).alias("s"), r(v, 1000).alias("v"))


def _fold(n: int) -> str:
    """One more layer over the flattened ones: straight alpha, rounded."""
    sa, da = f"(a{n} / 255.0::DOUBLE * {(1.0, 0.5, 0.8)[n]}::DOUBLE)", "(ca / 255.0::DOUBLE)"
    o = f"({sa} + {da} * (1 - {sa}))"
    ch = ", ".join(f"CASE WHEN {o} <= 0 THEN 0 ELSE floor(({c}{n} * {sa} + c{c} * {da} * (1 - {sa})) / {o} + 0.5) END::INT AS c{c}" for c in "rgb")
    return f"f{n + 1} AS (SELECT * REPLACE ({ch}, CASE WHEN {o} <= 0 THEN 0 ELSE floor({o} * 255 + 0.5) END::INT AS ca) FROM f{n})"


@query(f"""WITH {PIXELS}, f0 AS (SELECT image_id, y, x, r r0, g g0, b b0, a a0, g r1, b g1, r b1, 255 - a a1, b r2, r g2, g b2, a // 2 a2, 0 cr, 0 cg, 0 cb, 0 ca FROM px), {_fold(0)}, {_fold(1)}, {_fold(2)}
SELECT image_id, y, x, cr r, cg g, cb b, ca a FROM f3""")
def flatten(spark: SparkSession, d: str) -> DataFrame:
    """Three layers, bottom to top, each rounded to eight bits before the next: an ordered fold over the layers of a pixel."""
    px, c = pixels(spark, d), F.col
    layers = [(0, 1.0, "r", "g", "b", c("a")), (1, 0.5, "g", "b", "r", 255 - c("a")), (2, 0.8, "b", "r", "g", F.floor(c("a") / 2))]
    out = None
    for z, o, r, g, b, a in layers:
        part = px.select("image_id", "y", "x", F.lit(z).alias("z"), c(r).alias("r"), c(g).alias("g"), c(b).alias("b"), a.cast("int").alias("a"), F.lit(o).alias("o"))
        out = part if out is None else out.union(part)
    return flatten_layers(out)


def flatten_layers(rows: DataFrame) -> DataFrame:
    """(image_id, y, x, z, r, g, b, a, o) -> image_id, y, x, r, g, b, a."""
    stack = rows.groupBy("image_id", "y", "x").agg(F.array_sort(F.collect_list(F.struct("z", "r", "g", "b", "a", "o"))).alias("stack"))
    zero = F.struct(*(F.lit(0).alias(n) for n in "rgba"))

    def step(s: F.Column, e: F.Column) -> F.Column:
        return F.struct(*(v.alias(n) for n, v in zip("rgba", C.over(tuple(e[n] for n in "rgba"), e["o"], tuple(s[n] for n in "rgba")))))

    return stack.select("image_id", "y", "x", F.aggregate("stack", zero, step).alias("c")).select("image_id", "y", "x", "c.r", "c.g", "c.b", "c.a")


@query(f"""WITH {PIXELS}, n AS (SELECT image_id, max(y) h, max(x) w FROM px GROUP BY 1)
SELECT image_id, j::INT y, i::INT x, coalesce(r, 0) r, coalesce(g, 0) g, coalesce(b, 0) b, coalesce(a, 0) a FROM n, range(64) _(j), range(64) __(i) LEFT JOIN px ON px.image_id = n.image_id AND px.y = j AND px.x = i WHERE j <= h AND i <= w""".replace("SELECT image_id, j::INT", "SELECT n.image_id, j::INT"))
def png_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Images as PNG files and back; what an image lacks of its rectangle is transparent."""
    return I.decode_png(I.encode_png(pixels(spark, d))).drop("error")


_FRAME = "SELECT image_id // 4 sprite_id, (image_id % 4)::INT frame, y, x, (r // 8 + y % 3)::INT idx FROM px"


@query(f"""WITH {PIXELS}, f AS ({_FRAME}), s AS (SELECT sprite_id, max(y) + 1 h FROM f GROUP BY 1)
SELECT f.sprite_id, frame, 64 AS width, any_value(h)::INT height, (greatest(10, 37 * frame) // 10 * 10)::INT ms, sum(idx)::BIGINT total, sum(idx * (y * 64 + x))::BIGINT placed FROM f JOIN s USING (sprite_id) GROUP BY ALL""")
def gif_files(spark: SparkSession, d: str) -> DataFrame:
    """Animations of four images each, written as GIF and read again: size and time of every frame, and its indices by sums."""
    px = pixels(spark, d)
    idx = px.select(F.floor(F.col("image_id") / 4).alias("sprite_id"), (F.col("image_id") % 4).cast("int").alias("frame"), "y", "x", (F.floor(F.col("r") / 8) + F.col("y") % 3).cast("int").alias("idx"))
    frames = I.decode_gifs(I.encode_gifs(idx.withColumn("ms", 37 * F.col("frame"))))
    at = frames.select("sprite_id", "frame", "width", "height", "ms", F.posexplode(F.col("indices")).alias("p", "i"))
    return at.groupBy("sprite_id", "frame", "width", "height", "ms").agg(F.sum("i").alias("total"), F.sum(F.col("i").cast("long") * F.col("p")).alias("placed"))


@query(f"""WITH {PIXELS}, m AS (SELECT image_id, y, x, a > 0 AS k FROM px), e AS (SELECT p.image_id, p.y, p.x, p.k, count(*) FILTER (q.k) n FROM m p LEFT JOIN m q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL)
SELECT image_id, y, x, (CASE WHEN k AND n < 4 THEN 1 ELSE 0 END)::INT ring FROM e""")
def inner_outline(spark: SparkSession, d: str) -> DataFrame:
    """Opaque pixels with an empty or missing neighbour: outside counts as empty here."""
    px = pixels(spark, d).select("image_id", "y", "x", (F.col("a") > 0).cast("int").alias("k"))
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    full = sum((F.coalesce(f("k").over(w), F.lit(0)) for f in (F.lag, F.lead) for w in (row, col)), F.lit(0))
    return px.select("image_id", "y", "x", F.when((F.col("k") == 1) & (full < 4), 1).otherwise(0).alias("ring"))
