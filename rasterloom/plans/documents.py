"""Queries over documents: grids, tags, layers, tiles, palettes, edit logs; and the per-image kernels."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import documents as D
from rasterloom.operators import kernels as K
from rasterloom.operators import raster as R
from rasterloom.registry import query
from rasterloom.sources import palettes as P
from rasterloom.sources.rasters import PIXELS, pixels


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_CELLS = "c AS (SELECT l_orderkey k, l_linenumber n, (l_partkey % 37)::INT col, (l_suppkey % 23)::INT row_ FROM lineitem)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 37).cast("int").alias("col"), (F.col("l_suppkey") % 23).cast("int").alias("row_"))


@query(f"""WITH {_CELLS} SELECT k, n, (3 + col * 16)::DOUBLE rx, (5 + row_ * 12)::DOUBLE ry, 3 + (col - row_) * 8.0::DOUBLE ix, 5 + (col + row_) * 6.0::DOUBLE iy,
3 + col * 16 + (row_ % 2) * 8.0::DOUBLE hx, 5 + row_ * 9.0::DOUBLE hy FROM c""")
def cell_origins(spark: SparkSession, d: str) -> DataFrame:
    out = _cells(spark, d)
    for shape in ("rect", "isometric", "hexagonal"):
        x, y = G.cell_origin(shape, F.col("col"), F.col("row_"), 16, 12, 3, 5)
        out = out.withColumns({f"{shape[0]}x": x.cast("double"), f"{shape[0]}y": y.cast("double")})
    return out.drop("col", "row_")


_HEX = f"""nr AS (SELECT image_id, y, x, floor((y - 5 - 6.0::DOUBLE) / 9.0::DOUBLE + 0.5)::BIGINT r0 FROM px),
rr AS (SELECT *, r0 + dr - 1 rw FROM nr, range(3) q(dr)), cc AS (SELECT *, floor((x - 3 - (((rw % 2) + 2) % 2) * 8.0::DOUBLE - 8.0::DOUBLE) / 16.0::DOUBLE + 0.5)::BIGINT + dc - 1 cl FROM rr, range(3) p(dc)),
dd AS (SELECT *, (x - (3 + cl * 16 + (((rw % 2) + 2) % 2) * 8.0::DOUBLE) - 8.0::DOUBLE) ** 2 + (y - (5 + rw * 9.0::DOUBLE) - 6.0::DOUBLE) ** 2 ds FROM cc),
hx AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY image_id, y, x ORDER BY ds, dr, dc) = 1)"""


@query(f"""WITH {PIXELS}, {_HEX} SELECT image_id, y, x, floor((x - 3) / 16)::BIGINT rc, floor((y - 5) / 12)::BIGINT rr,
floor(((x - 3 - 8.0::DOUBLE) / 8 + (y - 5 - 6.0::DOUBLE) / 6) / 2 + 0.5)::BIGINT ic, floor(((y - 5 - 6.0::DOUBLE) / 6 - (x - 3 - 8.0::DOUBLE) / 8) / 2 + 0.5)::BIGINT ir, cl hc, rw hr FROM hx""")
def pixel_cells(spark: SparkSession, d: str) -> DataFrame:
    out = pixels(spark, d).select("image_id", "y", "x")
    for shape in ("rect", "isometric", "hexagonal"):
        c, r = G.pixel_to_cell(shape, F.col("x"), F.col("y"), 16, 12, 3, 5)
        out = out.withColumns({f"{shape[0]}c": c.cast("long"), f"{shape[0]}r": r.cast("long")})
    return out


@query("""WITH t AS (SELECT l_orderkey k, l_linenumber n, l_partkey | ((l_linenumber % 2)::BIGINT << 28) | ((l_suppkey % 2) << 29) | ((l_orderkey % 2) << 30) packed FROM lineitem)
SELECT k, n, packed, packed & 268435455 tile, (packed >> 28) & 1 = 1 flip_h, (packed >> 29) & 1 = 1 flip_v, (packed >> 30) & 1 = 1 transpose FROM t""")
def tile_ids(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    odd = lambda c: F.col(c) % 2
    packed = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), G.pack_tile(F.col("l_partkey"), odd("l_linenumber"), odd("l_suppkey"), odd("l_orderkey")).alias("packed"))
    return packed.withColumns(G.unpack_tile(F.col("packed")))


_RECT = "(SELECT p_partkey k, (p_partkey % 13)::INT ax, (p_partkey % 7)::INT ay, (p_size % 11)::INT aw, (p_size % 5)::INT ah, (p_partkey % 17)::INT bx, (p_partkey % 5)::INT by_, (p_size % 9)::INT bw, (p_size % 6)::INT bh FROM part)"


@query(f"""SELECT k, CASE WHEN aw <= 0 OR ah <= 0 THEN bx WHEN bw <= 0 OR bh <= 0 THEN ax ELSE least(ax, bx) END ux, CASE WHEN aw <= 0 OR ah <= 0 THEN bw WHEN bw <= 0 OR bh <= 0 THEN aw ELSE greatest(ax + aw, bx + bw) - least(ax, bx) END uw,
CASE WHEN least(ax + aw, bx + bw) <= greatest(ax, bx) OR least(ay + ah, by_ + bh) <= greatest(ay, by_) THEN 0 ELSE (least(ax + aw, bx + bw) - greatest(ax, bx)) * (least(ay + ah, by_ + bh) - greatest(ay, by_)) END area FROM {_RECT}""")
def rectangles(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    m = lambda c, n: (F.col(c) % n).cast("int")
    a = (m("p_partkey", 13), m("p_partkey", 7), m("p_size", 11), m("p_size", 5))
    b = (m("p_partkey", 17), m("p_partkey", 5), m("p_size", 9), m("p_size", 6))
    u, i = G.rect_union(a, b), G.rect_intersect(a, b)
    return p.select(F.col("p_partkey").alias("k"), u[0].alias("ux"), u[2].alias("uw"), (i[2] * i[3]).alias("area"))


_TAG = "t AS (SELECT c_custkey tag, (c_custkey % 9)::INT f, (c_nationkey % 12)::INT u, 5 + (c_custkey % 7)::INT n, (c_custkey % 11)::INT at_, ['forward', 'reverse', 'pingpong'][(c_custkey % 3 + 1)::INT] dir FROM customer)"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return _t(spark, d, "customer").select(c.alias("tag"), (c % 9).cast("int").alias("f"), (F.col("c_nationkey") % 12).cast("int").alias("u"), (5 + c % 7).cast("int").alias("n"), (c % 11).cast("int").alias("at_"), F.element_at(F.array(*map(F.lit, ("forward", "reverse", "pingpong"))), (c % 3 + 1).cast("int")).alias("dir"))


@query(f"""WITH {_TAG}, r AS (SELECT *, least(greatest(least(f, u), 0), n - 1) lo, least(greatest(greatest(f, u), 0), n - 1) hi FROM t),
x AS (SELECT *, least(greatest(lo - (at_ < lo)::INT, 0), greatest(0, n - 2)) rl, least(greatest(hi - (at_ <= hi)::INT, 0), greatest(0, n - 2)) rh FROM r)
SELECT tag, lo, hi, lo + (at_ <= lo)::INT il, hi + (at_ <= hi + 1)::INT ih, least(rl, rh) rl, rh FROM x""")
def tag_ranges(spark: SparkSession, d: str) -> DataFrame:
    t = _tags(spark, d)
    lo, hi = G.clamp_range(F.col("f"), F.col("u"), F.col("n"))
    t = t.withColumns({"lo": lo, "hi": hi})
    i, r = G.range_after_insert(F.col("lo"), F.col("hi"), F.col("at_")), G.range_after_remove(F.col("lo"), F.col("hi"), F.col("at_"), F.col("n") - 1)
    return t.select("tag", "lo", "hi", i[0].alias("il"), i[1].alias("ih"), r[0].alias("rl"), r[1].alias("rh"))


@query(f"""WITH {_TAG}, r AS (SELECT *, least(f, u, n - 1) lo, least(greatest(f, u), n - 1) hi FROM t), e AS (SELECT tag, dir, lo, hi, unnest(range(lo, hi + 1)) p FROM r)
SELECT tag, (CASE WHEN dir = 'reverse' THEN hi - p ELSE p - lo END)::INT step, p::INT frame FROM e
UNION ALL SELECT tag, (hi - lo + hi - p)::INT, p::INT FROM e WHERE dir = 'pingpong' AND p > lo AND p < hi""")
def play_orders(spark: SparkSession, d: str) -> DataFrame:
    t = _tags(spark, d)
    lo, hi = G.clamp_range(F.col("f"), F.col("u"), F.col("n"))
    return t.withColumns({"lo": lo, "hi": hi}).select("tag", F.posexplode(D.play_order(F.col("lo"), F.col("hi"), F.col("dir"))).alias("step", "frame"))


@query(f"""WITH {_TAG}, s AS (SELECT tag, n, at_ % n a, d FROM t, (SELECT -k d, k o FROM range(1, 4) _(k) UNION ALL SELECT k, k + 3 FROM range(1, 5) _(k)) x),
g AS (SELECT tag, d, ((a + d) % n + n) % n frame, n FROM s) SELECT tag, d::INT distance, frame::INT frame FROM g WHERE (d < 0 AND -d <= n - 1) OR (d > 0 AND d <= n - 1 - least(3, n - 1))""")
def onion_skin(spark: SparkSession, d: str) -> DataFrame:
    t = _tags(spark, d)
    ghosts = F.explode(D.onion_frames(F.col("n"), F.col("at_") % F.col("n"), 3, 4))
    return t.select("tag", ghosts.alias("g")).select("tag", F.col("g.distance").alias("distance"), F.col("g.frame").alias("frame"))


@query(f"WITH {_TAG} SELECT tag, o_orderkey % 16 frame, count(*) cels, sum(greatest(o_custkey % 50, 1))::BIGINT ms FROM t JOIN orders ON o_orderkey % 16 BETWEEN least(f, u) AND greatest(f, u) AND o_custkey = tag GROUP BY ALL")
def tag_frames(spark: SparkSession, d: str) -> DataFrame:
    """Range join of tags with frames: cels and their time in each tag's range."""
    o = _t(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 16).alias("frame"))
    t = _tags(spark, d)
    j = t.join(o, (F.col("o_custkey") == F.col("tag")) & F.col("frame").between(F.least("f", "u"), F.greatest("f", "u")))
    return j.groupBy("tag", "frame").agg(F.count(F.lit(1)).alias("cels"), F.sum(F.greatest(F.col("o_custkey") % 50, F.lit(1))).alias("ms"))


@query("SELECT o_custkey sprite, o_orderkey frame, (sum(greatest(o_orderkey % 120, 1)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT ends FROM orders")
def playback_timeline(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("sprite").orderBy("frame")
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("sprite"), F.col("o_orderkey").alias("frame"))
    return o.withColumn("ends", F.sum(F.greatest(F.col("frame") % 120, F.lit(1))).over(w))


_LAYERS = """l AS (SELECT 'r' || r_regionkey id, NULL::VARCHAR pid, r_regionkey::INT z, r_regionkey % 3 <> 1 vis FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::INT, n_nationkey % 4 <> 0 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey::INT, true FROM supplier)"""


@query(f"""WITH {_LAYERS} SELECT a.id layer_id, (CASE WHEN b.id IS NULL THEN 0 WHEN c.id IS NULL THEN 1 ELSE 2 END)::INT AS depth, concat_ws('/', c.z, b.z, a.z) path, a.vis AND coalesce(b.vis, true) AND coalesce(c.vis, true) shown
FROM l a LEFT JOIN l b ON a.pid = b.id LEFT JOIN l c ON b.pid = c.id""")
def layer_tree(spark: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = (_t(spark, d, n) for n in ("region", "nation", "supplier"))
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    layers = region.select(s("r", "r_regionkey").alias("layer_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("int").alias("z"), (F.col("r_regionkey") % 3 != 1).alias("visible"))
    layers = layers.union(nation.select(s("n", "n_nationkey"), s("r", "n_regionkey"), F.col("n_nationkey").cast("int"), F.col("n_nationkey") % 4 != 0))
    layers = layers.union(supplier.select(s("s", "s_suppkey"), s("n", "s_nationkey"), F.col("s_suppkey").cast("int"), F.lit(True)))
    return D.layer_tree(spark, layers).select("layer_id", "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), "shown")


@query("""WITH l AS (SELECT o_custkey sprite_id, o_orderkey z, o_orderstatus = 'F' clipping, o_orderpriority <> '5-LOW' contributes FROM orders)
SELECT a.sprite_id, a.z, a.clipping, (SELECT max(b.z) FROM l b WHERE a.clipping AND b.sprite_id = a.sprite_id AND b.z < a.z AND b.contributes AND NOT b.clipping) base_z FROM l a
WHERE a.contributes AND (NOT a.clipping OR EXISTS (SELECT 1 FROM l b WHERE b.sprite_id = a.sprite_id AND b.z < a.z AND b.contributes AND NOT b.clipping))""")
def clip_bases(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("sprite_id"), F.col("o_orderkey").alias("z"), (F.col("o_orderstatus") == "F").alias("clipping"), (F.col("o_orderpriority") != "5-LOW").alias("contributes"))
    return D.clip_base(o).drop("contributes")


@query("""WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END s FROM events),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) run FROM s) SELECT user_id, run::BIGINT run, event_type, count(*) entries, min(event_id) first, max(event_id) last FROM r GROUP BY ALL""")
def coalesced_history(spark: SparkSession, d: str) -> DataFrame:
    return D.coalesce_runs(_t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""WITH b AS (SELECT user_id, event_id, row_number() OVER w n, sum((value * 100)::BIGINT) OVER w c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC))
SELECT user_id, event_id FROM b WHERE n = 1 OR (n <= 20 AND c <= 300000)""")
def kept_history(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return D.keep_last(e, "user_id", "event_id", F.round(F.col("value") * 100).cast("long"), 20, 300000).select("user_id", "event_id")


@query("""SELECT event_type, count(*) n, count(*) FILTER (value >= 50) slow, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95, max(value) top, round(avg(value), 6) mean FROM events GROUP BY 1""")
def tick_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("slow"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("top"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH RECURSIVE e AS (SELECT user_id o, event_id::BIGINT e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n FROM events), last AS (SELECT o, max(n) m FROM e GROUP BY 1),
s(o, n, free, waits, waited, came) AS (SELECT DISTINCT o, 0::BIGINT, -1099511627776::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM e UNION ALL
 SELECT o, n, CASE WHEN f <= e THEN e + 400 ELSE f END, CASE WHEN f <= e THEN NULL ELSE e END, CASE WHEN starts THEN waits END, CASE WHEN f <= e THEN e END
 FROM (SELECT *, free + CASE WHEN starts THEN 400 ELSE 0 END f FROM (SELECT s.o, e.n, e.e, s.waits, s.free, coalesce(s.waits IS NOT NULL AND s.free <= e.e, false) starts FROM s JOIN e ON e.o = s.o AND e.n = s.n + 1)))
SELECT o user_id, r event_id FROM (SELECT o, waited r FROM s UNION ALL SELECT o, came FROM s UNION ALL SELECT s.o, s.waits FROM s JOIN last ON last.o = s.o AND last.m = s.n) WHERE r IS NOT NULL""")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Preview requests that run: one at a time, the newest waiting one next."""
    return D.latest_wins(_t(spark, d, "events"), "user_id", "event_id", 400)


_ENTRIES = ", ".join(f"('{n}', {i}, {c[0]}, {c[1]}, {c[2]})" for n in (*P.BUILTIN, *(f"grayscale-{k}" for k in P.GRAY_STEPS)) for i, c in enumerate(P.colors(n)))


@query(f"""WITH pal(palette_id, i, r, g, b) AS (VALUES {_ENTRIES}), c AS (SELECT p_partkey k, p_partkey * 7919 % 256 r, p_partkey * 104729 % 256 g, p_size * 5 % 256 b FROM part),
best AS (SELECT palette_id, k, min(((c.r - pal.r) ** 2 + (c.g - pal.g) ** 2 + (c.b - pal.b) ** 2) * 256 + i)::BIGINT % 256 i FROM c, pal GROUP BY ALL)
SELECT palette_id, i, r, g, b, count(k) parts FROM pal LEFT JOIN best USING (palette_id, i) GROUP BY ALL""")
def builtin_palettes(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of the built-in palettes, and of how many parts' colours it is the nearest of its palette."""
    k = F.col("p_partkey")
    tones = spark.read.parquet(f"{d}/part.parquet").select(F.lit(255).alias("a"), (k * 7919 % 256).cast("int").alias("r"), (k * 104729 % 256).cast("int").alias("g"), (F.col("p_size") * 5 % 256).cast("int").alias("b"))
    names = [*P.BUILTIN, *(f"grayscale-{n}" for n in P.GRAY_STEPS)]
    near = None
    for n in names:
        own = R.quantize(tones, P.colors(n), space="srgb").groupBy(F.col("idx").alias("i")).agg(F.count(F.lit(1)).alias("parts")).withColumn("palette_id", F.lit(n))
        near = own if near is None else near.unionByName(own)
    return P.builtin_palettes(spark).join(near, ["palette_id", "i"], "left").fillna(0, ["parts"])


@query(f"WITH {PIXELS}, s AS (SELECT image_id, y, x, r, a FROM px WHERE a > 0) SELECT p.image_id, p.y, p.x, p.r, (q.r IS NOT NULL)::INT shadow FROM px p LEFT JOIN s q ON q.image_id = p.image_id AND q.x = p.x - 2 AND q.y = p.y - 3")
def drop_shadow(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    cast = px.where("a > 0").select("image_id", (F.col("x") + 2).alias("x"), (F.col("y") + 3).alias("y"), F.lit(1).alias("s"))
    return px.join(cast, ["image_id", "x", "y"], "left").select("image_id", "y", "x", "r", F.coalesce("s", F.lit(0)).alias("shadow"))


@query(f"WITH {PIXELS} SELECT image_id, y * 2 + j y, x * 2 + i x, r FROM px, range(2) u(i), range(2) v(j) WHERE a > 0")
def upscale_nearest(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d).where("a > 0")
    two = F.sequence(F.lit(0), F.lit(1))
    return px.withColumn("i", F.explode(two)).withColumn("j", F.explode(two)).select("image_id", (F.col("y") * 2 + F.col("j")).cast("long").alias("y"), (F.col("x") * 2 + F.col("i")).cast("long").alias("x"), "r")


@query("SELECT c_custkey n, least(greatest(8, 1), greatest(c_custkey, 1)) AS cols, ceil(c_custkey / least(8, greatest(c_custkey, 1)))::BIGINT AS rows_, ((c_custkey - 1) % 8) * 64 last_x, ((c_custkey - 1) // 8) * 64 last_y FROM customer WHERE c_custkey > 0")
def sheet_layout(spark: SparkSession, d: str) -> DataFrame:
    """Columns, rows and the last frame's origin of a sheet of n frames, 8 columns at most, 64 pixels each."""
    n = F.col("c_custkey")
    cols = F.least(F.lit(8), F.greatest(n, F.lit(1)))
    return _t(spark, d, "customer").where("c_custkey > 0").select(n.alias("n"), cols.alias("cols"), F.ceil(n / cols).alias("rows_"), ((n - 1) % 8 * 64).alias("last_x"), (F.floor((n - 1) / 8) * 64).alias("last_y"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 97 = 0)")
def preserved_entries(spark: SparkSession, d: str) -> DataFrame:
    """Anti join: entries that this writer does not own."""
    own = _t(spark, d, "customer").where("c_custkey % 97 = 0").select(F.col("c_nationkey").alias("s_nationkey"))
    return _t(spark, d, "supplier").join(own, "s_nationkey", "left_anti").select("s_suppkey")


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE v FROM embeddings), m AS (SELECT vec_id, min(v) lo, max(v) hi FROM e GROUP BY 1)
SELECT e.vec_id, sum(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255 + 0.5) ELSE 0 END)::BIGINT total FROM e JOIN m USING (vec_id) GROUP BY 1""")
def mask_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """Each row's values stretched to 0..255 by its smallest and largest; their sum."""
    v = _t(spark, d, "embeddings").select("vec_id", "embedding", F.array_min("embedding").alias("lo"), F.array_max("embedding").alias("hi"))
    one = lambda x: F.when(F.col("hi") > F.col("lo"), F.floor((x.cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double")) * 255 + 0.5)).otherwise(0)
    return v.select("vec_id", F.aggregate(F.transform("embedding", one), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_FILL = f"""WITH RECURSIVE {PIXELS}, q AS (SELECT image_id, y, x, b, a FROM px), s AS (SELECT image_id, min(y) y0, max(y) y1 FROM px GROUP BY 1),
f(image_id, y, x, b) AS (SELECT image_id, y, x, b FROM q WHERE y = 0 AND x IN (0, 63) UNION SELECT image_id, y, x, b FROM q JOIN s USING (image_id) WHERE q.y = s.y1 AND q.x IN (0, 63)
 UNION SELECT n.image_id, n.y, n.x, f.b FROM f JOIN q n ON n.image_id = f.image_id AND abs(n.y - f.y) + abs(n.x - f.x) = 1 AND n.b = f.b)
SELECT q.image_id, q.y, q.x, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.image_id = q.image_id AND f.y = q.y AND f.x = q.x) THEN 0 ELSE q.a END a FROM q"""


@query(_FILL)
def background_removal(spark: SparkSession, d: str) -> DataFrame:
    """Flood fill from the corners over flat blocks of colour."""
    px = pixels(spark, d).withColumns({"r": F.col("b"), "g": F.col("b")})
    return K.remove_background(px, 0.001).select("image_id", "y", "x", "a")


@query(f"""WITH {PIXELS}, i AS (SELECT image_id, y, x, CASE WHEN a < 128 THEN 65535 ELSE b % 16 END::INT idx FROM px),
n AS (SELECT p.image_id, p.y, p.x, p.idx, q.idx o FROM i p JOIN i q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1),
c AS (SELECT image_id, y, x, o, count(*) k FROM n GROUP BY ALL), w AS (SELECT image_id, y, x, o FROM c QUALIFY row_number() OVER (PARTITION BY image_id, y, x ORDER BY k DESC, o) = 1),
lone AS (SELECT image_id, y, x FROM n GROUP BY ALL HAVING count(*) FILTER (idx = o) = 0)
SELECT i.image_id, i.y, i.x, CASE WHEN lone.x IS NOT NULL THEN w.o ELSE i.idx END::INT idx FROM i LEFT JOIN lone USING (image_id, y, x) LEFT JOIN w USING (image_id, y, x)""")
def despeckled(spark: SparkSession, d: str) -> DataFrame:
    idx = pixels(spark, d).select("image_id", "y", "x", F.when(F.col("a") < 128, R.TRANSPARENT).otherwise(F.col("b") % 16).cast("int").alias("idx"))
    return K.despeckle(idx, 1)


@query()
def floyd_steinberg(spark: SparkSession, d: str) -> DataFrame:
    return K.diffuse(pixels(spark, d), P.colors("gameboy"), "floyd-steinberg")


@query()
def atkinson(spark: SparkSession, d: str) -> DataFrame:
    return K.diffuse(pixels(spark, d), P.colors("gameboy"), "atkinson")


@query()
def auto_palette(spark: SparkSession, d: str) -> DataFrame:
    return K.auto_palette(pixels(spark, d), 16)
