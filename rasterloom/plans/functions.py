"""Queries over views, text, numbers and further pixel functions."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import geometry as G
from rasterloom.functions import views as V
from rasterloom.operators import raster as R
from rasterloom.plans import sql as S
from rasterloom.registry import query
from rasterloom.sources import palettes as P
from rasterloom.sources.rasters import PIXELS, pixels


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_VIEW = "v AS (SELECT p_partkey k, (p_partkey % 61 - 30)::INT pan, (1 + p_size % 9)::INT zoom, (16 + p_partkey % 90)::INT w, (16 + p_size)::INT h, (p_partkey % 200)::INT at_ FROM part)"


@query(f"""WITH {_VIEW}, z AS (SELECT *, greatest(1.0::DOUBLE, least(64.0::DOUBLE, zoom * 2.5::DOUBLE)) nz, w + 2 * 320 len FROM v)
SELECT k, floor((at_ - pan) / zoom)::BIGINT doc, (at_ * zoom + pan)::BIGINT screen, floor((320 - w * zoom) / 2 + 0.5)::BIGINT center, greatest(1, floor(least((320 - 48) / w, (200 - 48) / h)))::BIGINT fit,
round(CASE WHEN nz = zoom THEN pan ELSE at_ - (at_ - pan) * (nz / zoom) END, 6)::DOUBLE zoomed, round(least(1.0::DOUBLE, 320 / len), 6) thumb, round(least(len - 320, greatest(0, 320 - pan))::DOUBLE / (len - 320) * (1 - least(1.0::DOUBLE, 320 / len)), 6) place FROM z""")
def viewports(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col, F.col("p_partkey")
    v = _t(spark, d, "part").select(k.alias("k"), (k % 61 - 30).cast("int").alias("pan"), (1 + c("p_size") % 9).cast("int").alias("zoom"), (16 + k % 90).cast("int").alias("w"), (16 + c("p_size")).cast("int").alias("h"), (k % 200).cast("int").alias("at_"))
    thumb, place = V.scroll_thumb(c("w"), F.lit(320), c("pan"))
    _, zoomed = V.zoom_about(c("pan"), c("zoom"), F.lit(2.5), c("at_"))
    return v.select(
        "k", V.to_document(c("at_"), c("pan"), c("zoom")).alias("doc"), V.to_screen(c("at_"), c("pan"), c("zoom")).cast("long").alias("screen"), V.center_pan(c("zoom"), c("w"), F.lit(320)).alias("center"),
        V.fit_zoom(c("w"), c("h"), F.lit(320), F.lit(200)).cast("long").alias("fit"), F.round(zoomed, 6).alias("zoomed"), F.round(thumb, 6).alias("thumb"), F.round(place, 6).alias("place"),
    )


@query("""WITH n AS (SELECT c_custkey k, 'C:\\dir/' || c_name || ' ' || c_mktsegment || '.v1.gpl' path FROM customer), b AS (SELECT k, path, regexp_replace(regexp_extract(path, '([^\\\\/]*)$', 1), '\\.[^.]+$', '') base FROM n)
SELECT k, base, regexp_replace(regexp_replace(lower(base), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') slug, md5(path) sum5, sha256(path) sum256, regexp_replace(path, '\\.[^./]+$', '.json') other FROM b""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Base name, slug, checksums, and the path of a companion file."""
    path = F.concat(F.lit("C:\\dir/"), "c_name", F.lit(" "), "c_mktsegment", F.lit(".v1.gpl"))
    n = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), path.alias("path"))
    return n.select("k", V.base_name(F.col("path")).alias("base"), V.slug(V.base_name(F.col("path"))).alias("slug"), F.md5("path").alias("sum5"), F.sha2("path", 256).alias("sum256"), F.regexp_replace("path", r"\.[^./]+$", ".json").alias("other"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/en/([^/?#]+)/?(?:[?#].*)?$', 1), '') AS slug FROM pages""")
def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", V.url_host(F.col("url")).alias("host"), V.url_slug(F.col("url"), "en").alias("slug"))


@query("""WITH e AS (SELECT event_id k, event_id * 7919 bytes, 4 + event_id % 40 cell, 1 + event_id % 3 scale, event_id % 5000 top FROM events),
n AS (SELECT *, length(top::VARCHAR) * 3 * scale + (length(top::VARCHAR) - 1) * scale + scale * 2 need FROM e)
SELECT k, printf('%.1f MB', bytes / 1048576.0::DOUBLE) size, coalesce(list_filter([1, 2, 5, 10, 20, 25, 50, 100, 200, 500], lambda i: cell * i >= need)[1], 500)::INT step, lpad(top::VARCHAR, 5, '0') AS label FROM n""")
def chart_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return _t(spark, d, "events").select(k.alias("k"), V.megabytes(k * 7919).alias("size"), V.label_interval(4 + k % 40, 1 + k % 3, k % 5000).alias("step"), F.lpad((k % 5000).cast("string"), 5, "0").alias("label"))


@query("""SELECT o_orderkey k, ((o_orderkey % 7 + 1) % 7)::BIGINT nxt, ((o_orderkey % 7 + 6) % 7)::BIGINT prv, round(0.5 * pow(0.65::DOUBLE, o_orderkey % 8), 6)::DOUBLE opacity, greatest(1, floor((20 + o_custkey % 900) / (1 + o_orderkey % 12)::DOUBLE + 0.5))::BIGINT cells,
round((320 - (20 + o_custkey % 900) * least(320.0::DOUBLE / (20 + o_custkey % 900), 200.0::DOUBLE / (30 + o_orderkey % 500))) / 2, 3)::DOUBLE + 0.0::DOUBLE x, round((30 + o_orderkey % 500) * least(320.0::DOUBLE / (20 + o_custkey % 900), 200.0::DOUBLE / (30 + o_orderkey % 500)), 6)::DOUBLE h FROM orders""")
def frame_steps(spark: SparkSession, d: str) -> DataFrame:
    """Next and previous frame, ghost opacity, target cells, letterbox."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w, h = 20 + c % 900, 30 + k % 500
    rect = G.fit_rect(w, h, 320, 200)
    return _t(spark, d, "orders").select(k.alias("k"), V.next_frame(k % 7, F.lit(7), 1).alias("nxt"), V.next_frame(k % 7, F.lit(7), -1).alias("prv"), F.round(V.onion_opacity(k % 8 + 1), 6).alias("opacity"), G.target_size(w, (1 + k % 12).cast("double")).cast("long").alias("cells"), (F.round(rect[0], 3) + 0.0).alias("x"), F.round(rect[3], 6).alias("h"))


@query(f"""WITH {PIXELS}, {S.labs('px')} SELECT image_id, y, x, CASE WHEN l > 0.6 THEN 'black' ELSE 'white' END ink, least(a, b)::INT masked, (abs(r - g) <= 100 AND abs(g - b) <= 100 AND abs(r - b) <= 100)::INT AS alike FROM lab""")
def pixel_tests(spark: SparkSession, d: str) -> DataFrame:
    """Ink that contrasts, alpha under a mask, channels within a tolerance of 0.392157 * 255."""
    near = lambda p, q: F.abs(F.col(p) - F.col(q)) <= 0.392157 * 255
    lab = C.with_oklab(pixels(spark, d))
    return lab.select("image_id", "y", "x", F.when(F.col("lab_l") > 0.6, "black").otherwise("white").alias("ink"), F.least("a", "b").alias("masked"), (near("r", "g") & near("g", "b") & near("r", "b")).cast("int").alias("alike"))


_GRAY = [P.colors("gameboy")[0], P.colors("gameboy")[3]]
_GLAB = [R.lab_of(c) for c in _GRAY]
_MIX = [f"({a!r}::DOUBLE + ({b!r}::DOUBLE - {a!r}::DOUBLE) * t)" for a, b in zip(*_GLAB)]


@query(f"""WITH {PIXELS}, {S.labs('px')}, rg AS (SELECT image_id, min(l) lo, max(l) hi FROM lab WHERE a > 0 GROUP BY 1), tt AS (SELECT lab.image_id, y, x, r, g, b, a, CASE WHEN hi > lo THEN (l - lo) / (hi - lo) ELSE 0 END t FROM lab JOIN rg USING (image_id))
SELECT image_id, y, x, {", ".join(f"CASE WHEN a = 0 THEN {n} ELSE {e} END {n}" for n, e in zip("rgb", S.unlab(*_MIX)))} FROM tt""")
def gradient_map(spark: SparkSession, d: str) -> DataFrame:
    """Lightness, stretched over each image's opaque pixels, along a gradient of two colours in Oklab."""
    lab = C.with_oklab(pixels(spark, d))
    own = F.when(F.col("a") > 0, F.col("lab_l"))
    image = Window.partitionBy("image_id")
    lab = lab.withColumns({"lo": F.min(own).over(image), "hi": F.max(own).over(image)})
    t = F.when(F.col("hi") > F.col("lo"), F.try_divide(F.col("lab_l") - F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(0.0)
    lab = lab.withColumn("t", t).withColumns({f"old_{c}": F.col(c) for c in "rgb"})
    lab = lab.withColumns({f"lab_{k}": F.lit(p) + (F.lit(q) - F.lit(p)) * F.col("t") for k, p, q in zip("lab", *_GLAB)})
    return C.with_srgb(lab).select("image_id", "y", "x", *(F.when(F.col("a") == 0, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"))


@query(f"WITH {PIXELS}, s AS (SELECT image_id, r // 64 r0, g // 64 g0 FROM px WHERE x = 5 AND y = 5) SELECT px.image_id, y, x, CASE WHEN r // 64 = r0 AND g // 64 = g0 THEN 255 ELSE r END r FROM px JOIN s USING (image_id)")
def global_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel of the seed's coarse colour is filled, connected or not."""
    px = pixels(spark, d).withColumns({"r_": F.floor(F.col("r") / 64), "g_": F.floor(F.col("g") / 64)})
    seed = px.where("x = 5 AND y = 5").select("image_id", F.col("r_").alias("r0"), F.col("g_").alias("g0"))
    return px.join(seed, "image_id").select("image_id", "y", "x", F.when((F.col("r_") == F.col("r0")) & (F.col("g_") == F.col("g0")), 255).otherwise(F.col("r")).alias("r"))


@query(f"WITH {PIXELS} SELECT image_id, y, x, r FROM (SELECT image_id, y, 63 - x x, r FROM px WHERE image_id % 2 = 0 UNION ALL SELECT image_id, x y, y x, r FROM px WHERE image_id % 2 = 1)")
def turned(spark: SparkSession, d: str) -> DataFrame:
    """Even images flipped, odd ones transposed: arithmetic on coordinates."""
    odd = F.col("image_id") % 2 == 1
    return pixels(spark, d).select("image_id", F.when(odd, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(odd, F.col("y")).otherwise(63 - F.col("x")).alias("x"), "r")


@query("""SELECT o_custkey sprite, count(*) frames, sum(greatest(o_orderkey % 120, 10))::BIGINT ms, string_agg(((o_orderkey % 8) * 64)::VARCHAR || ',' || greatest(o_orderkey % 120, 10)::VARCHAR, ';' ORDER BY o_orderkey) AS meta FROM orders GROUP BY 1""")
def sheet_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Per sprite its frames' places and times, in order; times are ten milliseconds at least."""
    k = F.col("o_orderkey")
    ms = F.greatest(k % 120, F.lit(10))
    item = F.struct(k.alias("k"), F.concat_ws(",", (k % 8 * 64).cast("string"), ms.cast("string")).alias("s"))
    g = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("sprite")).agg(F.count(F.lit(1)).alias("frames"), F.sum(ms).alias("ms"), F.array_sort(F.collect_list(item)).alias("all"))
    return g.select("sprite", "frames", "ms", F.array_join(F.transform("all", lambda e: e["s"]), ";").alias("meta"))


@query("""WITH c AS (SELECT c_nationkey p, c_custkey i, (c_custkey * 37) % 50 v FROM customer), f AS (SELECT p, v, min(i) i FROM c GROUP BY ALL) SELECT p, (row_number() OVER (PARTITION BY p ORDER BY i) - 1)::INT pos, v FROM f""")
def palette_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Distinct colours of each palette in order of first occurrence."""
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("p"), F.col("c_custkey").alias("i"), (F.col("c_custkey") * 37 % 50).alias("v"))
    f = c.groupBy("p", "v").agg(F.min("i").alias("i"))
    return f.select("p", (F.row_number().over(Window.partitionBy("p").orderBy("i")) - 1).cast("int").alias("pos"), "v")


_SPREAD = [(n, [R.lab_of(c) for c in P.colors(n)]) for n in ("gameboy", "cga", "c64")]
_PAL = ", ".join(f"('{n}', {i}, {c[0]}, {c[1]}, {c[2]})" for n, _ in _SPREAD for i, c in enumerate(P.colors(n)))


@query(f"""WITH pal(name, i, r, g, b) AS (VALUES {_PAL}), {S.labs('pal')}, d AS (SELECT a.name, a.i, min((a.l - b.l) ** 2 + (a.p - b.p) ** 2 + (a.q - b.q) ** 2) d FROM lab a JOIN lab b ON a.name = b.name AND a.i <> b.i GROUP BY ALL),
s AS (SELECT name, avg(sqrt(d)) spread FROM d GROUP BY 1), c AS (SELECT p_partkey k, p_partkey * 7919 % 256 r, p_partkey * 104729 % 256 g, p_size * 5 % 256 b FROM part), {S.labs('c', 'tone')},
n AS (SELECT name, k, min((t.l - e.l) ** 2 + (t.p - e.p) ** 2 + (t.q - e.q) ** 2) d FROM tone t, lab e GROUP BY ALL)
SELECT name, round(any_value(spread), 6) spread, count(*) parts, count(*) FILTER (sqrt(d) < spread) inside FROM n JOIN s USING (name) GROUP BY name""")
def palette_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of each palette's colours to their nearest others, and how many parts' colours lie within it of an entry."""
    k, out = F.col("p_partkey"), None
    tones = C.with_oklab(_t(spark, d, "part").select((k * 7919 % 256).cast("int").alias("r"), (k * 104729 % 256).cast("int").alias("g"), (F.col("p_size") * 5 % 256).cast("int").alias("b")))
    for name, labs in _SPREAD:
        spread = R.palette_spread(P.colors(name))
        near = F.least(*(sum(((F.col(f"lab_{c}") - v) * (F.col(f"lab_{c}") - v) for c, v in zip("lab", e)), F.lit(0.0)) for e in labs))
        own = tones.select(near.alias("d")).agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.sqrt("d") < spread).alias("inside")).select(F.lit(name).alias("name"), F.round(F.lit(spread), 6).alias("spread"), "parts", "inside")
        out = own if out is None else out.union(own)
    return out


@query("""WITH s AS (SELECT shape, w, h FROM (VALUES ('rect'), ('isometric'), ('hexagonal')) v(shape), (SELECT (20 + p_partkey % 300)::INT w, (20 + p_size * 5)::INT h FROM part) GROUP BY ALL)
SELECT shape, w, h, CASE WHEN h < 12 THEN 0 WHEN shape = 'isometric' THEN (SELECT count(*) FROM range(400) r(c) WHERE c * 8 + 16 <= w AND c * 6 + 12 <= h) ELSE (SELECT count(*) FROM range(400) r(c) WHERE c * 16 + 16 <= w) END cols,
CASE WHEN w < 16 THEN 0 WHEN shape = 'isometric' THEN (h >= 12)::INT WHEN shape = 'rect' THEN (SELECT count(*) FROM range(400) r(c) WHERE c * 12 + 12 <= h) ELSE (SELECT coalesce(min(c), 400) FROM range(400) r(c) WHERE NOT (c * 9 + 12 <= h AND (c % 2) * 8 + 16 <= w)) END rows_ FROM s""")
def grid_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Cells along the first row and column whose boxes fit, up to the first that does not."""
    sizes = _t(spark, d, "part").select((20 + F.col("p_partkey") % 300).cast("int").alias("w"), (20 + F.col("p_size") * 5).cast("int").alias("h")).distinct()
    out = None
    for shape in ("rect", "isometric", "hexagonal"):
        cols, rows = G.grid_size(shape, F.col("w"), F.col("h"), 16, 12)
        part = sizes.select(F.lit(shape).alias("shape"), "w", "h", cols.alias("cols"), rows.alias("rows_"))
        out = part if out is None else out.union(part)
    return out
