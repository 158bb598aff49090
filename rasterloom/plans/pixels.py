"""Queries over the derived rasters: colour functions, resampling, quantising, masks, measures."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators import raster as R
from rasterloom.plans import sql as S
from rasterloom.registry import query
from rasterloom.sources.palettes import colors
from rasterloom.sources.rasters import PIXELS, SIDE, pixels

_BOX = f"""tx AS (SELECT t::INT t FROM range(24) _(t)),
cell AS (SELECT image_id, v.t y, u.t x, count(*) n, sum(a) s, {", ".join(f"sum((floor({S.lin(f'{c} / 255.0::DOUBLE')} * 1099511627776 + 0.5) * a)::HUGEINT)::DOUBLE {c}" for c in "rgb")}
  FROM px JOIN tx u ON {S.cells(24, 64, "px.x").replace("t *", "u.t *").replace("(t +", "(u.t +")} JOIN tx v ON {S.cells(24, 64, "px.y").replace("t *", "v.t *").replace("(t +", "(v.t +")} GROUP BY ALL),
box AS (SELECT image_id, y, x, {", ".join(f"CASE WHEN s > 0 THEN floor({S.enc(f'({c} / (s * 1099511627776.0::DOUBLE))')} * 255 + 0.5) ELSE 0 END::INT {c}" for c in "rgb")}, floor(s / n + 0.5)::INT a FROM cell)"""


@query(f"WITH {PIXELS}, {_BOX}, {S.labs('box')}, {S.nearest('lab', 'gameboy')} SELECT image_id, idx, count(*) pixels FROM near GROUP BY ALL")
def flagship_box_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Box downscale 64 -> 24, nearest of four colours, pixels per colour."""
    small = R.box_downscale(pixels(spark, d), SIDE, SIDE, 24, 24)
    return R.quantize(small, colors("gameboy")).groupBy("image_id", "idx").agg(F.count(F.lit(1)).alias("pixels"))


@query(f"WITH {PIXELS}, {_BOX} SELECT * FROM box")
def box_downscale(spark: SparkSession, d: str) -> DataFrame:
    return R.box_downscale(pixels(spark, d), SIDE, SIDE, 24, 24)


@query(f"""WITH {PIXELS}, t AS (SELECT t::INT t FROM range(24) _(t)), c AS (SELECT t, least(63, (2 * t + 1) * 64 // 48)::INT m FROM t)
SELECT image_id, v.t y, u.t x, r, g, b, a FROM px JOIN c u ON px.x = u.m JOIN c v ON px.y = v.m""")
def nearest_downscale(spark: SparkSession, d: str) -> DataFrame:
    return R.nearest_downscale(pixels(spark, d), SIDE, SIDE, 24, 24)


@query(f"""WITH {PIXELS}, c AS (SELECT image_id, y // 4 cy, x // 4 cx, y * 64 + x p, r, g, b, a, ((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS key FROM px),
k AS (SELECT image_id, cy, cx, key, count(*) n, arg_min(r, p) r, arg_min(g, p) g, arg_min(b, p) b FROM c WHERE a <> 0 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY image_id, cy, cx ORDER BY n DESC, key) i FROM k),
al AS (SELECT image_id, cy, cx, floor(sum(a) / count(*) + 0.5)::INT a FROM c GROUP BY ALL)
SELECT al.image_id, al.cy::INT y, al.cx::INT x, coalesce(r, 0) r, coalesce(g, 0) g, coalesce(b, 0) b, al.a FROM al LEFT JOIN w ON al.image_id = w.image_id AND al.cy = w.cy AND al.cx = w.cx AND i = 1""")
def dominant_downscale(spark: SparkSession, d: str) -> DataFrame:
    return R.dominant_downscale(pixels(spark, d), SIDE, SIDE, 16, 16)


@query(f"WITH {PIXELS}, {S.labs('px')} SELECT image_id, y, x, {', '.join(f'{e} {n}' for e, n in zip(S.unlab('l', 'p', 'q'), 'rgb'))} FROM lab")
def oklab_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return C.with_srgb(C.with_oklab(pixels(spark, d))).select("image_id", "y", "x", "r", "g", "b")


_ADJ = ("((l * 1.1::DOUBLE - 0.5) * 1.2::DOUBLE + 0.5)", "(p * 0.7::DOUBLE * cos(radians(40.0::DOUBLE)) - q * 0.7::DOUBLE * sin(radians(40.0::DOUBLE)))", "(p * 0.7::DOUBLE * sin(radians(40.0::DOUBLE)) + q * 0.7::DOUBLE * cos(radians(40.0::DOUBLE)))")


@query(f"WITH {PIXELS}, {S.labs('px')} SELECT image_id, y, x, a, {', '.join(f'{e} {n}' for e, n in zip(S.unlab(*_ADJ), 'rgb'))} FROM lab")
def adjust_image(spark: SparkSession, d: str) -> DataFrame:
    return C.adjust_image(pixels(spark, d), 0.1, 0.2, -0.3, 40.0).select("image_id", "y", "x", "a", "r", "g", "b")


@query(f"WITH {PIXELS}, {S.labs('px')}, {S.nearest('lab', 'c64')} SELECT image_id, y, x, idx FROM near")
def quantize_oklab(spark: SparkSession, d: str) -> DataFrame:
    return R.quantize(pixels(spark, d), colors("c64")).select("image_id", "y", "x", "idx")


_RGB4 = ", ".join(f"(r - {c[0]}) * (r - {c[0]}) + (g - {c[1]}) * (g - {c[1]}) + (b - {c[2]}) * (b - {c[2]})" for c in colors("cga"))


@query(f"WITH {PIXELS} SELECT image_id, y, x, CASE WHEN a < 128 THEN 65535 ELSE list_position([{_RGB4}], list_min([{_RGB4}])) - 1 END::INT idx FROM px")
def quantize_srgb(spark: SparkSession, d: str) -> DataFrame:
    """Integer distances: the smallest, ties to the lowest index."""
    sq = lambda x, k: (x - k) * (x - k)
    entries = [F.struct((sq(F.col("r"), c[0]) + sq(F.col("g"), c[1]) + sq(F.col("b"), c[2])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(colors("cga"))]
    idx = F.when(F.col("a") < 128, R.TRANSPARENT).otherwise(F.least(*entries)["i"])
    return pixels(spark, d).select("image_id", "y", "x", idx.cast("int").alias("idx"))


_B4 = "[0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]"
_SPREAD = R.palette_spread(colors("gameboy"))


@query(f"""WITH {PIXELS}, {S.labs('px')}, sh AS (SELECT * REPLACE (l + (({_B4}[((y % 4) * 4 + x % 4 + 1)::INT] + 0.5) / 16.0::DOUBLE - 0.5) * {_SPREAD!r}::DOUBLE AS l) FROM lab),
{S.nearest('sh', 'gameboy')} SELECT image_id, y, x, idx FROM near""")
def ordered_dither(spark: SparkSession, d: str) -> DataFrame:
    return R.quantize_ordered(pixels(spark, d), colors("gameboy"), 4).select("image_id", "y", "x", "idx")


@query(f"""WITH RECURSIVE {PIXELS}, b(n, x, y, v) AS (SELECT 1, 0, 0, 0 UNION ALL
 SELECT n * 2, x + dx * n, y + dy * n, v * 4 + e FROM b, (VALUES (0, 0, 0), (1, 0, 2), (0, 1, 3), (1, 1, 1)) q(dx, dy, e) WHERE n < 8)
SELECT n::INT n, b.x::INT x, b.y::INT y, v::INT v, count(*) pixels, count(*) FILTER (px.r * n * n > v * 256) lit FROM b JOIN px ON px.x % n = b.x AND px.y % n = b.y WHERE n > 1 GROUP BY ALL""")
def bayer_matrices(spark: SparkSession, d: str) -> DataFrame:
    """The pixels on each entry of the three matrices, and how many are above its threshold in red."""
    px, out = pixels(spark, d), None
    for n in (2, 4, 8):
        m = px.select(F.lit(n).alias("n"), (F.col("x") % n).alias("x"), (F.col("y") % n).alias("y"), R.bayer(F.col("x"), F.col("y"), n).cast("int").alias("v"), "r")
        m = m.groupBy("n", "x", "y", "v").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("r") * n * n > F.col("v") * 256).alias("lit"))
        out = m if out is None else out.union(m)
    return out


_WIN = "PARTITION BY image_id, {} ORDER BY {} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING"
_ROW, _COL = (lambda r: _WIN.format("y", "x", r=r)), (lambda r: _WIN.format("x", "y", r=r))


@query(f"WITH {PIXELS} SELECT image_id, y, x, greatest(max(a) OVER ({_ROW(1)}), max(a) OVER ({_COL(1)})) dilated, least(min(a) OVER ({_ROW(1)}), min(a) OVER ({_COL(1)})) eroded FROM px")
def morphology(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d).select("image_id", "y", "x", F.col("a").alias("dilated"), F.col("a").alias("eroded"))
    return R.erode(R.dilate(px, "dilated"), "eroded")


@query(f"""WITH {PIXELS}, t AS (SELECT image_id, y, x, CASE WHEN a < 100 THEN 0 ELSE a END a FROM px),
c AS (SELECT image_id, y, x, greatest(max(a) OVER ({_ROW(1)}), max(a) OVER ({_COL(1)})) a FROM t), e AS (SELECT image_id, y, x, least(min(a) OVER ({_ROW(1)}), min(a) OVER ({_COL(1)})) a FROM c),
f AS (SELECT image_id, y, x, floor(avg(a) OVER ({_ROW(2)}) + 0.5)::INT a FROM e) SELECT image_id, y, x, floor(avg(a) OVER ({_COL(2)}) + 0.5)::INT a FROM f""")
def mask_chain(spark: SparkSession, d: str) -> DataFrame:
    """Threshold, close by 1, feather by 2."""
    px = pixels(spark, d).select("image_id", "y", "x", F.when(F.col("a") < 100, 0).otherwise(F.col("a")).alias("a"))
    return R.feather(R.close(px, 1), 2)


@query(f"""WITH {PIXELS}, i AS (SELECT image_id, y, x, CASE WHEN a < 128 THEN 65535 ELSE b % 16 END::INT idx FROM px)
SELECT p.image_id, p.y, p.x, CASE WHEN p.idx = 65535 AND EXISTS (SELECT 1 FROM i q WHERE q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND q.idx <> 65535) THEN 7 ELSE p.idx END::INT idx FROM i p""")
def outline_ring(spark: SparkSession, d: str) -> DataFrame:
    idx = pixels(spark, d).select("image_id", "y", "x", F.when(F.col("a") < 128, R.TRANSPARENT).otherwise(F.col("b") % 16).cast("int").alias("idx"))
    return R.outline(idx, 7, corners=True)


@query(f"WITH {PIXELS} SELECT image_id, min(x) x, min(y) y, max(x) - min(x) + 1 width, max(y) - min(y) + 1 height FROM px WHERE a >= 128 GROUP BY ALL")
def visible_bounds(spark: SparkSession, d: str) -> DataFrame:
    return R.opaque_bounds(pixels(spark, d))


@query(f"WITH {PIXELS} SELECT image_id, r * 65536 + g * 256 + b AS color, count(*) n FROM px WHERE a >= 128 GROUP BY ALL")
def distinct_colors(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).where("a >= 128").groupBy("image_id", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("color")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PIXELS}, h AS (SELECT image_id, (r >> 3)::INT ri, (g >> 3)::INT gi, (b >> 3)::INT bi, count(*) w, sum(r)::BIGINT sr, sum(r * r + g * g + b * b)::BIGINT m2 FROM px WHERE a >= 128 GROUP BY ALL)
SELECT h.image_id, ri, gi, bi, h.w, sr, m2, (SELECT sum(k.w)::BIGINT FROM h k WHERE k.image_id = h.image_id AND k.ri <= h.ri AND k.gi = h.gi AND k.bi = h.bi) upto FROM h""")
def color_moments(spark: SparkSession, d: str) -> DataFrame:
    """Five-bit histogram with first and second moments, and its running sum along red."""
    px = pixels(spark, d).where("a >= 128")
    five = [F.shiftright(c, 3).alias(f"{c}i") for c in "rgb"]
    h = px.groupBy("image_id", *five).agg(F.count(F.lit(1)).alias("w"), F.sum("r").alias("sr"), F.sum(F.expr("r * r + g * g + b * b")).alias("m2"))
    return h.withColumn("upto", F.sum("w").over(Window.partitionBy("image_id", "gi", "bi").orderBy("ri")))


@query(f"""WITH {PIXELS}, s AS (SELECT p.image_id, p.x, sum(abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) + abs(p.a - q.a))::BIGINT diff FROM px p JOIN px q ON p.image_id = q.image_id AND p.y = q.y AND q.x = p.x - 1 GROUP BY ALL) SELECT * FROM s""")
def column_differences(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("image_id", "y").orderBy("x")
    diff = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in "rgba"), F.lit(0))
    return pixels(spark, d).withColumn("d", diff).where("x > 0").groupBy("image_id", "x").agg(F.sum("d").alias("diff"))


@query(f"""WITH {PIXELS}, s AS (SELECT p.image_id, p.x, sum(abs(p.b - q.b))::BIGINT diff FROM px p JOIN px q ON p.image_id = q.image_id AND p.y = q.y AND q.x = p.x - 1 GROUP BY ALL),
a AS (SELECT image_id, avg(diff) m FROM s GROUP BY 1), c AS (SELECT s.image_id, t.t p, avg(diff) / any_value(m) conf FROM s JOIN a USING (image_id), range(2, 11) t(t) WHERE x % t.t = 0 GROUP BY ALL HAVING count(*) >= 6),
best AS (SELECT image_id, max(conf) k FROM c GROUP BY 1) SELECT image_id, min(p)::INT period FROM c JOIN best USING (image_id) WHERE k >= 3 AND conf >= 0.75 * k GROUP BY 1""")
def grid_period(spark: SparkSession, d: str) -> DataFrame:
    """The smallest period whose edges stand out within three quarters of the best."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    s = pixels(spark, d).withColumn("d", F.abs(F.col("b") - F.lag("b").over(w))).where("x > 0").groupBy("image_id", "x").agg(F.sum("d").alias("diff"))
    s = s.withColumn("m", F.avg("diff").over(Window.partitionBy("image_id")))
    c = s.withColumn("p", F.explode(F.sequence(F.lit(2), F.lit(10)))).where(F.col("x") % F.col("p") == 0)
    c = c.groupBy("image_id", "p").agg((F.avg("diff") / F.first("m")).alias("conf"), F.count(F.lit(1)).alias("n")).where("n >= 6")
    c = c.withColumn("k", F.max("conf").over(Window.partitionBy("image_id")))
    return c.where((F.col("k") >= 3) & (F.col("conf") >= 0.75 * F.col("k"))).groupBy("image_id").agg(F.min("p").alias("period"))


@query(f"WITH {PIXELS}, n AS (SELECT image_id, r // 32 k, count(*) n FROM px GROUP BY ALL), t AS (SELECT image_id, sum(n) t FROM n GROUP BY 1), i AS (SELECT a.image_id i, b.image_id j FROM t a JOIN t b ON b.image_id = a.image_id + 1) SELECT i, j, round(sum(abs(coalesce(x.n, 0) / p.t - coalesce(y.n, 0) / q.t)) / 2, 6) distance FROM i, range(8) k(k) JOIN t p ON p.image_id = i JOIN t q ON q.image_id = j LEFT JOIN n x ON x.image_id = i AND x.k = k.k LEFT JOIN n y ON y.image_id = j AND y.k = k.k GROUP BY ALL")
def usage_distance(spark: SparkSession, d: str) -> DataFrame:
    """Total variation distance of the red histograms of each image and the next."""
    h = pixels(spark, d).groupBy("image_id", F.floor(F.col("r") / 32).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    h = h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("image_id"))).select("image_id", "k", "share")
    ids = h.select("image_id").distinct()
    pairs = ids.select(F.col("image_id").alias("i")).join(ids.select((F.col("image_id") - 1).alias("i")), "i")
    a = pairs.join(h.withColumnRenamed("image_id", "i"), "i").select("i", "k", "share")
    b = pairs.join(h.withColumn("i", F.col("image_id") - 1).drop("image_id"), "i").select("i", "k", F.col("share").alias("other"))
    both = a.join(b, ["i", "k"], "full_outer").fillna(0.0, ["share", "other"])
    return both.groupBy("i").agg(F.round(F.sum(F.abs(F.col("share") - F.col("other"))) / 2, 6).alias("distance")).select("i", (F.col("i") + 1).alias("j"), "distance")


_CB = " UNION ALL ".join(f"SELECT image_id, y, x, '{m}' AS mode, " + ", ".join(f"floor({' + '.join(f'{k!r}::DOUBLE * {c}' for k, c in zip(r, 'rgb'))} + 0.5)::INT {n}" for r, n in zip(C.VISION[m], "rgb")) + " FROM px" for m in C.VISION)


@query(f"WITH {PIXELS} {_CB}")
def color_vision(spark: SparkSession, d: str) -> DataFrame:
    seen = F.array(*(F.struct(F.lit(m).alias("mode"), *(c.alias(n) for c, n in zip(C.simulate_vision(m, F.col("r"), F.col("g"), F.col("b")), "rgb"))) for m in C.VISION))
    return pixels(spark, d).select("image_id", "y", "x", F.inline(seen))


_HARD = "(CASE WHEN {s} <= 0.5 THEN {d} * (2 * {s}) ELSE {d} + (2 * {s} - 1) - {d} * (2 * {s} - 1) END)"
_SEP = {
    "multiply": "{d} * {s}", "screen": "{d} + {s} - {d} * {s}", "overlay": _HARD.replace("{s}", "{t}").replace("{d}", "{s}").replace("{t}", "{d}"), "darken": "least({d}, {s})", "lighten": "greatest({d}, {s})",
    "color-dodge": "(CASE WHEN {d} = 0 THEN 0 WHEN {s} = 1 THEN 1 ELSE least(1, {d} / (1 - {s})) END)", "color-burn": "(CASE WHEN {d} = 1 THEN 1 WHEN {s} = 0 THEN 0 ELSE 1 - least(1, (1 - {d}) / {s}) END)",
    "hard-light": _HARD, "soft-light": "(CASE WHEN {s} <= 0.5 THEN {d} - (1 - 2 * {s}) * {d} * (1 - {d}) ELSE {d} + (2 * {s} - 1) * ((CASE WHEN {d} <= 0.25 THEN (16 * {d} - 12) * {d} * {d} + 4 * {d} ELSE sqrt({d}) END) - {d}) END)",
    "difference": "abs({d} - {s})", "exclusion": "{d} + {s} - 2 * {d} * {s}",
}


def _over_sql(mode: str) -> str:
    ch = lambda c: (f"(CASE WHEN da > 0 THEN ((1 - da) * s{c} + da * ({_SEP[mode].format(d='d' + c, s='s' + c)})) * 255 ELSE s{c} * 255 END)" if mode != "normal" else f"s{c} * 255")
    px = ", ".join(f"CASE WHEN o <= 0 THEN 0 ELSE floor(({ch(c)} * sa + d{c} * 255 * da * (1 - sa)) / o + 0.5) END::INT {c}" for c in "rgb")
    return f"SELECT image_id, y, x, '{mode}' AS mode, {px}, CASE WHEN o <= 0 THEN 0 ELSE floor(o * 255 + 0.5) END::INT a FROM st"


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, tuple, tuple]:
    px = pixels(spark, d)
    src = (F.col("g"), F.col("b"), F.col("r"), F.col("a"))
    dst = (F.col("r"), F.col("g"), F.col("b"), F.lit(255) - F.floor(F.col("a") / 2))
    return px, src, dst


_ST = "st AS (SELECT image_id, y, x, g / 255.0::DOUBLE sr, b / 255.0::DOUBLE sg, r / 255.0::DOUBLE sb, a / 255.0::DOUBLE * 0.75::DOUBLE sa, r / 255.0::DOUBLE dr, g / 255.0::DOUBLE dg, b / 255.0::DOUBLE db, (255 - a // 2) / 255.0::DOUBLE da, a / 255.0::DOUBLE * 0.75::DOUBLE + (255 - a // 2) / 255.0::DOUBLE * (1 - a / 255.0::DOUBLE * 0.75::DOUBLE) o FROM px)"


@query(f"WITH {PIXELS}, {_ST} " + " UNION ALL ".join(_over_sql(m) for m in ("normal", *_SEP)))
def composite_separable(spark: SparkSession, d: str) -> DataFrame:
    px, src, dst = _pair(spark, d)
    return _all_modes(px, src, dst, ("normal", *C.SEPARABLE))


def _all_modes(px: DataFrame, src: tuple, dst: tuple, modes: tuple[str, ...]) -> DataFrame:
    out = C.over_modes(px, src, F.lit(0.75), dst, modes)
    return out.select("image_id", "y", "x", "mode", *(F.col(f"out_{n}").alias(n) for n in "rgba"))


_LUM = "(0.3::DOUBLE * {0} + 0.59::DOUBLE * {1} + 0.11::DOUBLE * {2})"
_SOURCE = {"hue": ("s", "d", "d"), "saturation": ("d", "s", "d"), "color": ("s", None, "d"), "luminosity": ("d", None, "s")}


def _non_sql(mode: str) -> str:
    """Steps: saturation of one, lightness of another, clipped, composited."""
    base, sat, lum = _SOURCE[mode]
    rgb = lambda k: [f"{k}{c}" for c in "rgb"]
    mm = lambda k: (f"least({', '.join(rgb(k))})", f"greatest({', '.join(rgb(k))})")
    lo, hi = mm(base)
    one = ", ".join((f"CASE WHEN {hi} > {lo} THEN ({c} - {lo}) * ({mm(sat)[1]} - {mm(sat)[0]}) / ({hi} - {lo}) ELSE 0 END u{n}" if sat else f"{c} u{n}") for c, n in zip(rgb(base), "rgb"))
    m = mode
    return f"""{m}1 AS (SELECT *, {one} FROM st), {m}2 AS (SELECT *, {_LUM.format(*rgb(lum))} - {_LUM.format('ur', 'ug', 'ub')} e FROM {m}1),
{m}3 AS (SELECT * REPLACE (ur + e AS ur, ug + e AS ug, ub + e AS ub) FROM {m}2), {m}4 AS (SELECT *, {_LUM.format('ur', 'ug', 'ub')} ll, least(ur, ug, ub) n, greatest(ur, ug, ub) k FROM {m}3),
{m}5 AS (SELECT * REPLACE ({", ".join(f"CASE WHEN n < 0 THEN ll + (u{c} - ll) * ll / (ll - n) ELSE u{c} END AS u{c}" for c in "rgb")}) FROM {m}4),
{m}6 AS (SELECT * REPLACE ({", ".join(f"CASE WHEN k > 1 THEN ll + (u{c} - ll) * (1 - ll) / (k - ll) ELSE u{c} END AS u{c}" for c in "rgb")}) FROM (SELECT * REPLACE (greatest(ur, ug, ub) AS k, {_LUM.format('ur', 'ug', 'ub')} AS ll) FROM {m}5)),
{m} AS (SELECT image_id, y, x, '{m}' AS mode, {", ".join(f"CASE WHEN o <= 0 THEN 0 ELSE floor(((CASE WHEN da > 0 THEN ((1 - da) * s{c} + da * u{c}) * 255 ELSE s{c} * 255 END) * sa + d{c} * 255 * da * (1 - sa)) / o + 0.5) END::INT {c}" for c in "rgb")}, CASE WHEN o <= 0 THEN 0 ELSE floor(o * 255 + 0.5) END::INT a FROM {m}6)"""


@query(f"WITH {PIXELS}, {_ST}, " + ", ".join(_non_sql(m) for m in C.NON_SEPARABLE) + " " + " UNION ALL ".join(f"SELECT * FROM {m}" for m in C.NON_SEPARABLE))
def composite_non_separable(spark: SparkSession, d: str) -> DataFrame:
    px, src, dst = _pair(spark, d)
    return _all_modes(px, src, dst, tuple(C.NON_SEPARABLE))


@query(f"WITH {PIXELS} SELECT image_id, y, x, printf('#%02x%02x%02x', r, g, b) hex FROM px")
def hex_colors(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("image_id", "y", "x", C.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@query(f"""WITH {PIXELS}, i AS (SELECT image_id, CASE WHEN a < 128 THEN 65535 ELSE b % 16 END::INT idx FROM px), n AS (SELECT image_id, idx, count(*) n FROM i WHERE idx <> 65535 GROUP BY ALL)
SELECT image_id, idx, n, (row_number() OVER (PARTITION BY image_id ORDER BY n DESC, idx) - 1)::INT pos FROM n""")
def color_legend(spark: SparkSession, d: str) -> DataFrame:
    idx = pixels(spark, d).where("a >= 128").groupBy("image_id", (F.col("b") % 16).cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    return idx.withColumn("pos", (F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "idx")) - 1).cast("int"))


@query(f"""WITH {PIXELS}, nxt AS (SELECT image_id - 1 image_id, y, x, r, g, b, a FROM px)
SELECT p.image_id, count(*) compared, count(*) FILTER (p.b <> q.b OR p.a <> q.a) differing, min(p.x) FILTER (p.a <> q.a) x0, max(p.x) FILTER (p.a <> q.a) x1, min(p.y * 64 + p.x) FILTER (p.a <> q.a) first FROM px p JOIN nxt q USING (image_id, y, x) GROUP BY 1""")
def image_difference(spark: SparkSession, d: str) -> DataFrame:
    """Each image against the next: differing pixels, extent and first place of alpha changes."""
    px = pixels(spark, d)
    q = px.select((F.col("image_id") - 1).alias("image_id"), "y", "x", F.col("b").alias("b2"), F.col("a").alias("a2"))
    changed = F.col("a") != F.col("a2")
    return px.join(q, ["image_id", "y", "x"]).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if((F.col("b") != F.col("b2")) | changed).alias("differing"),
        F.min(F.when(changed, F.col("x"))).alias("x0"), F.max(F.when(changed, F.col("x"))).alias("x1"), F.min(F.when(changed, F.col("y") * SIDE + F.col("x"))).alias("first"),
    )
