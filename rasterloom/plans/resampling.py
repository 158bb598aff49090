"""Queries over resampling kernels, mattes and colour cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import resample as Z
from rasterloom.operators import volumes as U
from rasterloom.registry import query
from rasterloom.sources.rasters import PIXELS, SIDE, pixels

_VALUES = {
    "lanczos3": "CASE WHEN abs(v) >= 3 THEN 0 WHEN v = 0 THEN 1 ELSE sin(v * pi()) / (v * pi()) * sin(v / 3 * pi()) / (v / 3 * pi()) END",
    "bilinear": "greatest(0::DOUBLE, 1 - abs(v))",
}


def _weights(name: str, src: int, dst: int, kernel: str) -> str:
    scale = max(src / dst, 1.0)
    return f"""{name} AS (SELECT t, s, raw / sum(raw) OVER (PARTITION BY t) w FROM (SELECT t, s, {_VALUES[kernel]} raw FROM (SELECT t::INT t, s::INT s, (s - ((t + 0.5::DOUBLE) * {src / dst!r}::DOUBLE - 0.5::DOUBLE)) / {scale!r}::DOUBLE v FROM range({dst}) _(t), range({src}) _s(s))) WHERE raw <> 0)"""


def _passes(name: str, source: str, w: str, values: str) -> str:
    """Two CTEs: along columns, then along rows."""
    each = lambda q: ", ".join(f"sum({q}.{v} * w.w) {v}" for v in values)
    return f"""{name}_1 AS (SELECT image_id, w.t y, p.x, {each('p')} FROM {source} p JOIN {w} w ON p.y = w.s GROUP BY ALL), {name} AS (SELECT image_id, p.y, w.t x, {each('p')} FROM {name}_1 p JOIN {w} w ON p.x = w.s GROUP BY ALL)"""


def _bytes(v: str) -> str:
    return f"greatest(0, least(255, floor(round({v}, 9) + 0.5)))::INT {v}"


def _resampled_sql(dst: int, kernel: str) -> str:
    return f"WITH {PIXELS}, {_weights('wt', SIDE, dst, kernel)}, {_passes('z', 'px', 'wt', 'rgba')} SELECT image_id, y, x, {', '.join(map(_bytes, 'rgba'))} FROM z"


def _resampled(spark: SparkSession, d: str, dst: int, kernel: str) -> DataFrame:
    out = Z.resample(pixels(spark, d), list("rgba"), (SIDE, SIDE), (dst, dst), kernel)
    return out.select("image_id", "y", "x", *(Z.as_bytes(F.col(c)).alias(c) for c in "rgba"))


@query(_resampled_sql(24, "lanczos3"))
def lanczos_down(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, 24, "lanczos3")


@query(_resampled_sql(100, "lanczos3"))
def lanczos_up(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, 100, "lanczos3")


@query(_resampled_sql(20, "bilinear"))
def bilinear_down(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, 20, "bilinear")


@query(_resampled_sql(96, "bilinear"))
def bilinear_up(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, 96, "bilinear")


@query(f"""WITH {PIXELS}, {_weights('wt', SIDE, 40, 'lanczos3')}, {_passes('z', 'px', 'wt', 'rgb')}, i AS (SELECT image_id, y, x, {', '.join(map(_bytes, 'rgb'))} FROM z),
m AS (SELECT image_id, greatest(1, max(greatest(r, g, b)))::DOUBLE most FROM i GROUP BY 1)
SELECT image_id, y, x, {", ".join(f"(({c} / most) - {m!r}::DOUBLE) / {s!r}::DOUBLE {c}" for c, m, s in zip("rgb", Z.MEANS, Z.DEVIATIONS))} FROM i JOIN m USING (image_id)""")
def model_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What a segmentation model of 40 x 40 reads."""
    return Z.model_input(pixels(spark, d), (SIDE, SIDE), 40)


@query(f"""WITH {PIXELS}, k AS (SELECT image_id, y // 4 y, x // 4 x, r * 0.01::DOUBLE - g * 0.02::DOUBLE v FROM px WHERE x % 4 = 1 AND y % 4 = 2),
n AS (SELECT *, min(v) OVER (PARTITION BY image_id) lo, max(v) OVER (PARTITION BY image_id) hi FROM k), l AS (SELECT image_id, y, x, floor(CASE WHEN hi - lo > 1e-6 THEN (v - lo) / (hi - lo) ELSE 0 END * 255 + 0.5) v FROM n),
{_weights('wt', 16, SIDE, 'lanczos3')}, {_passes('z', 'l', 'wt', 'v')} SELECT image_id, p.y, p.x, r, g, b, least(a, greatest(0, least(255, floor(round(v, 9) + 0.5)))::INT) a FROM px p JOIN z USING (image_id, y, x)""")
def mattes(spark: SparkSession, d: str) -> DataFrame:
    """Alpha under a model's mask of 16 x 16."""
    px = pixels(spark, d)
    mask = px.where("x % 4 = 1 AND y % 4 = 2").select("image_id", F.floor(F.col("y") / 4).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x"), (F.col("r") * 0.01 - F.col("g") * 0.02).alias("value"))
    return Z.matte(px, mask, (SIDE, SIDE), 16)


_EDGES = {c: (f"(({k} * box_id + image_id * {m}) % 24 - 1)::INT", f"(({k} * box_id + image_id * {m}) % 24 + (box_id * {n}) % 9)::INT") for c, k, m, n in (("r", 5, 3, 2), ("g", 7, 1, 4), ("b", 11, 2, 5))}
_BOXES = ", ".join(f"{lo} {c}0, {hi} {c}1" for c, (lo, hi) in _EDGES.items())


@query(f"""WITH {PIXELS}, box AS (SELECT image_id, box_id, {_BOXES} FROM (SELECT DISTINCT image_id FROM px), range(40) _(box_id)),
s AS (SELECT k.image_id, k.box_id, count(*) w, sum(p.r)::BIGINT sr, sum(p.g)::BIGINT sg, sum(p.b)::BIGINT sb, sum(p.r * p.r + p.g * p.g + p.b * p.b)::BIGINT m2 FROM box k JOIN px p
 ON p.image_id = k.image_id AND p.a >= 128 AND p.r >> 3 > r0 AND p.r >> 3 <= r1 AND p.g >> 3 > g0 AND p.g >> 3 <= g1 AND p.b >> 3 > b0 AND p.b >> 3 <= b1 GROUP BY ALL)
SELECT image_id, box_id, ((r1 - r0) * (g1 - g0) * (b1 - b0))::INT cells, coalesce(w, 0) w, coalesce(sr, 0) sr, coalesce(sg, 0) sg, coalesce(sb, 0) sb,
 CASE WHEN w > 0 THEN m2::DOUBLE - (sr::DOUBLE * sr + sg::DOUBLE * sg + sb::DOUBLE * sb) / w ELSE 0 END variance FROM box LEFT JOIN s USING (image_id, box_id)""")
def box_variances(spark: SparkSession, d: str) -> DataFrame:
    """Volume, moments and weighted variance of 40 boxes of each image's colour cube, from eight corners of its summed volume each."""
    px = pixels(spark, d)
    boxes = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("box_id"))
    boxes = boxes.selectExpr("image_id", "cast(box_id as long) box_id", *(f"{e} {c}{k}" for c, both in _EDGES.items() for k, e in enumerate(both)))
    found = U.box_moments(boxes, U.summed_volume(U.color_cells(px)))
    return found.select("image_id", "box_id", U.box_volume().alias("cells"), "w", "sr", "sg", "sb", U.variance(F.col("w"), (F.col("sr"), F.col("sg"), F.col("sb")), F.col("m2")).alias("variance"))
