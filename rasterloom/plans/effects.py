"""A query over the five effects of a layer, one for every fifth image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import compose as K
from rasterloom.operators import raster as R
from rasterloom.plans import sql as S
from rasterloom.plans.library import _hsv_sql
from rasterloom.registry import query
from rasterloom.sources.rasters import PIXELS, SIDE, pixels

STOPS = ((10, 20, 30), (200, 100, 50), (250, 250, 240))
#: kind, color, thickness, corners, dx, dy, h, s, v, palette of the effect of images whose id leaves 0, 1, ... by five.
EFFECTS = [
    ("outline", [9, 8, 7, 200], 2, True, 0, 0, 0.0, 0.0, 0.0, None), ("outline-inner", [200, 10, 10, 128], 2, False, 0, 0, 0.0, 0.0, 0.0, None), ("drop-shadow", [5, 6, 7, 180], 0, False, 3, -2, 0.0, 0.0, 0.0, None),
    ("gradient-map", None, 0, False, 0, 0, 0.0, 0.0, 0.0, [[*c, 255] for c in STOPS]), ("hsv-shift", None, 0, False, 0, 0, 37.0, -12.5, 9.5, None),
]
_LABS = [R.lab_of(c) for c in STOPS]
_MIXED = [f"CASE WHEN t < 1 THEN {_LABS[0][k]!r}::DOUBLE + ({_LABS[1][k] - _LABS[0][k]!r}::DOUBLE) * t ELSE {_LABS[1][k]!r}::DOUBLE + ({_LABS[2][k] - _LABS[1][k]!r}::DOUBLE) * (t - 1) END" for k in range(3)]
_NEAR = "SELECT p.image_id, p.y, p.x, count(q.y) n FROM c p LEFT JOIN c q ON q.image_id = p.image_id AND q.a > 0 AND {} AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 WHERE p.image_id % 5 = {} GROUP BY ALL"


@query(f"""WITH {PIXELS}, c AS (SELECT i.image_id, j::INT y, k::INT x, {', '.join(f'coalesce({n}, 0) {n}' for n in 'rgba')} FROM (SELECT DISTINCT image_id FROM px) i, range(64) _(j), range(64) _k(k) LEFT JOIN px ON px.image_id = i.image_id AND px.y = j AND px.x = k),
around AS ({_NEAR.format('true', 0)}), inner1 AS ({_NEAR.format('abs(q.y - p.y) + abs(q.x - p.x) <= 2', 1)}),
e0 AS (SELECT image_id, y, x, CASE WHEN a = 0 AND n > 0 THEN 9 ELSE r END r, CASE WHEN a = 0 AND n > 0 THEN 8 ELSE g END g, CASE WHEN a = 0 AND n > 0 THEN 7 ELSE b END b, CASE WHEN a = 0 AND n > 0 THEN 200 ELSE a END a FROM c JOIN around USING (image_id, y, x)),
e1 AS (SELECT image_id, y, x, CASE WHEN a > 0 AND n < 13 THEN 200 ELSE r END r, CASE WHEN a > 0 AND n < 13 THEN 10 ELSE g END g, CASE WHEN a > 0 AND n < 13 THEN 10 ELSE b END b, CASE WHEN a > 0 AND n < 13 THEN least(a, 128) ELSE a END a FROM c JOIN inner1 USING (image_id, y, x)),
cast2 AS (SELECT p.*, p.a / 255.0::DOUBLE sa, CASE WHEN q.a > 0 THEN 180 / 255.0::DOUBLE ELSE 0 END da FROM c p LEFT JOIN c q ON q.image_id = p.image_id AND q.x = p.x - 3 AND q.y = p.y + 2 WHERE p.image_id % 5 = 2),
e2 AS (SELECT image_id, y, x, {', '.join(f'CASE WHEN sa + da = 0 THEN 0 ELSE floor(({n} * sa + {v} * da * (1 - sa)) / (sa + da * (1 - sa)) + 0.5) END::INT {n}' for n, v in zip('rgb', (5, 6, 7)))}, floor((sa + da * (1 - sa)) * 255 + 0.5)::INT a FROM cast2),
c3 AS (SELECT * FROM c WHERE image_id % 5 = 3 AND a > 0), {S.labs('c3')}, range3 AS (SELECT image_id, min(l) lo, max(l) hi FROM lab GROUP BY 1), t3 AS (SELECT image_id, y, x, a, CASE WHEN hi > lo THEN (l - lo) / (hi - lo) * 2 ELSE 0 END t FROM lab JOIN range3 USING (image_id)),
m3 AS (SELECT image_id, y, x, a, {', '.join(f'{e} {n}' for e, n in zip(_MIXED, 'lpq'))} FROM t3), e3 AS (SELECT image_id, y, x, {', '.join(f'{e} {n}' for e, n in zip(S.unlab('l', 'p', 'q'), 'rgb'))}, a FROM m3),
{_hsv_sql(37.0, -12.5, 9.5).replace('FROM px)', 'FROM c WHERE image_id % 5 = 4)').replace('SELECT image_id, y, x,', ', e4 AS (SELECT image_id, y, x,')}),
every AS (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4)
SELECT image_id sprite_id, y, x, {', '.join(f'CASE WHEN a > 0 THEN {n} ELSE 0 END::INT {n}' for n in 'rgb')}, a::INT a FROM every WHERE a > 0""")
def layer_effects(spark: SparkSession, d: str) -> DataFrame:
    """Sprites of one layer with an effect each: outline, inner outline, drop shadow, gradient map, shift of hue; what shows."""
    px = pixels(spark, d)
    sprites = px.select(F.col("image_id").alias("sprite_id")).distinct().withColumns({"width": F.lit(SIDE), "height": F.lit(SIDE)})
    rows = [(n, [(kind, True, *rest)]) for n, (kind, *rest) in enumerate(EFFECTS)]
    effects = F.broadcast(spark.createDataFrame(rows, f"_n int, effects array<{K.EFFECT}>"))  # five rows
    layers = sprites.select("sprite_id", F.lit(0).alias("z"), F.lit(1).cast("long").alias("layer_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("raster").alias("kind"), F.lit(True).alias("visible"), F.lit(1.0).alias("opacity"), F.lit("normal").alias("blend"), F.lit(False).alias("clipping"), (F.col("sprite_id") % 5).cast("int").alias("_n"))
    layers = layers.join(effects, "_n").drop("_n")
    cels = sprites.select("sprite_id", F.lit(1).cast("long").alias("frame_id"), F.lit(1).cast("long").alias("layer_id"), F.col("sprite_id").alias("cel_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(None).cast("long").alias("linked_to"))
    return K.flatten(sprites, layers, cels, px.withColumnRenamed("image_id", "cel_id")).where("a > 0").drop("frame_id")
