"""Queries over drawing tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import gestures as G
from rasterloom.registry import query
from rasterloom.sources.rasters import PIXELS, SIDE, pixels


@query(f"""WITH {PIXELS}, c AS (SELECT image_id, max(y) + 1 h FROM px GROUP BY 1), canvas AS (SELECT image_id, j::INT y, i::INT x FROM c, range(64) _(j), range(64) __(i) WHERE j < h),
e AS (SELECT image_id, y * 64 + x + 1 seq, (r * 7 + y) % 70 ex, (g * 5 + x) % 70 ey, b % 4 + 1 n, r % 3 > 0 draws, r, g, b FROM px WHERE a > 0),
hit AS (SELECT v.image_id, v.y, v.x, max_by({{'seq': seq, 'draws': draws, 'r': e.r, 'g': e.g, 'b': e.b}}, seq) top FROM canvas v JOIN e ON e.image_id = v.image_id AND v.x >= ex - (n - 1) // 2 AND v.x < ex - (n - 1) // 2 + n AND v.y >= ey - (n - 1) // 2 AND v.y < ey - (n - 1) // 2 + n GROUP BY ALL)
SELECT image_id, top.seq::BIGINT seq, y, x, top.r::INT r, top.g::INT g, top.b::INT b FROM hit WHERE top.draws""")
def dabs(spark: SparkSession, d: str) -> DataFrame:
    """Dabs of pencil and eraser, one for each pixel that is not transparent, on empty canvases: what the pencil leaves."""
    G.register(spark)
    px = pixels(spark, d)
    n = F.col("b") % 4 + 1
    drawn = F.col("r") % 3 > 0
    events = px.where("a > 0").select(
        "image_id", (F.col("y") * SIDE + F.col("x") + 1).cast("long").alias("seq"), F.lit("down").alias("phase"), F.when(drawn, "pencil").otherwise("eraser").alias("tool"), ((F.col("r") * 7 + F.col("y")) % 70).alias("x"),
        ((F.col("g") * 5 + F.col("x")) % 70).alias("y"), n.alias("size"), "r", "g", "b", F.lit(255).alias("a"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("binary").alias("data"),
    )
    size = px.groupBy("image_id").agg((F.max("y") + 1).alias("height"))
    none = {c: F.lit(0) for c in ("x", "y", "size", "r", "g", "b", "a")}
    blank = size.select("image_id", F.lit(0).cast("long").alias("seq"), F.lit("canvas").alias("phase"), F.lit(None).cast("string").alias("tool"), *(v.alias(c) for c, v in none.items()), F.lit(SIDE).alias("width"), "height", F.unhex(F.repeat(F.lit("00"), F.col("height") * SIDE * 4)).alias("data"))
    out = spark.sql("SELECT * FROM gesture(TABLE(SELECT * FROM {rows}), key => 'image_id')", rows=events.unionByName(blank))
    return out.where("kind = 'pixel'").select("image_id", "seq", "y", "x", "r", "g", "b")
