"""Rasters as relations: pixel(image_id, y, x, r, g, b, a), 64 x 64, from `orders`.

o_orderkey is dense, so image and place are arithmetic on it: no window, no shuffle, and
every row of the table is a pixel; the last image may end early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    place = F.pmod("o_orderkey", F.lit(SIDE * SIDE))
    o = o.select(F.floor(F.col("o_orderkey") / (SIDE * SIDE)).alias("image_id"), F.floor(place / SIDE).cast("int").alias("y"), F.pmod(place, F.lit(SIDE)).cast("int").alias("x"), "o_orderkey", "o_custkey")
    block = F.floor(F.col("x") / 8) * 32 + F.floor(F.col("y") / 8) * 17
    alpha = F.when(F.col("o_custkey") % 10 < 2, 0).when(F.col("o_custkey") % 10 < 4, F.col("o_custkey") * 11 % 256).otherwise(255)
    return o.select(
        "image_id", "y", "x", ((F.col("o_custkey") * 7 + F.col("x") * 3) % 256).cast("int").alias("r"),
        ((F.col("o_orderkey") * 13 + F.col("y") * 5) % 256).cast("int").alias("g"), (block % 256).cast("int").alias("b"), alpha.cast("int").alias("a"),
    )


#: The same relation for DuckDB, as the first item of a WITH clause.
PIXELS = """
o AS (SELECT o_orderkey k, o_custkey c, o_orderkey // 4096 image_id, ((o_orderkey % 4096) // 64)::INT y, (o_orderkey % 64)::INT x FROM orders),
px AS (SELECT image_id, y, x, ((c * 7 + x * 3) % 256)::INT r, ((k * 13 + y * 5) % 256)::INT g, (((x // 8) * 32 + (y // 8) * 17) % 256)::INT b,
  (CASE WHEN c % 10 < 2 THEN 0 WHEN c % 10 < 4 THEN c * 11 % 256 ELSE 255 END)::INT a FROM o)
"""
