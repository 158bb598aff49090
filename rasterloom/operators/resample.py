"""Separable resampling by weights: each target place reads a window of source places, as a relation of weights.

Weights of a place are a kernel stretched by the scale (when downscaling), normalised over
what lies inside the image. A pass along an axis is a join of pixels with that axis's
weights and a grouped sum, so an image is resampled by two joins with relations of a few
rows per place; what lies outside the image takes no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import half_up
from rasterloom.tables import dealt


def _sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.try_divide(F.sin(x * math.pi), x * math.pi))


#: Support and value of a kernel at a distance in (scaled) source places.
KERNELS = {
    "lanczos3": (3.0, lambda x: F.when(F.abs(x) < 3, _sinc(x) * _sinc(x / 3)).otherwise(0.0)),
    "bilinear": (1.0, lambda x: F.when(F.abs(x) < 1, 1 - F.abs(x)).otherwise(0.0)),
}


def weights(spark: SparkSession, src: int, dst: int, kernel: str) -> DataFrame:
    """at (a source place), to (a target place), weight: what each target place reads, adding up to 1."""
    support, value = KERNELS[kernel]
    ratio = src / dst
    scale = max(ratio, 1.0)
    middle = (F.col("to") + 0.5) * ratio
    lo = F.greatest(F.lit(0), F.floor(middle - support * scale)).cast("int")
    hi = F.least(F.lit(src), F.ceil(middle + support * scale)).cast("int")
    rows = spark.range(dst).select(F.col("id").cast("int").alias("to"))
    rows = rows.withColumn("at", F.explode(F.sequence(lo, F.greatest(lo + 1, hi) - 1))).withColumn("raw", value((F.col("at") - (middle - 0.5)) / scale))
    return rows.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("to"))).where("weight <> 0").select("at", "to", "weight")


def _along(px: DataFrame, axis: str, src: int, dst: int, kernel: str, values: list[str]) -> DataFrame:
    other = {"x": "y", "y": "x"}[axis]
    w = F.broadcast(weights(px.sparkSession, src, dst, kernel))  # a few rows for each of at most 4,096 places
    met = px.join(w, F.col(axis) == F.col("at"))
    return met.groupBy("image_id", other, F.col("to").alias(axis)).agg(*(F.sum(F.col(v) * F.col("weight")).alias(v) for v in values))


#: Pixels that a task resamples; an image is never parted.
PIXELS = 200_000


def resample(px: DataFrame, values: list[str], size: tuple[int, int], to: tuple[int, int], kernel: str = "lanczos3") -> DataFrame:
    """Whole images of one size (width, height) at another, each value by itself as a double: first along columns, then along rows."""
    px = px.select("image_id", "y", "x", *(F.col(v).cast("double").alias(v) for v in values))
    if size == to:
        return px
    px = dealt(px, "image_id", PIXELS)  # both passes stay within an image, so that pixels are shuffled once, before they become more
    px = _along(px, "y", size[1], to[1], kernel, values)
    return _along(px, "x", size[0], to[0], kernel, values).select("image_id", "y", "x", *values)


def as_bytes(value: Column) -> Column:
    """A resampled channel as 8 bits; it is cut to nine places first, so that the order of a sum does not decide what lies halfway."""
    return F.greatest(F.lit(0), F.least(F.lit(255), half_up(F.round(value, 9)))).cast("int")


#: Means and deviations of the channels that a segmentation model expects.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def model_input(px: DataFrame, size: tuple[int, int], side: int, means: tuple[float, ...] = MEANS, deviations: tuple[float, ...] = DEVIATIONS) -> DataFrame:
    """image_id, y, x, r, g, b: images resampled to a square, divided by their own brightest channel, then by mean and deviation."""
    small = resample(px, ["r", "g", "b"], size, (side, side)).withColumns({c: as_bytes(F.col(c)) for c in "rgb"})
    most = F.greatest(F.max(F.greatest("r", "g", "b")).over(Window.partitionBy("image_id")), F.lit(1)).cast("double")
    small = small.withColumn("_most", most)
    return small.select("image_id", "y", "x", *(((F.col(c) / F.col("_most") - m) / s).alias(c) for c, m, s in zip("rgb", means, deviations, strict=True)))


#: Fixed value: range of a model's output from which on it says anything.
FLAT = 1e-6


def matte(px: DataFrame, mask: DataFrame, size: tuple[int, int], side: int) -> DataFrame:
    """px with the alpha that a model's mask (image_id, y, x, value) leaves: the mask stretched to 0..1, resampled to the image, and never more opaque than before."""
    one = Window.partitionBy("image_id")
    low, high = F.min("value").over(one), F.max("value").over(one)
    level = mask.withColumn("value", F.when(high - low > FLAT, F.try_divide(F.col("value") - low, high - low)).otherwise(0.0)).withColumn("value", half_up(F.col("value") * 255))
    full = resample(level, ["value"], (side, side), size).select("image_id", "y", "x", as_bytes(F.col("value")).alias("_mask"))
    return px.join(full, ["image_id", "y", "x"]).withColumn("a", F.least("a", "_mask")).drop("_mask")
