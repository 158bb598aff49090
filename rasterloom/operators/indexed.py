"""Indexed pixels: 0 is transparent, k the palette's entry k - 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.raster import quantize


def to_indexed(px: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """px with i: 0 where alpha is 0 or the palette is empty, else one more than the nearest entry."""
    if not palette:
        return px.withColumn("i", F.lit(0))
    near = quantize(px.withColumn("_a", F.col("a")), palette, threshold=1, preserve=True)
    return near.withColumn("i", F.when(F.col("_a") == 0, 0).otherwise(F.col("idx") + 1).cast("int")).withColumn("a", F.col("_a")).drop("_a", "idx")


def from_indexed(rows: DataFrame, palette: list[tuple[int, ...]]) -> DataFrame:
    """rows (…, i) with r, g, b, a; an index outside the palette is transparent black."""
    entries = F.array(*(F.array(*(F.lit(v) for v in (*c[:3], c[3] if len(c) > 3 else 255))) for c in palette)) if palette else F.lit(None).cast("array<array<int>>")
    entry = F.when(F.col("i") > 0, F.try_element_at(entries, F.when(F.col("i") > 0, F.col("i")).otherwise(1).cast("int")))
    return rows.withColumn("_c", entry).withColumns({n: F.coalesce(F.col("_c")[k], F.lit(0)).cast("int") for k, n in enumerate("rgba")}).drop("_c")


def raster_buffers(layers: DataFrame, cels: DataFrame) -> DataFrame:
    """Each pixel buffer that a conversion to indices changes, once: those of cels of raster layers (layer_id, cel_id, linked_to)."""
    own = cels.join(layers.where("kind = 'raster'").select("layer_id"), "layer_id", "left_semi")
    return own.select(F.coalesce("linked_to", "cel_id").alias("buffer_id")).distinct()


def converted_documents(sprites: DataFrame, layers: DataFrame, cels: DataFrame, pixels: DataFrame, palette: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents in colours made documents of indices: their outcome, the new buffers, and what undoing needs.

    sprites (sprite_id, mode) -> sprite_id, mode, reason: one that has indices already, or gets an
    empty palette, stays as it is and has a reason. Buffers (cel_id, y, x, i) are those of raster
    layers' cels, each once however many cels show it; tile grids and groups keep their colours.
    The last is the pixels that those buffers had.
    """
    reason = F.when(F.col("mode") == "indexed", "already-indexed").when(F.lit(not palette), "empty-palette")
    told = sprites.withColumn("reason", reason)
    changed = told.where("reason IS NULL").select("sprite_id")
    own = cels.join(changed, "sprite_id", "left_semi")
    buffers = raster_buffers(layers.join(changed, "sprite_id", "left_semi"), own).withColumnRenamed("buffer_id", "cel_id")
    before = pixels.join(buffers, "cel_id", "left_semi")
    outcome = told.select("sprite_id", F.when(F.col("reason").isNull(), "indexed").otherwise(F.col("mode")).alias("mode"), "reason")
    return outcome, to_indexed(before, palette).select("cel_id", "y", "x", "i"), before


def palette_fingerprint(palette_id: Column, colors: Column) -> Column:
    """id:r,g,b,a|r,g,b,a… of an array of colour arrays; - without a palette."""
    return F.coalesce(F.concat(palette_id, F.lit(":"), F.concat_ws("|", F.transform(colors, lambda c: F.concat_ws(",", c.cast("array<string>"))))), F.lit("-"))
