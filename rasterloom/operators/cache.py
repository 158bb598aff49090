"""A cache of flattened frames by fingerprint: what did not change is not composited again.

A frame's fingerprint is a digest of its steps in order (how each layer is blended, clipped
and what effects it has), of where each layer's cel lies, and of the cel's pixels, so it
changes with anything that a frame shows and with nothing else. Buffers are digested once,
by sums that do not hang on the order of rows; frames are digested from those, bottom up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.compose import flatten, schedule

KEYS = ["sprite_id", "frame_id"]


def buffer_fingerprints(pixels: DataFrame) -> DataFrame:
    """cel_id, buffer: 128 bits of all pixels of a buffer that are not empty, whatever their order."""
    place = F.xxhash64("y", "x", "r", "g", "b", "a")
    again = F.xxhash64(F.lit("second"), "a", "b", "g", "r", "x", "y")
    sums = pixels.where("r <> 0 OR g <> 0 OR b <> 0 OR a <> 0").groupBy("cel_id").agg(F.bit_xor(place).alias("_x"), F.sum(again.cast("decimal(38,0)")).alias("_s"))
    return sums.select("cel_id", F.concat_ws(":", F.hex("_x"), F.col("_s").cast("string")).alias("buffer"))


def effects_fingerprint(effects: Column) -> Column:
    """A digest of the effects that are enabled, in their order; without any, none."""
    on = F.filter(effects, lambda e: e["enabled"])
    return F.when(F.size(on) > 0, F.sha2(F.to_json(on).cast("binary"), 256))


def frame_fingerprints(sprites: DataFrame, layers: DataFrame, cels: DataFrame, pixels: DataFrame) -> DataFrame:
    """sprite_id, frame_id, fingerprint of every frame that has a cel."""
    first = F.row_number().over(Window.partitionBy(*KEYS, "layer_id").orderBy("cel_id"))
    shown = cels.withColumn("_n", first).where("_n = 1").select(*KEYS, "layer_id", F.coalesce("linked_to", "cel_id").alias("cel_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    shown = shown.join(buffer_fingerprints(pixels), "cel_id", "left")
    steps = schedule(layers, cels).select(*KEYS, F.posexplode("steps").alias("_at", "s"))
    steps = steps.select(*KEYS, "_at", F.col("s.layer_id").alias("layer_id"), F.struct(*(F.col(f"s.{c}").alias(c) for c in ("depth", "parent_id", "layer_id", "kind", "opacity", "blend", "base_id"))).alias("_how"), effects_fingerprint(F.col("s.effects")).alias("_effects"))
    one = steps.join(shown, [*KEYS, "layer_id"], "left").withColumn("_part", F.sha2(F.to_json(F.struct("_how", "_effects", "_x", "_y", "buffer"), {"ignoreNullFields": "false"}).cast("binary"), 256))
    frames = one.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda p: p["_part"]), "").alias("_all"))
    every = cels.select(*KEYS).distinct().join(sprites.select("sprite_id", "width", "height"), "sprite_id").join(frames, KEYS, "left")
    return every.select(*KEYS, F.sha2(F.concat_ws(" ", F.col("width").cast("string"), F.col("height").cast("string"), F.coalesce("_all", F.lit(""))).cast("binary"), 256).alias("fingerprint"))


def refreshed(cache: DataFrame, sprites: DataFrame, layers: DataFrame, cels: DataFrame, pixels: DataFrame) -> DataFrame:
    """The cache (sprite_id, frame_id, fingerprint, y, x, r, g, b, a) for documents as they are now, with reused: frames that changed are flattened, frames that are gone leave it."""
    live = frame_fingerprints(sprites, layers, cels, pixels)
    kept = cache.join(live, [*KEYS, "fingerprint"], "left_semi")
    stale = live.join(kept.select(*KEYS).distinct(), KEYS, "left_anti")
    fresh = flatten(sprites, layers, cels.join(stale, KEYS, "left_semi"), pixels).join(stale, KEYS)
    columns = [*KEYS, "fingerprint", "y", "x", "r", "g", "b", "a"]
    return kept.select(*columns, F.lit(True).alias("reused")).union(fresh.select(*columns, F.lit(False)))


def filled(sprites: DataFrame, layers: DataFrame, cels: DataFrame, pixels: DataFrame) -> DataFrame:
    """The cache of documents that have none."""
    return flatten(sprites, layers, cels, pixels).join(frame_fingerprints(sprites, layers, cels, pixels), KEYS).select(*KEYS, "fingerprint", "y", "x", "r", "g", "b", "a")
