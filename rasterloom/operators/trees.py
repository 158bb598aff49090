"""Edits of layer trees, an edit per document: rows layer(sprite_id, layer_id, parent_id, kind, z).

A document's layers are a small array, so ancestors are a fold over its map of parents: one
shuffle by document, no recursion, nothing held beyond a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(parents: Column, layer: Column) -> Column:
    """layer, its parent and so on up to the root; parents is a map from layer to parent, whose size bounds the steps, so a circle ends too."""
    up = lambda path: F.try_element_at(parents, F.element_at(path, -1))
    return F.aggregate(F.sequence(F.lit(1), F.size(parents)), F.array(layer), lambda path, _: F.when(up(path).isNull(), path).otherwise(F.array_append(path, up(path))))


def _with_trees(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """edits with the document's maps of parents and kinds."""
    trees = layers.groupBy("sprite_id").agg(
        F.map_from_entries(F.collect_list(F.struct("layer_id", "parent_id"))).alias("_parents"), F.map_from_entries(F.collect_list(F.struct("layer_id", "kind"))).alias("_kinds")
    )
    return edits.join(trees, "sprite_id")


def reparent(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (sprite_id, layer_id, target; null is the top) -> layers after them.

    An edit is refused if it changes nothing, if the target is the layer, below it, missing
    or no group.
    """
    e = _with_trees(layers, edits)
    layer, target = F.col("layer_id"), F.col("target")
    known = F.map_contains_key("_parents", layer) & ~F.try_element_at("_parents", layer).eqNullSafe(target)
    into = target.isNull() | ((F.try_element_at("_kinds", target) == "group") & ~F.array_contains(ancestors(F.col("_parents"), target), layer))
    good = e.where(known & F.coalesce(into, F.lit(False))).select("sprite_id", "layer_id", "target", F.lit(True).alias("_moves"))
    out = layers.join(good, ["sprite_id", "layer_id"], "left")
    return out.withColumn("parent_id", F.when(F.col("_moves"), F.col("target")).otherwise(F.col("parent_id"))).select(layers.columns)


def delete_cascade(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (sprite_id, layer_id) -> layers without these and all below them; refused if none would be left."""
    trees = layers.groupBy("sprite_id").agg(F.map_from_entries(F.collect_list(F.struct("layer_id", "parent_id"))).alias("_parents"))
    one = trees.join(edits.select("sprite_id", F.col("layer_id").alias("_gone")), "sprite_id")
    below = F.filter(F.map_keys("_parents"), lambda k: F.array_contains(ancestors(F.col("_parents"), k), F.col("_gone")))
    one = one.withColumn("_below", below).where(F.size("_below") < F.size("_parents"))
    gone = one.select("sprite_id", F.explode("_below").alias("layer_id"))
    return layers.join(gone, ["sprite_id", "layer_id"], "left_anti")


def ungroup(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (sprite_id, layer_id) -> layers whose named group is gone and its children at its parent; refused if it is no group."""
    groups = layers.where("kind = 'group'").join(edits.select("sprite_id", "layer_id"), ["sprite_id", "layer_id"]).select("sprite_id", F.col("layer_id").alias("_group"), F.col("parent_id").alias("_up"))
    out = layers.join(groups, "sprite_id", "left")
    out = out.where(~F.coalesce(F.col("layer_id") == F.col("_group"), F.lit(False)))
    return out.withColumn("parent_id", F.when(F.col("parent_id") == F.col("_group"), F.col("_up")).otherwise(F.col("parent_id"))).select(layers.columns)


def move_among_siblings(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (sprite_id, layer_id, delta) -> layers with a new dense z from 0.

    The layer takes the flat place of the sibling delta steps away, and those between move
    by one; refused if there is no such sibling.
    """
    flat = Window.partitionBy("sprite_id").orderBy("z", "layer_id")
    among = Window.partitionBy("sprite_id", "parent_id").orderBy("z", "layer_id")
    rows = layers.withColumns({"_at": F.row_number().over(flat) - 1, "_n": F.row_number().over(among) - 1})
    # the sibling's place: a join on the number among siblings
    moving = rows.join(edits, ["sprite_id", "layer_id"]).select("sprite_id", F.col("parent_id").alias("_p"), F.col("_at").alias("_from"), (F.col("_n") + F.col("delta")).alias("_m"))
    to = moving.join(rows.select("sprite_id", F.col("parent_id").alias("_q"), F.col("_at").alias("_to"), F.col("_n").alias("_k")), "sprite_id").where("_p <=> _q AND _m = _k").select("sprite_id", "_from", "_to")
    out = rows.join(to, "sprite_id", "left")
    at, a, b = F.col("_at"), F.col("_from"), F.col("_to")
    new = F.when(a.isNull(), at).when(at == a, b).when((a < b) & (at > a) & (at <= b), at - 1).when((b < a) & (at >= b) & (at < a), at + 1).otherwise(at)
    return out.withColumn("z", new.cast("int")).select(layers.columns)


def add_groups(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (sprite_id, layer_id, group_id, wrap) -> layers with a new group right above the layer, beside it, and a dense z from 0.

    With wrap the layer goes into the group. A layer that is missing is not wrapped; a bare group
    is then at the bottom of the top level.
    """
    flat = Window.partitionBy("sprite_id").orderBy("z", "layer_id")
    rows = layers.withColumn("_at", F.row_number().over(flat) - 1)
    e = edits.select("sprite_id", "layer_id", "group_id", "wrap").join(rows.select("sprite_id", "layer_id", F.col("parent_id").alias("_up"), F.col("_at").alias("_below")), ["sprite_id", "layer_id"], "left")
    e = e.where("NOT wrap OR _below IS NOT NULL").withColumn("_below", F.coalesce("_below", F.lit(-1)))
    out = rows.join(e.select("sprite_id", F.col("layer_id").alias("_layer"), F.col("group_id").alias("_group"), "wrap", "_below"), "sprite_id", "left")
    shift = F.coalesce((F.col("_at") > F.col("_below")).cast("int"), F.lit(0))
    inside = F.coalesce(F.col("wrap") & (F.col("layer_id") == F.col("_layer")), F.lit(False))
    out = out.withColumns({"z": (F.col("_at") + shift).cast("int"), "parent_id": F.when(inside, F.col("_group")).otherwise(F.col("parent_id"))}).select(layers.columns)
    groups = e.select("sprite_id", F.col("group_id").alias("layer_id"), F.col("_up").alias("parent_id"), F.lit("group").alias("kind"), (F.col("_below") + 1).cast("int").alias("z"))
    return out.unionByName(groups, allowMissingColumns=True).select(layers.columns)


def with_properties(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (sprite_id, layer_id, and any columns of layers) -> layers with what an edit names and is not null."""
    keys = ["sprite_id", "layer_id"]
    named = [c for c in edits.columns if c not in keys]
    out = layers.join(edits.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in named)), keys, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in named else F.col(c) for c in layers.columns))


def released_cels(cels: DataFrame, removed: DataFrame) -> DataFrame:
    """Cels (cel_id, linked_to) whose buffers go with the removed ones (cel_id): neither links themselves nor linked to by a cel that stays."""
    staying = cels.join(removed.select("cel_id"), "cel_id", "left_anti").where("linked_to IS NOT NULL").select(F.col("linked_to").alias("cel_id"))
    return cels.join(removed.select("cel_id"), "cel_id", "left_semi").where("linked_to IS NULL").join(staying, "cel_id", "left_anti").select("cel_id")
