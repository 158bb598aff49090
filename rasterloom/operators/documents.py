"""Operators on documents: layer trees, frames, tags, tiles, edit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def layer_tree(spark: SparkSession, layers: DataFrame) -> DataFrame:
    """(layer_id, parent_id, z, visible) -> with depth, path (z from the root) and whether all ancestors are visible.

    Every level is a join with the one above, however deep; layers whose ancestors run in a
    circle or are missing are below no root and left out. Layers of all documents may be
    more than Spark's bound on rows of a recursion, so the session's bound is lifted.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql("""WITH RECURSIVE t(layer_id, depth, path, shown) MAX RECURSION LEVEL 1000000 AS (
      SELECT layer_id, 0, array(z), visible FROM {layers} WHERE parent_id IS NULL
      UNION ALL SELECT c.layer_id, t.depth + 1, array_append(t.path, c.z), t.shown AND c.visible FROM {layers} c JOIN t ON c.parent_id = t.layer_id)
      SELECT * FROM t""", layers=layers)


def clip_base(layers: DataFrame) -> DataFrame:
    """layers with base_z: the nearest layer below that contributes and does not clip; a clipping layer without one drops."""
    own = F.when(~F.col("clipping") & F.col("contributes"), F.col("z"))
    below = Window.partitionBy("sprite_id").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    out = layers.withColumn("base_z", F.when(F.col("clipping"), F.last(own, ignorenulls=True).over(below)))
    return out.where("contributes AND (NOT clipping OR base_z IS NOT NULL)")


def play_order(n_from: Column, n_to: Column, direction: Column) -> Column:
    """Frame positions of a tag in the order they play; a ping-pong does not repeat its ends."""
    run = F.sequence(n_from, n_to)
    inner = F.reverse(F.slice(run, F.lit(2), F.greatest(F.size(run) - 2, F.lit(0))))
    return F.when(direction == "reverse", F.reverse(run)).when((direction == "pingpong") & (F.size(run) > 2), F.concat(run, inner)).otherwise(run)


def onion_frames(frames: Column, active: Column, before: int, after: int) -> Column:
    """(frame, distance) of the ghosts around the active frame, circular; each frame once, backward first; a taken frame ends its direction."""
    at = lambda k: F.pmod(active + k, frames).cast("int")
    back = F.least(F.lit(before), frames - 1)
    forth = F.greatest(F.lit(0), F.least(F.lit(after), frames - 1 - back))
    steps = F.concat(F.transform(F.filter(F.sequence(F.lit(0), F.lit(before)), lambda k: (k > 0) & (k <= back)), lambda k: -k), F.filter(F.sequence(F.lit(0), F.lit(after)), lambda k: (k > 0) & (k <= forth)))
    return F.transform(steps, lambda k: F.struct(at(k).alias("frame"), k.alias("distance")))


def coalesce_runs(log: DataFrame, by: str, key: str, order: str) -> DataFrame:
    """Runs of neighbouring log entries of the same key, per owner: run, key, entries, first and last entry."""
    w = Window.partitionBy(by).orderBy(order)
    starts = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1))
    runs = log.withColumn("_start", starts).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run", key).agg(F.count(F.lit(1)).alias("entries"), F.min(order).alias("first"), F.max(order).alias("last"))


def keep_last(log: DataFrame, by: str, order: str, cost: Column, most: int, budget: float) -> DataFrame:
    """Of each owner's log the latest entries: at most `most` and within the budget, but always one."""
    back = Window.partitionBy(by).orderBy(F.desc(order))
    rows = log.withColumns({"_n": F.row_number().over(back), "_cost": F.sum(cost).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("_n") == 1) | ((F.col("_n") <= most) & (F.col("_cost") <= budget))).drop("_n", "_cost")


def latest_wins(requests: DataFrame, by: str, order: str, busy: int) -> DataFrame:
    """Requests that run when each takes `busy` sequence numbers, one runs at a time and a newer one replaces the one that waits.

    Written as an ordered fold over each owner's requests, an array at a time.
    """
    state = F.struct(F.lit(-(1 << 40)).cast("long").alias("free"), F.lit(None).cast("long").alias("waits"), F.array().cast("array<bigint>").alias("ran"))

    def step(s: Column, e: Column) -> Column:
        start = s["waits"].isNotNull() & (s["free"] <= e)
        free = F.when(start, s["free"] + busy).otherwise(s["free"])
        ran = F.when(start, F.array_append(s["ran"], s["waits"])).otherwise(s["ran"])
        idle = free <= e
        return F.struct(F.when(idle, e + busy).otherwise(free).alias("free"), F.when(idle, F.lit(None).cast("long")).otherwise(e).alias("waits"), F.when(idle, F.array_append(ran, e)).otherwise(ran).alias("ran"))

    done = lambda s: F.when(s["waits"].isNotNull(), F.array_append(s["ran"], s["waits"])).otherwise(s["ran"])
    return requests.groupBy(by).agg(F.array_sort(F.collect_list(F.col(order).cast("long"))).alias("all")).select(by, F.explode(F.aggregate("all", state, step, done)).alias(order))


#: Least and largest side of a document.
SIDES = (1, 4096)


def blank(sizes: DataFrame) -> DataFrame:
    """Pixels of new documents (sprite_id, width, height), all clear: sizes are brought into bounds, then rounded."""
    side = lambda c: F.floor(F.greatest(F.lit(SIDES[0]), F.least(F.lit(SIDES[1]), F.col(c))) + 0.5).cast("int")
    rows = sizes.select("sprite_id", F.explode(F.sequence(F.lit(0), side("height") - 1)).alias("y"), side("width").alias("_w"))
    return rows.select("sprite_id", "y", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("x"), *(F.lit(0).alias(c) for c in "rgba"))
