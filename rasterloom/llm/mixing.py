"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets the exponential key -ln(u) / w, where u is a hash of its doc_id
and w its quality weight. A source whose target is t times its size is taken floor(t)
times whole; the rest of its budget goes to its documents in the order of their keys,
up to the document whose middle passes the budget.

No source is sorted in one task. A source is dealt into buckets of about BUCKET_ROWS
documents by the quantile of the key; sums of buckets find the one bucket in which the
budget ends, and only that one is sorted. What decides about a document is then a row
per source: its epochs and the last key taken. The text is never shuffled.

Defined results: a null text has size 0 and weight 1; a null source is a source of its
own, last in order; documents that share a doc_id, or have none and share a text, share a
key and are taken or left together; a very long text is one row, of
which the taken words differ from the target by at most half; an empty table gives an
empty result; other columns, whatever their names, pass through mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch, columns, free_names, small_side

#: A word: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Most times that a source, and so a document, is taken.
MAX_EPOCHS = 3
#: Documents in a bucket, about.
BUCKET_ROWS = 4_000
#: Signs whose share lowers a document's quality weight.
JUNK = "#$%&*@^~|<>{}[]=+_"
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: falls with the share of junk signs; 1 for a null or empty text."""
    n = F.length(text)
    clean = F.length(F.translate(text, JUNK, ""))
    return F.when(n > 0, 0.25 + 0.75 * clean / n).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / w with u in (0, 1) from 52 bits of the MD5 of seed and doc_id, or for a null doc_id the text's MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(
        "source",
        word_count(F.col("text")).alias("size"),
        sampling_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), seed).alias("key"),
    )


def _bucket(key: Column, buckets: Column) -> Column:
    """Of the exponential distribution's quantile of the key; larger keys never go to a smaller bucket."""
    return F.least(F.floor((1 - F.exp(-key)) * buckets), buckets - 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """source, n, source_size -> and target: shares by weight, none above most times its size.

    With the sources in order of cap / weight, the common level is the largest of
    (all - caps before) / (weights from here on); a target is the smaller of the cap and
    the level times the weight. The windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sizes.withColumns({"w": w, "cap": cap})
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least("cap", F.col("level") * F.col("w")).cast("double"))
        .select("source", "n", "source_size", "target")
    )


def mixing_plan(spark: SparkSession, docs: DataFrame, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """A row per source: source_size, target, epochs, buckets, last_bucket and last_key of the fractional part."""
    scratch = Scratch(spark, "mixing")
    rows = scratch.save(_measured(docs, seed), "measured")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        source_targets(sizes, weights)
        .withColumn("epochs", F.least(whole, F.lit(MAX_EPOCHS)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).cast("long"))
    )
    plan = scratch.save(plan, "targets")
    n = plan.count()
    p = plan.select(F.col("source").alias("of"), "buckets", "rest")
    placed = rows.join(small_side(p, n), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", _bucket(F.col("key"), F.col("buckets")))
    sums = placed.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("source").alias("of"), F.col("bucket").alias("last_bucket"), "before")
    )
    last = scratch.save(last, "last")
    inside = (
        placed.join(small_side(last, n), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("last_bucket")))
        .groupBy("source", "key", "before", "rest")
        .agg(F.sum("size").alias("size"))
    )
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        inside.withColumn("middle", F.col("before") + F.sum("size").over(upto) - F.col("size") / 2)
        .where(F.col("middle") <= F.col("rest"))
        .groupBy(F.col("source").alias("of"))
        .agg(F.max("key").alias("last_key"))
    )
    out = (
        plan.join(last.drop("before"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        .join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "n", "rest")
    )
    out = scratch.save(out, "plan")
    scratch.drop(rows, plan, last)
    return out


def _decided(spark: SparkSession, docs: DataFrame, seed: str, weights: tuple[float, ...]) -> tuple[DataFrame, Column, Column]:
    """docs beside their sources' plan; the plan, and how often each row is taken."""
    plan = mixing_plan(spark, docs, seed, weights)
    of, plan_, key = free_names(docs, "of", "plan", "key")
    side = plan.select(F.col("source").alias(of), F.struct(*[c for c in plan.columns if c != "source"]).alias(plan_))
    out = docs.join(small_side(side, plan.count()), F.col("source").eqNullSafe(F.col(of)))
    out = out.withColumn(key, sampling_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), seed))
    p = F.col(plan_)
    picked = (_bucket(F.col(key), p["buckets"]) < p["last_bucket"]) | (F.col(key) <= p["last_key"])
    return out, p, p["epochs"] + (F.coalesce(picked, F.lit(False)) & (p["epochs"] < MAX_EPOCHS)).cast("long")


def mix(spark: SparkSession, docs: DataFrame, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus: every row of docs as many times as it is taken, with the columns of docs."""
    out, _, copies = _decided(spark, docs, seed, weights)
    (times,) = free_names(out, "times")
    return out.withColumn(times, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(columns(docs))


def mix_report(spark: SparkSession, docs: DataFrame, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    out, plan, copies = _decided(spark, docs.select("doc_id", "text", "source"), seed, weights)
    size = word_count(F.col("text"))
    return out.select("doc_id", size.alias("size"), plan["source_size"].alias("source_size"), plan["target"].alias("target"), (copies * size).alias("taken"))


#: DuckDB SQL for mix_report() over documents; the constants are those above.
ORACLE = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE WHEN length(text) > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * length(translate(text, '{JUNK}', '')) / length(text) ELSE 1.0::DOUBLE END AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, {MAX_EPOCHS}::DOUBLE * source_size AS cap FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * w)::DOUBLE AS target FROM levels),
plan AS (SELECT *, least({MAX_EPOCHS}, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS epochs FROM targets),
units AS (SELECT source, key, sum(size) AS size FROM base GROUP BY source, key),
middles AS (SELECT source, key, sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle FROM units)
SELECT b.doc_id, b.size, p.source_size, p.target,
  b.size * (p.epochs + CASE WHEN p.epochs < {MAX_EPOCHS} AND m.middle <= p.target - p.epochs * p.source_size THEN 1 ELSE 0 END)::BIGINT AS taken
FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source
JOIN middles m ON b.source IS NOT DISTINCT FROM m.source AND b.key = m.key
"""
