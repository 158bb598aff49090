"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Documents are numbered 0 to n - 1 in the order of (doc_id, CRC-32, size). A Feistel
network over the next even number of bits, walked along its cycle until it falls below
n, permutes the numbers; place p goes to shard p mod k at slot p div k. So shard sizes
differ by one at most (law `rows`), slots have no gaps, and shard and slot of any row
number are computed from (seed, n, k) alone.

Row numbers come from one range-partitioned sort of small columns: the place within the
partition plus the sizes of the partitions before, of which there are as many as shuffle
partitions. The sorted rows are written first, so a rerun task cannot number them anew.

Defined results: a null text has size 1 and CRC-32 0; null doc_ids come first; repeated
rows get neighbouring numbers, their own slots; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch, columns, free_names
from rasterloom.llm.words import mix

SHARDS = 8
SEED = 20240607
ROUNDS = 6


def permute(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Place of each row number below n: a bijection of 0 .. n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed & ((1 << 63) - 1)) * np.uint64(ROUNDS))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def _place(n: int, seed: int):
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(permute(s.to_numpy(np.int64), n, seed))

    return F.pandas_udf(f, "long")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def numbered(spark: SparkSession, rows: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, str, int]:
    """rows with a column of numbers from 0 in the given order, that column's name, and how many rows there are."""
    at, part, first, number = free_names(rows, "at", "part", "first", "number")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # monotonically_increasing_id is the partition in the upper bits and the place in it in the lower 33
    ordered = scratch.save(ordered.withColumn(at, F.monotonically_increasing_id()), "ordered")
    sizes = ordered.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per shuffle partition
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r.part):
        starts.append((r.part, total))
        total += r.n
    firsts = F.broadcast(spark.createDataFrame(starts, f"`{part}` long, `{first}` long"))
    out = ordered.join(firsts, F.shiftright(at, 33) == F.col(part))
    return out.withColumn(number, F.col(first) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), number, total


def _sharded(spark: SparkSession, docs: DataFrame, kept: list[Column], shards: int, seed: int) -> DataFrame:
    crc, size, place = free_names(docs, "crc", "size", "place")
    rows = docs.select(*kept, text_crc(F.col("text")).alias(crc), text_size(F.col("text")).alias(size))
    out, number, n = numbered(spark, rows, ["doc_id", crc, size], Scratch(spark, "sharding"))
    return out.withColumn(place, _place(n, seed)(F.col(number))).select(
        *kept, F.col(size).alias("size"), F.col(crc).alias("text_crc32"), F.lit("rows").alias("law"),
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(F.col(place) / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard; columns of docs with these names are replaced."""
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return _sharded(spark, docs, [c for c, name in zip(columns(docs), docs.columns, strict=True) if name.lower() not in own], shards, seed)


def shard_report(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """As shard(), with doc_id alone of the columns of docs; no text is shuffled."""
    return _sharded(spark, docs, [F.col("doc_id")], shards, seed)
