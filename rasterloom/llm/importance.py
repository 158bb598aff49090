"""Importance resampling towards a target corpus by hashed n-gram features, with Gumbel keys.

Features are runs of 1 to n consecutive words. No n-gram string is ever made: each word's
CRC-32 is computed once, and the CRC of a run is composed from those of its words, as
crc(A B) = M**len(B) crc(A) xor crc(B), where M is the GF(2) matrix that shifts a CRC by
one zero byte. M's powers are kept as four look-up tables of 256 entries each: one set for
every shift below SHORT bytes and one for every power of two above, so a word of any length
is composed alike.

One pass counts every document's features into buckets, summed before they are shuffled
(a row per bucket and task at most), and so does one over the target. What is sent to the
workers is a gain per bucket, whose number is the parameter `buckets`. A second pass gives
each document's weight. The draw is the order of (not eligible, -score, doc_id) by a
range-partitioned sort of narrow rows, as in sharding.numbered(); no rows meet in one task.

Defined results: a null or blank text has no words, weight 0 and is not eligible; a null
doc_id is the empty string in the key and comes first among equal scores; rows that repeat
a doc_id have one Gumbel key, and take neighbouring ranks if their scores are equal, in the
order of their feature counts; a very long text is one row, whose words are handled in one
piece; an empty target or table gives gains of what is there, or no rows; columns of any
other name pass through resample(), those named as its results are replaced.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch, columns, free_names, share
from rasterloom.llm.sharding import numbered
from rasterloom.llm.words import _LOWER, text_chunks, word_spans

WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes below which every shift has tables of its own, and bits of the longest shift.
SHORT, LONGEST_BITS = 64, 40
#: Bytes from which on a word's CRC is computed by itself.
LONG_WORD = 256

_SEPARATES = np.ones(256, bool)
_SEPARATES[0x30:0x3A] = _SEPARATES[0x41:0x5B] = _SEPARATES[0x61:0x7B] = _SEPARATES[0x80:] = False


def _byte_table() -> np.ndarray:
    """CRC register after each byte, from an empty register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


_BYTE = _byte_table()


def _times(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The matrix of these four tables times each CRC."""
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _tables(columns_: np.ndarray) -> np.ndarray:
    """The four tables of a matrix given by its 32 columns."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(np.arange(256) >> bit & 1, columns_[8 * k + bit], 0).astype(np.uint32)
    return out


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables of M**0 to M**(SHORT - 1), and of M**(2**k) for each k below LONGEST_BITS."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = _tables(_BYTE[unit & 255] ^ (unit >> 8))
    short, cols = [], unit
    for _ in range(SHORT):
        short.append(_tables(cols))
        cols = _times(one, cols)
    doubled = [one]
    for _ in range(LONGEST_BITS - 1):
        doubled.append(_tables(_times(doubled[-1], _times(doubled[-1], unit))))
    return np.array(short), np.array(doubled)


_SHORT, _DOUBLED = _shifts()


def shift(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC moved by so many zero bytes."""
    low = by & (SHORT - 1)
    out = _SHORT[low, 0, crc & 255] ^ _SHORT[low, 1, (crc >> 8) & 255] ^ _SHORT[low, 2, (crc >> 16) & 255] ^ _SHORT[low, 3, crc >> 24]
    far = np.flatnonzero(by >= SHORT)
    bit = SHORT.bit_length() - 1
    while len(far):
        now = far[(by[far] >> bit & 1) == 1]
        out[now] = _times(_DOUBLED[bit], out[now])
        bit += 1
        far = far[by[far] >> bit > 0]
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span, all spans a byte at a time; a very long one by itself."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    rest, k = np.flatnonzero(size < LONG_WORD), 0
    rest = rest[np.argsort(-size[rest], kind="stable")]
    left = -size[rest]  # ascending, so the words with more than k bytes are a head of rest
    while True:
        rest = rest[: np.searchsorted(left, -k, "left")]
        left = left[: len(rest)]
        if not len(rest):
            break
        c = out[rest]
        out[rest] = _BYTE[(c ^ data[starts[rest] + k]) & 255] ^ (c >> 8)
        k += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size >= LONG_WORD):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def run_crcs(crc: np.ndarray, size: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For 1 to n: the CRC of every run of so many consecutive words joined by one space."""
    space = np.uint32(zlib.crc32(b" "))
    run = crc
    for m in range(1, n + 1):
        if m > 1:
            head, last = run[: max(0, len(crc) - m + 1)], slice(m - 1, None)
            run = shift(_times(_DOUBLED[0], head) ^ space, size[last]) ^ crc[last]
        yield run


def _features(data: np.ndarray, off: np.ndarray, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of runs: the bucket of every run inside a text, the text it belongs to, and words per text."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, off, _SEPARATES[data])
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    for m, run in enumerate(run_crcs(word_crcs(data, starts, ends), ends - starts, n), 1):
        inside = text[: len(run)] == text[m - 1 : m - 1 + len(run)]
        yield (run[inside] % np.uint32(buckets)).astype(np.int64), text[: len(run)][inside], np.diff(first)


def _counts(n: int, buckets: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, off in text_chunks(b.column("text")):
                for at, _, _ in _features(data, off, n, buckets):
                    held += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    return f


def bucket_counts(texts: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has some."""
    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(n, buckets), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Of every bucket: 1000 times the log of the smoothed target share over the corpus share, floored. Two counts a bucket are collected."""
    sides = bucket_counts(docs, n, buckets).withColumn("side", F.lit(0)).union(bucket_counts(target, n, buckets).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets))
    for r in sides.collect():  # at most 2 * buckets rows
        counts[r.side, r.bucket] = r.n
    s, t = counts
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weights(n: int, buckets: int, sent: Broadcast):
    kind = pa.struct([("words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gain = pickle.loads(sent.value)
        for col in batches:
            words, many, total = (np.zeros(len(col), np.int64) for _ in range(3))
            for i, j, data, off in text_chunks(col):
                for at, text, per in _features(data, off, n, buckets):
                    words[i:j] = per
                    many[i:j] += np.bincount(text, minlength=j - i)
                    order = np.concatenate([[0], np.cumsum(gain[at])])  # texts come one after the other
                    edge = np.searchsorted(text, np.arange(j - i + 1))
                    total[i:j] += order[edge[1:]] - order[edge[:-1]]
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(many), pa.array(weight)], fields=list(kind))

    return F.arrow_udf(f, "struct<words: long, n_features: long, weight: long>")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


RESULTS = ("n_features", "weight", "score", "rank")


def _ranked(spark: SparkSession, docs: DataFrame, target: DataFrame, kept: list[Column], n: int, buckets: int, least_words: int, percent: int, seed: int) -> DataFrame:
    scratch = Scratch(spark, "importance")
    sent = share(spark, gains(docs, target, n, buckets))
    w, score, late, down = free_names(docs, "weights", "score", "late", "down")
    rows = docs.withColumn(w, _weights(n, buckets, sent)(F.col("text").cast("string"))).withColumn(score, F.col(f"{w}.weight") + gumbel(F.col("doc_id"), seed))
    rows = rows.select(*kept, w, score, (F.col(f"{w}.words") < least_words).alias(late), (-F.col(score)).alias(down))
    many = f"_many_{w}"
    rows, number, _ = numbered(spark, rows.withColumn(many, F.col(f"{w}.n_features")), [late, down, "doc_id", many], scratch)
    # the sorted rows are written, so this count reads one flag
    drawn = percent * rows.where(~F.col(late)).count() // 100
    rank = F.when(F.col(number) < drawn, F.col(number) + 1).cast("long")
    return rows.select(*kept, F.col(f"{w}.n_features").alias("n_features"), F.col(f"{w}.weight").alias("weight"), F.col(score).alias("score"), rank.alias("rank"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with n_features, weight, score and rank."""
    kept = [c for c, name in zip(columns(docs), docs.columns, strict=True) if name.lower() not in RESULTS]
    return _ranked(spark, docs, target, kept, n, buckets, least_words, percent, seed).where(F.col("rank").isNotNull())


def resampling_report(spark: SparkSession, docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs; no text is shuffled."""
    return _ranked(spark, docs, target, [F.col("doc_id")], WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED)


#: CRC-32 of a text column by its bytes, in DuckDB: the byte table is built from the polynomial.
CRC_TABLE = f"""select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, {POLYNOMIAL}) else c >> 1 end)) as steps"""


def crc_sql(text: str) -> str:
    digits = f"hex(encode({text}))"
    each = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295], {each}), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with crc as ({CRC_TABLE}),
words as (
    select 0 as side, row_number() over () as rid, doc_id, coalesce({_WORDS_SQL}, []) as w from documents
    union all select 1, row_number() over (), null, coalesce({_WORDS_SQL}, []) from benchmark
),
runs as (
    select side, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words
),
counted as (select side, rid, f, count(*) as n from runs group by all),
hashed as (select f, {crc_sql("f")} % {BUCKETS} as bucket from (select distinct f from counted), crc),
placed as (select side, rid, bucket, sum(n) as n from counted join hashed using (f) group by all),
sums as (select bucket, sum(case when side = 0 then n else 0 end)::double as s, sum(case when side = 1 then n else 0 end)::double as t from placed group by all),
everything as (select sum(s) as all_s, sum(t) as all_t from sums),
gain as (select bucket, floor(1000 * ln((t + 1) * (all_s + {BUCKETS}) / ((s + 1) * (all_t + {BUCKETS}))))::bigint as gain from sums, everything),
weighed as (select rid, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight from placed join gain using (bucket) where side = 0 group by all),
scored as (
    select w.rid, doc_id, len(w.w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296::double)))::bigint as score
    from words w left join weighed using (rid) where w.side = 0
),
ranked as (select *, row_number() over (partition by words >= {LEAST_WORDS} order by score desc, doc_id nulls first, n_features) as r, count(*) over (partition by words >= {LEAST_WORDS}) as eligible from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when words >= {LEAST_WORDS} and r <= {PERCENT} * eligible // 100 then r end as rank from ranked
"""
