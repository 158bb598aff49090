"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in . ! or ?, or before a line feed; one of more
than LONG words is cut after words that end in a comma, semicolon or colon, and what is
still longer is cut after words whose hash, with the word before, is least among NEAR
words on both sides, so that a passage is cut at the same places in any sentence; where
no hash is least, as in one word repeated, it is cut every LONG words. From every sentence on, the shortest run of at least two
consecutive sentences with SPAN_WORDS words is hashed in 128 bits, blind to case and
white space. Runs that occur more than once are found by one grouped minimum, and every
sentence covered by an occurrence other than the first (by doc_id and place) is removed,
with the white space behind it. So a passage that is repeated keeps its first copy.

Only runs that repeat are joined back, by a join that Spark may split where a run is very
frequent; what is joined grows with the corpus, so nothing is broadcast by hand. A document's list of removed
sentences is no longer than the document.

Defined results: a null text stays null, with no sentences; texts of two sentences with
fewer than SPAN_WORDS words, or of one, have no run and stay as they are; rows that share a doc_id and a
text count as the same document, so each keeps what the other keeps; rows that share a
doc_id, or have none, with other texts are documents of their own, ordered by a hash of
the text; a very long text is handled alone, whole, and its sentences are cut alike; ties
of doc_id and place cannot be; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch
from rasterloom.llm.words import mix, signed, span_hashes, text_chunks, word_spans

SENTENCES, SPAN_WORDS, LONG, NEAR = 3, 20, 25, 4


def content_cuts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word's hash with the word before is least among NEAR words on both sides within its text."""
    n = len(h)
    before = np.zeros(n, np.uint64)
    before[1:] = h[:-1]
    before[first[:-1][np.diff(first) > 0]] = 0
    key = mix(before * np.uint64(0x9FB21C651E98DF25) + h)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.ones(n, bool)
    for d in range(1, min(NEAR, n - 1) + 1):
        apart = text[d:] != text[:-d]
        less = key[d:] < key[:-d]
        out[d:] &= less | apart
        out[:-d] &= ~less | apart
    return out


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, words' first per text, each sentence's first word (one more at the end), sentences' first per text."""
    starts, ends, first = word_spans(data, off)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    feeds = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=feeds[1:])
    last = data[ends - 1]
    stop = np.isin(last, (46, 33, 63))
    stop[:-1] |= feeds[starts[1:]] > feeds[ends[:-1]]
    stop[first[1:][first[1:] > 0] - 1] = True
    for way in ("marks", "content", "count"):
        heads = np.concatenate([[0], np.flatnonzero(stop) + 1])
        size = np.diff(heads)
        long = np.repeat(size > LONG, size)
        if not long.any():
            break
        if way == "marks":
            soft = np.isin(last, (44, 59, 58))
        elif way == "content":
            soft = content_cuts(span_hashes(data, starts, ends), first)
        else:
            soft = (np.arange(n) - np.repeat(heads[:-1], size)) % LONG == LONG - 1
        stop |= long & soft
    heads = np.concatenate([[0], np.flatnonzero(stop) + 1])
    return starts, ends, first, heads, np.searchsorted(heads[:-1], first)


#: Primes and bases of the four polynomials of a run's words; each has 31 bits, so no sum of 2**33 terms overflows.
FIELDS = ((2147483647, 1389796513), (2147483629, 977241187), (2147483587, 2036401361), (2147483579, 1703119877))


def powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
        k += m
    return out[:n]


def spans(word_hash: np.ndarray, heads: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, end sentence and 128-bit hash of each text's spans."""
    n, text_end = len(heads) - 1, np.repeat(of_text[1:], np.diff(of_text))
    place, fewer = np.arange(n), SENTENCES - 1
    inside = place + fewer <= text_end
    wordy = np.zeros(n + 1, bool)
    wordy[:n] = inside & (heads[np.minimum(place + fewer, n)] - heads[:-1] >= SPAN_WORDS)
    short = np.flatnonzero(wordy[:n])
    whole = np.flatnonzero((place + SENTENCES <= text_end) & ~(wordy[:n] & wordy[1:]))
    ok, end = np.concatenate([short, whole]), np.concatenate([short + fewer, whole + SENTENCES])
    a, b, out = heads[ok], heads[end], []
    for prime, base in FIELDS:
        p = np.uint64(prime)
        sums = np.zeros(len(word_hash) + 1, np.uint64)
        np.cumsum(mix(word_hash ^ np.uint64(base)) % p * powers(base, prime, len(word_hash)) % p, out=sums[1:])
        out.append((sums[b] - sums[a]) % p * powers(pow(base, -1, prime), prime, len(word_hash) + 1)[a] % p)
    size = (b - a).astype(np.uint64)
    return ok, end, mix((out[0] << np.uint64(32) | out[1]) ^ size), mix((out[2] << np.uint64(32) | out[3]) ^ size)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in text_chunks(b.column("text")):
            starts, ends, _, heads, of_text = sentences(data, off)
            if not len(starts):
                continue
            at, end, h1, h2 = spans(span_hashes(data, starts, ends), heads, of_text)
            text = np.searchsorted(of_text, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, j - i).take(pa.array(text)), b.column("k").slice(i, j - i).take(pa.array(text)), pa.array((at - of_text[text]).astype(np.int32)), pa.array((end - at).astype(np.int32)), pa.array(signed(h1)), pa.array(signed(h2))],
                ["doc_id", "k", "at", "n", "h1", "h2"],
            )


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in text_chunks(b.column("text")):
            starts, _, _, heads, of_text = sentences(data, off)
            rows = b.column("removed").slice(i, j - i)
            null = b.column("text").slice(i, j - i).is_null()
            texts, removed = [], np.zeros(j - i, np.int32)
            for k in range(j - i):
                a, z = int(off[k]), int(off[k + 1])
                runs = rows[k].as_py()
                if null[k].as_py() or not runs:
                    texts.append(None if null[k].as_py() else data[a:z].tobytes().decode("utf-8", "replace"))
                    continue
                lo, n = int(of_text[k]), int(of_text[k + 1] - of_text[k])
                gone = np.zeros(n + 1, np.int64)
                for r in runs:
                    gone[r["at"]] += 1
                    gone[min(n, r["at"] + r["n"])] -= 1
                gone = np.cumsum(gone)[:n] > 0
                removed[k] = gone.sum()
                edge = np.append(starts[heads[lo : lo + n]], z)  # the end of a sentence's piece is the start of the next
                pieces = [data[a : edge[0]].tobytes()] + [data[edge[s] : edge[s + 1]].tobytes() for s in np.flatnonzero(~gone)]
                texts.append(b"".join(pieces).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(texts, pa.string()), pa.array(np.diff(of_text).astype(np.int32)), pa.array(removed)], ["doc_id", "text", "n_sentences", "n_removed"])


def dedup_substrings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text without repeated sentences, n_sentences before, n_removed."""
    scratch = Scratch(spark, "substrings")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    found = scratch.save(texts.mapInArrow(_spans, "doc_id long, k long, at int, n int, h1 long, h2 long"), "spans")
    repeated = (
        found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "k", "at")).alias("first")).where("times > 1")
        .select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    )
    repeated = scratch.save(repeated, "repeated", release=True)
    covered = found.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k") == F.col("first.k")) & (F.col("at") == F.col("first.at"))))
    removed = covered.groupBy(F.col("doc_id").alias("of"), F.col("k").alias("ok")).agg(F.collect_set(F.struct("at", "n")).alias("removed"))
    rows = texts.join(removed, (F.col("k") == F.col("ok")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "removed")
    return rows.mapInArrow(_clean, "doc_id long, text string, n_sentences int, n_removed int")
