"""Language identification by interpolated Kneser-Ney character models.

Texts are seen as lower-cased letters with one space for anything between. For every
language an ORDER-gram model is trained on a bounded sample: the SAMPLE_DOCS labelled
documents of the language with the smallest hashes, whole. A model is a
few sorted arrays of hashed n-grams with the log probability of each n-gram that was seen
and the back-off weight of each history; unseen n-grams back off to shorter ones, down to
a uniform floor. A text gets the language with the lowest cross-entropy per character.

A part of the sample is held out of training to calibrate: the score is the share of the
best language when the languages' log probabilities, scaled by a temperature chosen for
least log loss, are normalised; and a text is rejected if it has no letter, or if its
cross-entropy is REJECT standard deviations above what the language's held-out texts have.

Counting happens per language on the executors, over SAMPLE_DOCS documents each; models
are collected (their number is that of the languages) and broadcast.

Defined results: a null text, or one without a letter, is `und` with score 0; with no
labelled row every text is; languages that tie go to the first by name; repeated rows are
predicted each; a very long text is handled alone, whole; columns named as the results are
replaced, all others pass through; an empty table gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm.scratch import columns, share
from rasterloom.llm.words import give_back, mix, text_chunks

ORDER = 4
DISCOUNT = 0.75
#: Labelled documents of a language that its model is trained and calibrated on.
SAMPLE_DOCS = 400
#: One of so many sampled documents calibrates.
HELD = 5
REJECT = 8.0
UNKNOWN = "und"
#: Bytes of text predicted at a time; some twenty arrays of eight bytes a letter are alive then.
CHUNK = 1 << 18
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)


class Letters:
    """Code point -> lower-cased letter, or a space for all else; filled as code points are met."""

    def __init__(self):
        self.to = np.full(0x110000, -1, np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        new = self.to[points] < 0
        if new.any():
            for p in np.unique(points[new]).tolist():
                c = chr(p)
                low = c.lower()
                self.to[p] = (ord(low) if len(low) == 1 else p) if c.isalpha() else 32
        return self.to[points]


def letters_of(data: np.ndarray, off: np.ndarray, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters with single spaces between and one before, all in a row, and each text's first place."""
    n = len(off) - 1
    whole = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    first_bytes = (data & 0xC0) != 0x80
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first_bytes, out=at[1:])
    place = np.minimum(at[off], len(whole))
    x = np.full(len(whole) + n, 32, np.int32)
    x[np.arange(len(whole)) + np.repeat(np.arange(1, n + 1), np.diff(place))] = letters(whole)
    place = place + np.arange(n + 1)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[place[:-1]] = True
    upto = np.zeros(len(x) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    return x[keep].astype(np.uint64), upto[place]


def gram_codes(x: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """For each place the hash of the size letters that end there; places before the text count as spaces."""
    code = np.zeros(len(x), np.uint64)
    inside = np.arange(len(x)) - np.repeat(first[:-1], np.diff(first))
    for k in range(size - 1, -1, -1):
        back = np.full(len(x), 32, np.uint64)
        back[k:] = x[: len(x) - k] if k else x
        code = code * np.uint64(0x9FB21C651E98DF25) + np.where(inside >= k, back, np.uint64(32)) + np.uint64(1)
    return mix(code)


class Grams:
    """Distinct n-grams of texts met piece by piece: for each order sorted hashes, those of their histories and of the n-grams without their first letter, and for the longest their counts.

    What is held grows with the distinct n-grams and the piece, not with the text.
    """

    def __init__(self):
        self.of = {k: [np.empty(0, np.uint64)] * 3 + [np.empty(0, np.int64)] for k in range(1, ORDER + 1)}

    def add(self, x: np.ndarray, first: np.ndarray) -> None:
        own = np.ones(len(x), bool)
        own[first[:-1][np.diff(first) > 0]] = False  # the space before a text is given, not predicted
        own = np.flatnonzero(own)
        shorter = np.zeros(len(x), np.uint64)
        for k in self.of:
            code = gram_codes(x, first, k)
            c, at, n = np.unique(code[own], return_index=True, return_counts=True)
            at = own[at]
            self._merge(k, c, shorter[at - 1] if k > 1 else shorter[at], shorter[at], n)
            shorter = code

    def _merge(self, k: int, code: np.ndarray, history: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> None:
        code, history, suffix, n = (np.concatenate(both) for both in zip(self.of[k], (code, history, suffix, n), strict=True))
        c, at, inverse = np.unique(code, return_index=True, return_inverse=True)
        self.of[k] = [c, history[at], suffix[at], np.bincount(inverse, n, len(c)).astype(np.int64)]


class Model:
    """Sorted hashes of n-grams by order: log10 probability if seen; sorted hashes of histories: log10 back-off weight."""

    def __init__(self, grams: Grams):
        self.seen, self.back = [], []
        below_c = below_p = None
        for k, (c, history, suffix, n) in grams.of.items():
            if k < ORDER:  # continuation counts: distinct letters before
                n = np.bincount(np.searchsorted(c, grams.of[k + 1][2]), minlength=len(c))
            h, inv = np.unique(history, return_inverse=True)
            total, kinds = np.bincount(inv, n), np.bincount(inv)
            weight = DISCOUNT * kinds / np.maximum(total, 1)
            if k == 1:
                lower = 1 / (len(c) + 1)  # a uniform floor, with a share for letters never seen
                self.floor = np.log10(np.maximum(weight[0] * lower if len(weight) else 1, 1e-12))
            else:
                lower = below_p[np.searchsorted(below_c, suffix)]
            p = np.maximum(n - DISCOUNT, 0) / np.maximum(total[inv], 1) + weight[inv] * lower
            self.seen.append((c, np.log10(p)))
            self.back.append((h, np.log10(np.maximum(weight, 1e-12))))
            below_c, below_p = c, p

    @classmethod
    def of(cls, state: dict) -> Model:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def log_p(self, codes: list[np.ndarray], histories: list[np.ndarray]) -> np.ndarray:
        """log10 probability of the last letter, given codes[k] of the last k + 1 letters and histories[k] of the k before it."""
        out = np.full(len(codes[0]), self.floor)
        for k, ((c, p), (h, w), code, hist) in enumerate(zip(self.seen, self.back, codes, histories, strict=True)):
            if not len(c):
                continue
            i = np.minimum(np.searchsorted(h, hist), len(h) - 1)
            known = h[i] == hist
            j = np.minimum(np.searchsorted(c, code), len(c) - 1)
            # the floor holds the weight of the empty history
            out = np.where(c[j] == code, p[j], out + (np.where(known, w[i], 0) if k else 0))
        return out


class Identifier:
    """Models and calibration of all languages."""

    def __init__(self, models: dict[str, Model], limits: dict[str, tuple[float, float]] | None = None, temperature: float = 0.1):
        self.languages, self.models = sorted(models), [models[k] for k in sorted(models)]
        self.limits, self.temperature = limits or {}, temperature

    def entropies(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages: minus log10 probability per letter; and the texts' letters."""
        own = np.ones(len(x), bool)
        own[first[:-1][np.diff(first) > 0]] = False
        n = np.diff(first) - 1
        longest = gram_codes(x, first, ORDER)
        _, at, inverse = np.unique(longest, return_index=True, return_inverse=True)
        codes = [gram_codes(x, first, k) for k in range(1, ORDER + 1)]
        hist = [np.zeros(len(x), np.uint64)] + [np.concatenate([np.zeros(1, np.uint64), c[:-1]]) for c in codes[:-1]]
        # the first letter of a text has the space before it as history, never the text before
        codes, hist = [c[at] for c in codes], [h[at] for h in hist]
        out = np.zeros((len(n), len(self.models)))
        starts = np.minimum(first[:-1], max(len(x) - 1, 0))
        for k, m in enumerate(self.models):
            p = np.where(own, m.log_p(codes, hist)[inverse], 0)
            out[:, k] = -np.add.reduceat(p, starts) / np.maximum(n, 1) if len(x) else 0
        return out, n

    def predict(self, data: np.ndarray, off: np.ndarray, letters: Letters) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejected of each text."""
        x, first = letters_of(data, off, letters)
        has = np.add.reduceat(x != 32, first[:-1]) > 0 if len(x) else np.zeros(len(off) - 1, bool)
        rows = len(off) - 1
        if not self.models:
            return [UNKNOWN] * rows, np.zeros(rows), np.ones(rows, bool)
        e, n = self.entropies(x, first)
        best = e.argmin(1)
        score = self.scores(e, n)
        lang, rejected = [UNKNOWN] * rows, ~has
        for i in np.flatnonzero(has):
            lang[i] = self.languages[best[i]]
            mean, spread = self.limits.get(lang[i], (np.inf, 0.0))
            rejected[i] = e[i, best[i]] > mean + REJECT * (spread + 1 / np.sqrt(max(n[i], 1)))
        return lang, np.where(has, score, 0.0), rejected

    def scores(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        gap = (e - e.min(1, keepdims=True)) * np.maximum(n, 1)[:, None] * np.log(10) * self.temperature
        return 1 / np.exp(-np.minimum(gap, 700)).sum(1)


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sampled documents of one language -> its model, pickled, and its held-out texts."""
    held = pdf["rank"] % HELD == 0
    if held.all():
        held[:] = False
    letters, grams = Letters(), Grams()
    for _, _, data, off in text_chunks(pa.array(pdf.loc[~held, "text"], pa.large_string()), CHUNK):
        grams.add(*letters_of(data, off, letters))
    model = Model(grams)
    texts = pdf.loc[held, "text"].tolist()
    del grams
    give_back()
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "model": [pickle.dumps(model.__dict__)], "held": [texts]})


def train(spark: SparkSession, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Identifier:
    """From rows (doc_id, text, lang) with lang and text not null."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    # first a threshold on the hash that leaves a few times sample_docs rows of a language, then the ranks of these
    key = F.xxhash64("doc_id", "text")
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("l_"), (F.lit(4.0 * sample_docs) / F.col("n")).alias("share"))  # a row per language
    some = rows.withColumn("key_", key).join(F.broadcast(share), F.col("lang") == F.col("l_")).where(F.pmod("key_", F.lit(1 << 40)) < F.col("share") * float(1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key_", F.lit(1 << 40)), "key_"))
    sample = some.select("lang", "text", "key_").withColumn("rank", rank).where(F.col("rank") <= sample_docs)
    out = sample.select("lang", "text", "rank").groupBy("lang").applyInPandas(_train, "lang string, model binary, held array<string>").toPandas()
    models = {r.lang: Model.of(pickle.loads(r.model)) for r in out.itertuples()}
    them = Identifier(models)
    letters, truth, es, ns = Letters(), [], [], []
    for r in out.itertuples():
        for _, _, data, off in text_chunks(pa.array(list(r.held), pa.large_string())):
            x, first = letters_of(data, off, letters)
            e, n = them.entropies(x, first)
            ok = n > 20
            es.append(e[ok]), ns.append(n[ok])
            truth += [them.languages.index(r.lang)] * int(ok.sum())
    if truth:
        e, n, t = np.concatenate(es), np.concatenate(ns), np.array(truth)
        for k, lang in enumerate(them.languages):
            own = e[(t == k) & (e.argmin(1) == k), k]
            if len(own) >= 5:
                them.limits[lang] = (float(own.mean()), float(own.std()))
        losses = {}
        for temperature in TEMPERATURES:
            gap = (e - e.min(1, keepdims=True)) * n[:, None] * np.log(10) * temperature
            p = np.exp(-np.minimum(gap, 700))
            losses[temperature] = -np.log(np.maximum((p / p.sum(1, keepdims=True))[np.arange(len(t)), t], 1e-9)).mean()
        them.temperature = min(losses, key=losses.get)
    return them


def predict(spark: SparkSession, docs: DataFrame, identifier: Identifier) -> DataFrame:
    """docs with lang_pred, score and rejected; columns of docs with these names are replaced."""
    shared = share(spark, identifier)
    own = ("lang_pred", "score", "rejected")
    kept = docs.select([c for c, name in zip(columns(docs), docs.columns, strict=True) if name.lower() not in own])
    names = kept.columns
    plain = kept.toDF(*(f"c{k}" for k in range(len(names))))
    at = [c.lower() for c in names].index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        them, letters = pickle.loads(shared.value), Letters()
        for b in batches:
            for i, j, data, off in text_chunks(b.column(at), CHUNK):
                lang, score, rejected = them.predict(data, off, letters)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*part.schema.names, *own])
        give_back()

    schema = StructType(list(plain.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return plain.mapInArrow(f, schema).toDF(*names, *own)


def held_out():
    """crc32 of the doc_id as text is 1 modulo 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    identifier = train(spark, docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(spark, docs.select("doc_id", "text"), identifier).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
