"""Language-model scoring by a probabilistic suffix tree over words.

Tokens are the words of a text, A-Z lower-cased, then one end. The root of the tree is
the base distribution (c + 0.1) / (N + 0.1 (V + 1)). A context of one to ORDER - 1 words
becomes a state if it occurs CONTEXT_COUNT times in training, whatever the corpus size,
its shorter suffix is a state, and the likelihood-ratio statistic of its next words
against those of the suffix is large enough (the divergence test). A state keeps the
next words seen NEXT_COUNT times after it; its distribution is smoothed by WEIGHT
pseudo-counts of its suffix's, and what it does not keep shares the remaining mass in the
suffix's proportions, so each sums to 1. A token is scored by the longest suffix of the
words before it that is a state.

1. Counts: blocks of BLOCK_WORDS tokens are counted in the tasks and summed by one
   grouped sum, words first, then n-grams of two to ORDER words, one order at a time. An
   n-gram takes part if its context may have the count and its suffix may be kept, by
   filters of at most 2**FILTER_BITS bits: these let some others pass, which the joins drop.
   Where many contexts have the count, n-grams are counted in parts by their hash, each with
   a reading of the texts, so that about COUNT_SHARE of the tokens is shuffled at a time.
2. The tree is made order by order by joins of tables of counts; states and kept next
   words grow with the corpus and stay in tables.
3. Scores are sums over the n-grams of a text: a state adds the log of its weight of
   what it does not keep, a kept next word the log of its probability over what the
   suffix would have given with that weight; the sum telescopes to the longest state's.
4. Words and n-grams above HOT_SHARE of the tokens (at most ORDER / HOT_SHARE) go to the
   tasks. The occurrences of others are joined with their table, and their sums added to
   their documents. No key in that join makes up more than HOT_SHARE, so none is hot.
   Every document is read once for this, in SLICES parts of the corpus one after the
   other, so that the occurrences of one part only are on disk; each part meets the
   whole table.

Defined results: a null or empty text is one end token; a null doc_id trains; repeated
rows are scored each; with no training token the base is uniform over nothing seen and
every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch, share, small_side
from rasterloom.llm.words import give_back, mix, signed, text_chunks, word_hashes

END = 0x5EED0E2D5EED0E2D
#: Words of the longest n-gram, so contexts have one word less.
ORDER = 4
#: Least training occurrences of a context, and of a next word after it.
CONTEXT_COUNT, NEXT_COUNT = 10, 5
#: Share of the training tokens from which a word or n-gram goes to the tasks.
HOT_SHARE = 5e-7
#: Most bits of a filter, as a power of two; a small table's has 16 bits a key.
FILTER_BITS = 27
#: Parts in which documents meet the table, and training tokens from which on there is one more.
SLICES, SLICE_TOKENS = 4, 4_000_000
#: Share of the training tokens of which n-grams are counted at a time; a corpus of SLICE_TOKENS is counted at once.
COUNT_SHARE = 0.5
#: Least likelihood-ratio statistic (chi-squared) per kept next word.
DIVERGENCE = 4.0
WEIGHT = 20.0
BLOCK_WORDS = 2_000_000


def held_out():
    """crc32 of the doc_id as text is 0 modulo 10; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts, an end after each, and each text's first token (one more at the end)."""
    h, first = word_hashes(data, off)
    out = np.full(len(h) + len(off) - 1, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(off) - 1), np.diff(first))] = h
    return out, first + np.arange(len(off))


def chain(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = out * np.uint64(0x9FB21C651E98DF25) + p
    return mix(out)


def grams(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token the hashes of (word before, token) and (two before, token), and whether there are these."""
    inside = np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))
    one, two = np.zeros(len(t), np.uint64), np.zeros(len(t), np.uint64)
    one[1:], two[2:] = t[:-1], t[:-2]
    return chain(one, t), chain(two, one, t), inside >= 1, inside >= 2


def ngrams(t: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to order words, the hash of those that end at each token, and whether they lie in its text.

    An n-gram is hashed from its context and its suffix, both n-grams of one word less.
    """
    inside = np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))
    out = [(t, np.ones(len(t), bool))]
    for k in range(1, order):
        context = np.zeros(len(t), np.uint64)
        context[1:] = out[-1][0][:-1]
        out.append((chain(context, out[-1][0]), inside >= k))
    return out


class Maybe:
    """A filter of bounded size: every key put in is found, and few others. A key sets two bits of a word of 64."""

    def __init__(self, size: int, places: np.ndarray, bits: np.ndarray):
        self.size = size
        self.bits = np.zeros(1 << (size - 6), np.uint64)
        self.bits[places] = bits

    def has(self, x: np.ndarray) -> np.ndarray:
        word = self.bits[x >> np.uint64(70 - self.size)]
        word = (word >> (x & np.uint64(63))) & (word >> ((x >> np.uint64(6)) & np.uint64(63)))
        return word & np.uint64(1) == 1


def _maybe(keys: DataFrame) -> Maybe:
    """The filter of a table's column key; what comes to the driver is at most the filter."""
    size = min(FILTER_BITS, max(16, (16 * keys.count()).bit_length()))
    two = F.expr("shiftleft(1L, cast(key & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(key, 6) & 63 as int))")
    bits = keys.groupBy(F.shiftrightunsigned("key", 70 - size).alias("place")).agg(F.bit_or(two).alias("bits")).toArrow()
    return Maybe(size, bits["place"].to_numpy(), bits["bits"].to_numpy().view(np.uint64))


class Known:
    """Sorted keys and their places, with a quick test for keys that are not there."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each of x among the keys, or -1."""
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(self.maybe[x >> np.uint64(44)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, x[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == x[some], at, -1)
        return out


def _count(order: int, shared=None, part: int = 0, parts: int = 1):
    """Counts of blocks: n-grams of order words as context and suffix (words: context 0) of a part that the filters let pass."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, suffixes = pickle.loads(shared.value) if shared else (None, None)
        held, size = [], 0

        def report() -> pa.RecordBatch:
            nonlocal held, size
            context, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            if order == 1:
                suffix, n = np.unique(suffix, return_counts=True)
                context = np.zeros(len(suffix), np.uint64)
            else:
                _, at, n = np.unique(chain(context, suffix), return_index=True, return_counts=True)
                by = np.argsort(context[at])  # rows with one context lie together, which shuffles compress
                context, suffix, n = context[at[by]], suffix[at[by]], n[by]
            return pa.RecordBatch.from_arrays([pa.array(signed(context)), pa.array(signed(suffix)), pa.array(n, pa.int64())], ["context", "suffix", "n"])

        for b in batches:
            for _, _, data, off in text_chunks(b.column("text")):
                t, first = tokens(data, off)
                if order == 1:
                    held.append((t[:0], t))
                else:
                    key, has = ngrams(t, first, order - 1)[-1]
                    same = np.ones(len(t), bool)
                    same[first[:-1]] = False
                    at = np.flatnonzero(same[1:] & has[:-1] & has[1:])
                    if parts > 1:
                        at = at[(key[at] ^ key[at + 1]) % np.uint64(parts) == np.uint64(part)]
                    at = at[contexts.has(key[at])]
                    at = at[suffixes.has(key[at + 1])]
                    held.append((key[at], key[at + 1]))
                size += len(held[-1][1])
                if size >= BLOCK_WORDS:
                    yield report()
        if size:
            yield report()
        give_back()

    return f


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each n-gram beside its context and suffix."""
    for b in batches:
        context, suffix = (b.column(c).to_numpy().view(np.uint64) for c in ("context", "suffix"))
        yield pa.RecordBatch.from_arrays([pa.array(signed(chain(context, suffix))), b.column("context"), b.column("suffix"), b.column("n")], ["key", "context", "suffix", "n"])


class Tree:
    """The tree with contexts of one and two words, from counts in memory: the tables' arithmetic for small counts."""

    def __init__(self, hits: dict[int, np.ndarray], counts: dict[int, tuple[np.ndarray, np.ndarray]], total: int, distinct: int):
        self.scale = np.log10(total + 0.1 * (distinct + 1))
        self.words = Known(counts[1][0])
        order = np.argsort(counts[1][0])
        self.count = counts[1][1][order]
        self.base = np.log10(self.count + 0.1) - self.scale
        least = CONTEXT_COUNT
        self.states, self.next = [], []
        p_word = dict(zip(self.words.keys.tolist(), (10**self.base).tolist(), strict=True))
        n_word = dict(zip(self.words.keys.tolist(), self.count.tolist(), strict=True))
        n_pair = dict(zip(*(x.tolist() for x in counts[2]), strict=True))
        n_triple = dict(zip(*(x.tolist() for x in counts[3]), strict=True))
        pair_of = {}
        if len(hits[2]):
            pair_of = dict(zip(chain(hits[2][:, 0], hits[2][:, 1]).tolist(), hits[2][:, :2].tolist(), strict=True))
        kids: dict[tuple, dict[int, int]] = {}
        for key, (a, w) in pair_of.items():
            if a != END and n_word.get(a, 0) >= least and n_pair.get(key, 0) >= NEXT_COUNT:
                kids.setdefault((a,), {})[w] = n_pair[key]
        if len(hits[3]):
            for key, (a, b, w) in zip(chain(*hits[3].T).tolist(), hits[3].tolist(), strict=True):
                if n_triple.get(key, 0) >= NEXT_COUNT:
                    kids.setdefault((a, b), {})[w] = n_triple[key]
        n_of_pair = {tuple(ab): n_pair.get(k, 0) for k, ab in pair_of.items()}
        probs: dict[tuple, dict[int, float]] = {}
        back: dict[tuple, float] = {}

        def p_of(state: tuple, w: int) -> float:
            """Probability of a frequent word after the longest suffix of state that is a state."""
            scale = 1.0
            while state:
                if state in probs:
                    if w in probs[state]:
                        return scale * probs[state][w]
                    scale *= back[state]
                state = state[1:]
            return scale * p_word[w]

        for size in (1, 2):
            for state, after in sorted((s, k) for s, k in kids.items() if len(s) == size):
                c = n_word.get(state[0], 0) if size == 1 else n_of_pair.get(state, 0)
                if c < least or (size == 2 and state[1:] not in probs):
                    continue
                after = {w: n for w, n in after.items() if w in p_word}
                lower = {w: p_of(state[1:], w) for w in after}
                rest_n, rest_p = max(c - sum(after.values()), 0), max(1 - sum(lower.values()), 1e-9)
                ratio = sum(n * np.log(n / (c * lower[w])) for w, n in after.items()) + (rest_n * np.log(rest_n / (c * rest_p)) if rest_n else 0.0)
                if 2 * ratio < DIVERGENCE * (len(after) + 1):
                    continue
                probs[state] = {w: (n + WEIGHT * lower[w]) / (c + WEIGHT) for w, n in after.items()}
                back[state] = (rest_n + WEIGHT * rest_p) / (c + WEIGHT) / rest_p
        for size in (1, 2):
            states = sorted(s for s in probs if len(s) == size)
            keys = np.array([s[0] for s in states], np.uint64) if size == 1 else (chain(*np.array(states, np.uint64).T) if states else np.empty(0, np.uint64))
            known = Known(keys)
            weight = np.zeros(len(keys))
            order = np.argsort(keys)
            self.states.append((known, np.log10(np.array([back[s] for s in states]))[order] if states else weight))
            flat = [(*s, w, p) for s in states for w, p in probs[s].items()]
            if flat:
                k = chain(*np.array([f[:-1] for f in flat], np.uint64).T)
                order = np.argsort(k)
                self.next.append((Known(k), np.log10(np.array([f[-1] for f in flat]))[order]))
            else:
                self.next.append((Known(np.empty(0, np.uint64)), np.zeros(0)))

    def score(self, t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its place among the frequent words or -1, and the log10 of what the tree adds; and whether the base is needed."""
        pair, triple, has1, has2 = grams(t, first)
        one = np.zeros(len(t), np.uint64)
        one[1:] = t[:-1]
        before = np.zeros(len(t), np.uint64)
        before[1:] = pair[:-1]  # of the two words before
        out, open_ = np.zeros(len(t)), np.ones(len(t), bool)
        for (states, weight), (nexts, p), key, has, gram in ((self.states[1], self.next[1], before, has2, triple), (self.states[0], self.next[0], one, has1, pair)):
            at = np.full(len(t), -1, np.int64)
            some = np.flatnonzero(has & open_)
            at[some] = states.find(key[some])
            some = np.flatnonzero(at >= 0)
            j = nexts.find(gram[some])
            kept = j >= 0
            out[some[kept]] += p[j[kept]]
            open_[some[kept]] = False
            out[some[~kept]] += weight[at[some[~kept]]]
        return self.words.find(t), out, open_


def _parts(shared):
    """Per text a row with its sums over hot words and n-grams (n: 0), and rows of its others with their counts (n-grams: negative)."""
    sums = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, base, value), maybe = pickle.loads(shared.value)
        for b in batches:
            for i, j, data, off in text_chunks(b.column("text")):
                t, first = tokens(data, off)
                text = np.repeat(np.arange(j - i, dtype=np.uint16 if j - i <= 1 << 16 else np.int64), np.diff(first))
                known, basis, added, rest = np.zeros(len(t), bool), np.zeros(len(t)), np.zeros(len(t)), []
                for k, (key, has) in enumerate(ngrams(t, first, ORDER)):
                    at = np.flatnonzero(has)
                    place = hot.find(key[at])
                    other = at[place < 0]
                    other = other if k == 0 else other[maybe.has(key[other])]
                    rest.append((key[other], text[other], np.full(len(other), k == 0)))
                    at, place = at[place >= 0], place[place >= 0]
                    added[at] += value[place]
                    if k == 0:
                        known[at], basis[at] = True, base[place]
                s = lambda x: pa.array(np.add.reduceat(x, first[:-1]))  # noqa: E731  every text has a token
                part = b.slice(i, j - i)
                k1 = part.column("k1")
                own = pa.StructArray.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first)), s(known.astype(np.int64)), s(basis), s(added + basis)], fields=list(sums))
                yield pa.RecordBatch.from_arrays([k1, k1, pa.array(np.zeros(j - i, np.int32)), own], ["k1", "w", "n", "sums"])
                key, where, word = (np.concatenate(x) for x in zip(*rest, strict=True))
                _, at, n = np.unique(chain(key, where.astype(np.uint64)), return_index=True, return_counts=True)
                by = np.argsort(where[at], kind="stable")  # rows of one text lie together, which shuffles compress
                at, n = at[by], n[by].astype(np.int32)
                yield pa.RecordBatch.from_arrays([k1.take(pa.array(where[at])), pa.array(signed(key[at])), pa.array(np.where(word[at], n, -n)), pa.nulls(len(at), sums)], ["k1", "w", "n", "sums"])

    return f


_PARTS = "k1 long, w long, n int, sums struct<doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double>"


_GRAM = "context long, suffix long, n long"


def _tree(spark: SparkSession, scratch: Scratch, training: DataFrame, words: DataFrame, total: int, scale: float) -> tuple[DataFrame, list[DataFrame]]:
    """key, n, v: what every occurrence of a state or kept n-gram adds to a score, and its count (a key may come twice); and the tables it reads."""
    counts, kept = words, words.where(F.col("n") >= NEXT_COUNT).select("key", ((F.col("n") + F.lit(0.1)) / F.lit(scale)).alias("p"))
    out, tables = None, []
    for order in range(2, ORDER + 1):
        contexts = counts.where((F.col("n") >= CONTEXT_COUNT) & (F.col("key") != F.lit(END)))
        shared = share(spark, (_maybe(contexts), _maybe(kept)))
        may = contexts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # at most so many n-grams have a context with the count
        parts, saved = max(1, int(np.ceil(may / (COUNT_SHARE * total)))) if total > SLICE_TOKENS else 1, []
        for part in range(parts):
            grams = training.mapInArrow(_count(order, shared, part, parts), _GRAM).groupBy("context", "suffix").agg(F.sum("n").alias("n")).where(F.col("n") >= NEXT_COUNT)
            saved.append(scratch.save(grams.mapInArrow(_keyed, f"key long, {_GRAM}"), f"grams{order}", release=True))
        grams = reduce(DataFrame.union, saved)
        shared.destroy()
        rows = grams.join(contexts.select(F.col("key").alias("context"), F.col("n").alias("c")), "context").join(kept.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix")
        rows = scratch.save(rows.select("key", "context", "n", "c", "lower"), f"next{order}", release=True)
        gain = F.col("n") * F.log(F.col("n") / (F.col("c") * F.col("lower")))
        states = rows.groupBy("context").agg(F.max("c").alias("c"), F.greatest(F.max("c") - F.sum("n"), F.lit(0)).alias("rest"), F.greatest(1 - F.sum("lower"), F.lit(1e-9)).alias("rest_p"), F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("kids"))
        ratio = F.col("gain") + F.when(F.col("rest") > 0, F.col("rest") * F.log(F.col("rest") / (F.col("c") * F.col("rest_p")))).otherwise(0.0)
        states = states.where(2 * ratio >= DIVERGENCE * (F.col("kids") + 1))
        back = (F.col("rest") + WEIGHT * F.col("rest_p")) / (F.col("c") + WEIGHT) / F.col("rest_p")
        states = scratch.save(states.select("context", F.col("c").alias("n"), F.log10(back).alias("v")), f"states{order}", release=True)
        p = (F.col("n") + WEIGHT * F.col("lower")) / (F.col("c") + WEIGHT)
        after = rows.join(small_side(states.select("context", F.col("v").alias("back")), states.count()), "context")
        after = scratch.save(after.select("key", "n", p.alias("p"), (F.log10(p / F.col("lower")) - F.col("back")).alias("v")), f"kept{order}", release=True)
        part = states.select(F.col("context").alias("key"), "n", "v").union(after.select("key", "n", "v"))
        out = part if out is None else out.union(part)
        scratch.drop(rows)
        if order > 2:
            scratch.drop(*last)
        last, tables = saved, [*tables, states, after]
        counts, kept = grams.select("key", "n"), after.select("key", "p")
    scratch.drop(*last)
    return out, tables


def language_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(spark, "suffixtree")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text")
    words = scratch.save(training.mapInArrow(_count(1), _GRAM).groupBy(F.col("suffix").alias("key")).agg(F.sum("n").alias("n")), "words", release=True)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scale = total + 0.1 * (distinct + 1)
    tree, tables = _tree(spark, scratch, training, words, total, scale)
    values = words.select("key", "n", F.col("n").alias("c"), F.lit(0.0).alias("v")).union(tree.select("key", "n", F.lit(0).cast("long").alias("c"), "v"))
    values = scratch.save(values.groupBy("key").agg(F.max("n").alias("n"), F.max("c").alias("c"), F.sum("v").alias("v")), "values", release=True)
    often = values.where(F.col("n") >= HOT_SHARE * total).toArrow()  # at most ORDER / HOT_SHARE rows
    scratch.drop(words, *tables)
    key, c, v = often["key"].to_numpy().view(np.uint64), often["c"].to_numpy(), often["v"].to_numpy()
    order = np.argsort(key)
    rest = values.where(F.col("n") < HOT_SHARE * total)
    shared = share(spark, ((Known(key), np.log10(c[order] + 0.1) - np.log10(scale), v[order]), _maybe(rest.where("c = 0"))))
    # documents are met again by a hash of doc_id and text (two of 15 million share one with a chance of 6e-6);
    # repeated rows are told apart by their number only
    keyed = rows.withColumn("k1", F.xxhash64("doc_id", "text"))
    table = rest.select(F.col("key").alias("of"), "c", "v")
    log_c = F.when(F.col("n") > 0, F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1)) - F.lit(float(np.log10(scale)))).otherwise(0.0)
    own, times = lambda c: F.coalesce(F.col("sums")[c], F.lit(0)), F.abs("n")
    met, slices = None, int(min(SLICES, 1 + total // SLICE_TOKENS))
    for k in range(slices):
        parts = keyed.where(F.pmod("k1", F.lit(slices)) == k).mapInArrow(_parts(shared), _PARTS)
        sums = parts.join(table, F.col("w") == F.col("of"), "left").groupBy("k1").agg(
            F.max("sums.doc_id").alias("doc_id"), F.max("sums.held_out").alias("held_out"), F.count("sums").alias("rows"), F.sum("sums.n_tokens").alias("n_tokens"),
            F.sum(own("n_known") + F.when((F.col("n") > 0) & (F.col("c") > 0), F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(own("base_score") + times * log_c).alias("base_score"), F.sum(own("score") + times * (log_c + F.coalesce(F.col("v"), F.lit(0.0)))).alias("score"),
        )
        sums = scratch.save(sums, f"sums{k}", release=True)
        met = sums if met is None else met.union(sums)
    shared.destroy()
    scratch.drop(values)
    each = lambda c, kind="double": (F.col(c) / F.col("rows")).cast(kind).alias(c)
    return met.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))).select(
        "doc_id", "held_out", each("n_tokens", "long"), each("n_known", "long"), F.lit(total).cast("long").alias("train_tokens"), each("base_score"), each("score"),
    )
