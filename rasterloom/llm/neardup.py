"""Near-duplicate documents: b-bit MinHash, band buckets, exact verification, components.

1. A pass over the texts hashes every document's five-word shingles, takes 128 minima,
   hashes them in 32 bands of four, packs the low four bits of every minimum into eight
   longs, and fingerprints the set by two independent 64-bit sums of its shingles.
2. Documents with the same set are one node, numbered when the table of sets is written.
3. Nodes that share a band meet. In each bucket every node is paired with the bucket's
   smallest node only (a star, not all pairs). The collision-corrected share of equal
   bit groups estimates the similarity; a pair is dropped if it lies more than five
   standard deviations below the threshold, else the full sets are compared.
4. Verified links give components. A bucket whose nodes are then in different components
   is looked at again, with the full sets: in tasks for pairs of blocks of at most
   BLOCK_BYTES of sets, each node outside the largest component is compared with the nodes
   of other components that the estimate allows, most similar first, until a link joins
   the two. A pair is compared in the first band that it shares only, and what leaves a
   task is its links, no more than its nodes. So no link between components is lost for
   want of a comparison, except with the chance of sharing no band at all, 5e-6 at
   similarity 0.75, or of an estimate five standard deviations off.

Every row is a document of its own, whatever its doc_id; a component's id is the smallest
doc_id in it.

Defined results: a null text or one without words has no shingles, is linked with nothing
and is always kept; rows that share a doc_id with other texts are linked each by its own
text; rows with a null doc_id are linked as any, their component's id is null if none in
it has one; repeated rows share a component, of which the report marks each row with its
id and drop_duplicates() keeps one; a very long text is one row of the same steps, its set
held by one task; an empty table gives no rows; extra columns are not read, and whatever
their names pass through drop_duplicates().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.components import connected_components
from rasterloom.llm.scratch import Scratch, columns, free_names, small_side
from rasterloom.llm.words import constants, mix, shingles, signed, text_chunks, word_hashes

SHINGLE = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
HASHES, BANDS, BITS = 128, 32, 4
ROWS = HASHES // BANDS
#: Least estimate that goes on to exact comparison: the threshold less five standard deviations of the estimate.
_EQUAL = PERCENT / 100 + (1 - PERCENT / 100) * 0.5**BITS
LEAST = PERCENT / 100 - 5 * (_EQUAL * (1 - _EQUAL) / HASHES) ** 0.5 / (1 - 0.5**BITS)
#: A bit in each group of BITS.
_UNITS = sum(1 << k for k in range(0, 64, BITS))
#: Bytes of shingle sets in a block of a bucket, about.
BLOCK_BYTES = 16 << 20
#: Parts in which the documents of a set are met again, so that a very common set is not one task's.
SALTS = 16

_SIGNED = "doc_id long, th long, n long, h1 long, h2 long, bands array<long>, sig array<long>"


def minima(h: np.ndarray, at: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """hashes x documents: minima of multiplied shingle hashes; documents without shingles must be left out."""
    out = np.empty((hashes, len(at) - 1), np.uint64)
    for k, a in enumerate(constants(hashes, 77)):
        out[k] = np.minimum.reduceat(h * a, at[:-1])
    return out


def pack_bits(m: np.ndarray) -> np.ndarray:
    """documents x longs: the low BITS bits of each mixed minimum."""
    low = mix(m) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    out = np.zeros((m.shape[1], len(m) // per), np.uint64)
    for k in range(len(m)):
        out[:, k // per] |= low[k] << np.uint64(BITS * (k % per))
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (…, longs): share of equal bit groups, corrected for chance collisions."""
    x = a ^ b
    for k in (1, 2):
        x = x | (x >> np.uint64(k))
    differ = x & np.uint64(_UNITS)
    equal = 1 - np.bitwise_count(differ).sum(-1) / HASHES
    return (equal - 0.5**BITS) / (1 - 0.5**BITS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in text_chunks(b.column("text")):
            words, first = word_hashes(data, off)
            h, at = shingles(words, first, SHINGLE)
            n = np.diff(at)
            rows = j - i
            bands, sig = np.zeros((rows, BANDS), np.uint64), np.zeros((rows, HASHES * BITS // 64), np.uint64)
            size, h1, h2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            has = np.flatnonzero(n)
            if len(has):
                starts = np.append(at[:-1][has], at[-1])
                m = minima(h, starts)
                sig[has] = pack_bits(m)
                for k in range(BANDS):
                    x = np.full(len(has), k + 1, np.uint64)
                    for r in range(ROWS):
                        x = mix(x * np.uint64(0x9FB21C651E98DF25) + m[k * ROWS + r])
                    bands[has, k] = x
                for d in has:
                    u = np.unique(h[at[d] : at[d + 1]])
                    size[d], h1[d], h2[d] = len(u), u.sum(), mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, rows), b.column("th").slice(i, rows), pa.array(size), pa.array(signed(h1)), pa.array(signed(h2)), _lists(bands), _lists(sig)],
                ["doc_id", "th", "n", "h1", "h2", "bands", "sig"],
            )


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(signed(np.ascontiguousarray(x).ravel())))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, its sorted distinct shingles as bytes."""
    for b in batches:
        for i, j, data, off in text_chunks(b.column("text")):
            words, first = word_hashes(data, off)
            h, at = shingles(words, first, SHINGLE)
            yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.array([np.unique(h[at[d] : at[d + 1]]).tobytes() for d in range(j - i)], pa.binary())], ["node", "grams"])


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach percent of their union in their intersection."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _verify(percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column("ga"), b.column("gb"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "link"])

    return f


def _settle(percent: int):
    """Of a block pair of a bucket: links that join different components."""

    def f(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, side = t["node"].to_numpy(), t["side"].to_numpy()
        _, comp = np.unique(t["component"].to_numpy(), return_inverse=True)
        sig = np.array(t["sig"].combine_chunks().flatten()).view(np.uint64).reshape(len(node), -1)
        bands = np.array(t["bands"].combine_chunks().flatten()).reshape(len(node), -1)
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"]]
        own = int(np.flatnonzero(bands[0] == t["key"][0].as_py())[0])
        size = np.array([len(g) for g in grams])
        out = []
        small = np.flatnonzero(comp != np.bincount(comp).argmax())
        for i in small:
            other = (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if side.any():
                other &= side != side[i]
            other = np.flatnonzero(other)
            other = other[~(bands[other, :own] == bands[i, :own]).any(1)]
            e = estimate(sig[other], sig[i])
            other = other[e >= LEAST][np.argsort(-e[e >= LEAST], kind="stable")]
            for j in other:
                if comp[j] != comp[i] and linked(grams[i], grams[j], percent):
                    out.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        a, b = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return f


def _groups(docs: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Per row of docs: doc_id, th (a hash of the text), n, h1, h2; and for the sets of rows that are not alone: h1, h2, component_id, and doc_id and th of the row to keep."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signs = scratch.save(texts.mapInArrow(_sign, _SIGNED), "signs")
    one = lambda c: F.first(c).alias(c)  # noqa: E731  equal sets have equal signatures
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    classes = signs.where("n > 0").groupBy("h1", "h2").agg(rep, F.count(F.lit(1)).alias("members"), one("n"), one("bands"), one("sig"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes", release=True)
    nodes = classes.select("node", "n", "bands")
    keys = scratch.save(nodes.select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first")).where("members > 1")
    members = scratch.save(keys.join(shared.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).select("key", "node", "n", "first"), "members")
    scratch.drop(keys)
    met = scratch.save(members.select("node").distinct(), "met")
    n_met = met.count()
    met_nodes = classes.join(small_side(met, n_met), "node", "left_semi")
    signed_nodes = scratch.save(met_nodes.select("node", "sig", "bands"), "signed")
    wanted = met_nodes.select("node", F.col("rep.doc_id").alias("of"), F.col("rep.th").alias("ot"))
    grams = texts.join(small_side(wanted, n_met), (F.col("th") == F.col("ot")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "text").dropDuplicates(["node"])
    grams = scratch.save(grams.mapInArrow(_shingle_sets, "node long, grams binary"), "grams")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        """a, b -> a, b, link: compared on the full sets."""
        ga, gb = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        return scratch.save(pairs.join(gb, "b").join(ga, "a").select("a", "b", "ga", "gb").mapInArrow(_verify(percent), "a long, b long, link boolean"), name)

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate reaches LEAST; the same arithmetic as estimate()."""
        side = lambda c: signed_nodes.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}"))
        count = F.lit(0)
        for k in range(HASHES * BITS // 64):
            x = F.col("sa")[k].bitwiseXOR(F.col("sb")[k])
            for shift in (1, 2):
                x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            count = count + F.bit_count(x.bitwiseAND(F.lit(_UNITS)))
        similar = (1 - count / HASHES - 0.5**BITS) / (1 - 0.5**BITS)
        return pairs.join(side("b"), "b").join(side("a"), "a").where(similar >= LEAST).select("a", "b")

    stars = members.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = links_of(allowed(stars), "stars").where("link").select("a", "b")
    component = connected_components(links, scratch)
    unsettled = _unsettled(members, component, signed_nodes, grams)
    more = scratch.save(unsettled.groupBy("key", "left", "right").applyInArrow(_settle(percent), "a long, b long"), "more")
    if not more.isEmpty():
        component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch)
    scratch.drop(members, met, signed_nodes, grams)
    # a component's values meet its sets, and these their documents, in SALTS parts, so that a giant one is not one task's
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    placed = classes.join(component, "node", "left").select("h1", "h2", "rep", "members", F.coalesce("component", "node").alias("cid"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    least = placed.groupBy("cid").agg(F.min("rep").alias("keep"), F.sum("members").alias("rows")).where("rows > 1")
    least = least.select(F.col("cid").alias("of"), "keep", parts.alias("part"))
    result = placed.join(least, (F.col("cid") == F.col("of")) & (F.col("salt") == F.col("part")))
    result = result.select("h1", "h2", F.col("keep.doc_id").alias("component_id"), F.col("keep.th").alias("keep_th"))
    return signs.select("doc_id", "th", "n", "h1", "h2"), scratch.save(result, "result")


def _met(signs: DataFrame, result: DataFrame, how: str) -> DataFrame:
    """Rows of signs with component_id and keep_th of their sets."""
    side = result.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "component_id", "keep_th", F.lit(True).alias("grouped"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    rows = signs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int"))
    return rows.join(side, (F.col("n") > 0) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("salt") == F.col("part")), how)


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "neardup")
    signs, result = _groups(docs, percent, scratch)
    out = _met(signs, result, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _unsettled(members: DataFrame, component: DataFrame, signed_nodes: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows (key, left, right, side, node, component, sig, bands, grams) of buckets whose nodes are in more than one component.

    A bucket whose sets are larger than BLOCK_BYTES is cut into blocks by the nodes'
    hashes, and each pair of blocks is a group of its own.
    """
    rows = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n").alias("grams")).where("lo < hi")
    open_ = open_.select(F.col("key").alias("of"), F.ceil(F.col("grams") * 8 / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = rows.join(open_, F.col("key") == F.col("of"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "component")
    return rows.join(signed_nodes, "node").join(grams, "node")


def drop_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, of repeated rows any."""
    scratch = Scratch(spark, "neardup")
    signs, result = _groups(docs, percent, scratch)
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("keep_th"))
    met = _met(signs, result, "inner").groupBy("doc_id", "th").agg(F.max(keep).alias("keep"), F.count(F.lit(1)).alias("rows"))
    d, t, key, times = free_names(docs, "doc_id", "th", "key", "times")
    met = scratch.save(met.where("not keep or rows > 1").select(F.col("doc_id").alias(d), F.col("th").alias(t), F.when(F.col("keep"), F.col("rows")).otherwise(0).alias(times)), "met", release=True)
    n, repeated = met.agg(F.count(F.lit(1)), F.coalesce(F.max(times), F.lit(0))).first()
    same = (F.col(key) == F.col(t)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d))
    out = docs.withColumn(key, F.xxhash64("text")).join(small_side(met, n), same, "left").where(F.col(times).isNull() | (F.col(times) > 0))
    if repeated:
        out = out.where(F.col(times).isNull()).unionAll(out.where(F.col(times) > 0).dropDuplicates(["doc_id", key]))
    return out.select(columns(docs))
