"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Equal vectors are one point that keeps its K + 1 smallest vec_ids, so a very common
vector is one node of a graph. Points are dealt by hash into shards of about SHARD_ROWS.
A shard is one row: its vectors, its flat neighbour arrays (points x DEGREE at the bottom,
points x DEGREE / 2 in each layer above, -1 where empty) and its entry point. Layers are
geometric by a hash of the point; each point is linked to neighbours among the points
before it, chosen so that none is closer to another chosen one than to the point, and
back; an overfull list keeps the nearest. A shard's size is bounded, so the candidates
for these links are found exactly.

Queries are packed into blocks, and every block meets every shard by an equi-join on
(dimension, shard, block). A search descends greedily and then keeps the EF best at the
bottom. Distances of what it finds are computed again in double precision on the original
vectors; each query's K best over all shards remain, ties to the smaller vec_id.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinity, and
rows with a null vec_id, take no part; vectors are compared with those of their own
dimension; rows that share a vec_id with the query are its own, and where they have other
vectors, each distinct vector is a query with a list of its own; with fewer than K
candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch
from rasterloom.llm.words import mix

K = 10
EVERY = 100
SHARD_ROWS, BLOCK_ROWS = 4000, 512
DEGREE, CANDIDATES, EF = 32, 64, 96


class Graph:
    """Layers of neighbour arrays over the points of a shard."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], entry: int):
        self.v, self.layers, self.entry = vectors, layers, entry
        self.norms = (vectors * vectors).sum(1)

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        u = (mix(np.arange(n, dtype=np.uint64) + np.uint64(99)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE / 2)).astype(int)
        v = vectors.astype(np.float32)
        sq = (v * v).sum(1)
        far = np.maximum(sq[:, None] - 2 * (v @ v.T) + sq[None], 0)
        layers = []
        for k in range(int(level.max()) + 1):
            members = np.flatnonzero(level >= k)
            most = DEGREE if k == 0 else DEGREE // 2
            nbr = np.full((n, most), -1, np.int32)
            deg = np.zeros(n, np.int32)
            for t, p in enumerate(members[1:], 1):
                before = members[:t]
                d = far[p, before]
                if t > CANDIDATES:
                    near = np.argpartition(d, CANDIDATES)[:CANDIDATES]
                    near = near[np.argsort(d[near], kind="stable")]
                else:
                    near = np.argsort(d, kind="stable")
                cand = before[near]
                between, own = far[np.ix_(cand, cand)], d[near]
                free, chosen = np.ones(len(cand), bool), []
                for i in range(len(cand)):
                    if free[i]:
                        chosen.append(cand[i])
                        if len(chosen) == DEGREE // 2:
                            break
                        free &= between[i] > own  # what is closer to a chosen one than to p is reached through it
                for c in chosen:
                    nbr[p, deg[p]] = c
                    deg[p] += 1
                    if deg[c] < most:
                        nbr[c, deg[c]] = p
                        deg[c] += 1
                    else:
                        all_ = np.append(nbr[c], p)
                        worst = int(np.argmax(far[c, all_]))
                        if worst < most:
                            nbr[c, worst] = p
            layers.append((members.astype(np.int32), nbr[members] if k else nbr))
        return cls(vectors, layers, int(np.flatnonzero(level == level.max())[0]))

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Points found near q, ef at most."""
        v, norms = self.v, self.norms
        at = self.entry
        best = float(norms[at] - 2 * (v[at] @ q))
        for members, nbr in reversed(self.layers[1:]):
            while True:
                near = nbr[np.searchsorted(members, at)]
                near = near[near >= 0]
                if not len(near):
                    break
                d = norms[near] - 2 * (v[near] @ q)
                i = int(d.argmin())
                if d[i] >= best:
                    break
                at, best = int(near[i]), float(d[i])
        nbr = self.layers[0][1]
        seen = np.zeros(len(v), bool)
        seen[at] = True
        todo, found = [(best, at)], [(-best, at)]
        while todo:
            d, p = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            near = nbr[p]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            ds = norms[near] - 2 * (v[near] @ q)
            limit = -found[0][0] if len(found) >= ef else np.inf
            for d, p in zip(ds.tolist(), near.tolist(), strict=True):
                if d < limit or len(found) < ef:
                    heapq.heappush(todo, (d, p))
                    heapq.heappush(found, (-d, p))
                    if len(found) > ef:
                        heapq.heappop(found)
                    limit = -found[0][0] if len(found) >= ef else np.inf
        return np.array([p for _, p in found], np.int64)


_INDEX = "dim int, shard int, n int, vectors binary, ids array<array<long>>, levels array<binary>, members array<binary>, entry int"


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by([("first", "ascending")])
    dim = t["dim"][0].as_py()
    v = np.array(t["vector"].combine_chunks().flatten(), np.float64).reshape(len(t), dim)
    g = Graph.build(v)
    return pa.Table.from_pydict(
        {
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()), "n": pa.array([len(t)], pa.int32()), "vectors": [v.tobytes()],
            "ids": pa.array([t["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))), "levels": pa.array([[x.tobytes() for _, x in g.layers]], pa.list_(pa.binary())),
            "members": pa.array([[m.tobytes() for m, _ in g.layers]], pa.list_(pa.binary())), "entry": pa.array([g.entry], pa.int32()),
        }
    )


_FOUND = "q long, query_id long, vec_id long, score double"


def _search(k: int, ef: int):
    def f(index: pa.Table, queries: pa.Table) -> pa.Table:
        out_k, out_q, out_v, out_s = [], [], [], []
        if len(index) and len(queries):
            r = index.slice(0, 1).to_pylist()[0]
            v = np.frombuffer(r["vectors"], np.float64).reshape(r["n"], -1)
            members = [np.frombuffer(m, np.int32) for m in r["members"]]
            layers = [(m, np.frombuffer(x, np.int32).reshape(len(m), -1)) for m, x in zip(members, r["levels"], strict=True)]
            g, ids = Graph(v, layers, r["entry"]), r["ids"]
            qs = np.array(queries["vector"].combine_chunks().flatten(), np.float64).reshape(len(queries), -1)
            for key, qid, q in zip(queries["q"].to_pylist(), queries["query_id"].to_pylist(), qs, strict=True):
                found = g.search(q, ef)
                exact = np.sqrt(((v[found] - q) ** 2).sum(1)).tolist()
                best = heapq.nsmallest(k, ((d, i) for d, p in zip(exact, found.tolist(), strict=True) for i in ids[p] if i != qid))
                for d, i in best:
                    out_k.append(key), out_q.append(qid), out_v.append(i), out_s.append(d)
        return pa.table({"q": pa.array(out_k, pa.int64()), "query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return f


def usable(v: Column) -> Column:
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(fit(x), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(spark: SparkSession, rows: DataFrame, k: int = K, every: int = EVERY, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by every."""
    scratch = Scratch(spark, "nearest")
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    points = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    order = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = points.withColumn("at", order).where(F.col("at") <= k + 1).groupBy("dim", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    distinct = scratch.save(distinct.withColumn("first", F.col("ids")[0]), "points")
    shards = max(1, -(-distinct.count() // SHARD_ROWS))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int"))
    index = scratch.save(dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX), "index")
    scratch.drop(distinct)
    queries = points.where(F.pmod("vec_id", F.lit(every)) == 0).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id", "vector"]).withColumn("q", F.xxhash64("query_id", "vector"))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", all_of(shards))
    held = index.withColumn("block", all_of(blocks))
    found = held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(_search(k, ef), _FOUND)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
