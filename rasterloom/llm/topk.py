"""Exact top-k search by integer inner product: tiled matrix products, selection per tile, a tree of merges.

Every component x becomes floor(SCALE * x). Rows are packed where they lie into tiles of at
most TILE_ROWS vectors of one dimension, in order of vec_id within the tile, as integers in
the least type that holds them; nothing is shuffled for that. Query rows are taken from the
tiles and packed again into blocks of BLOCK_BYTES. Every GROUP tiles meet every query block
by an equi-join on (dimension, group, block): that pair is one task, which multiplies a slice
of the block by a tile at a time, keeps the k best of every query in the tile by a partial
selection, and folds them into a running list. The lists of a block are then merged FAN at a
time, level by level, so no task sees more than FAN lists of a block, however many tiles
there are. Exact search costs queries x rows products; the tiles bound memory, not work.

A product is computed in doubles where the largest possible sum is below 2**53, so it is
exact; in 64-bit integers up to 2**63; and in unbounded integers beyond, of which the score
returned is the nearest long.

Defined results: vectors that are null or hold null, NaN or infinity, and rows with a null
vec_id, take no part; a zero vector does, with score 0, and so does an empty one, against
empty ones; vectors are compared with those of their own dimension. A row is a query or
candidate of its own: rows that repeat a vec_id each have a list, and are each other's
candidates. Equal scores go to the smaller vec_id. With fewer than k candidates all are
returned; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch

K, EVERY, SCALE = 10, 100, 1024
#: Vectors of a tile (a power of two), bytes of a query block and of a slice's products, tiles of a task, lists of a merge.
TILE_BITS, BLOCK_BYTES, SLICE_BYTES, GROUP, FAN = 11, 8 << 20, 16 << 20, 8, 16
TILE_ROWS = 1 << TILE_BITS
#: Numbers that a tile's place in its partition may take.
COUNTER_BITS = 30
_TILE = "dim int, tile long, rids binary, ids binary, kind string, vectors binary"
_LISTS = "dim int, block int, part int, rids binary, qids binary, ids binary, scores binary"
NONE = np.iinfo(np.int64).min


def _least_type(v: np.ndarray) -> np.ndarray:
    """Whole doubles in the smallest type that holds them."""
    most = float(np.abs(v).max()) if v.size else 0.0
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _tile_row(dim: int, tile: int, rids: np.ndarray, ids: np.ndarray, v: np.ndarray) -> dict:
    v = _least_type(v)
    return {"dim": dim, "tile": tile, "rids": rids.astype(np.int64).tobytes(), "ids": ids.astype(np.int64).tobytes(), "kind": v.dtype.str, "vectors": v.tobytes()}


def _matrix(row: dict) -> np.ndarray:
    n = len(row["ids"]) // 8
    return np.frombuffer(row["vectors"], np.dtype(row["kind"])).reshape(n, row["dim"])


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_TILE_ARROW = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("rids", pa.binary()), ("ids", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary())])
_LISTS_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("rids", pa.binary()), ("qids", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])


def _usable(col: pa.Array, ids: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Dimensions, vec_ids and scaled vectors of the rows that take part."""
    ids = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array([np.nan if x is None else x for x in ids.to_pylist()], object)
    flat = col.flatten()  # without what null lists may hide
    null = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = null | ~np.isfinite(values)
    size = np.array([-1 if n is None else n for n in col.value_lengths().to_pylist()], np.int64)
    off = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    wrong = np.concatenate([[0], np.cumsum(bad)])
    known = np.array([i == i for i in ids], bool) if ids.dtype == object else np.ones(len(ids), bool)
    use = np.flatnonzero((size >= 0) & known & (wrong[off[1:]] == wrong[off[:-1]]))
    scaled = np.floor(values * scale)
    return size[use], ids[use].astype(np.int64), [scaled[off[i] : off[i + 1]] for i in use]


def _pack(scale: int):
    """Batches of (vec_id, embedding) -> tiles; a row's own number is its tile's and its place in it."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, waiting = TaskContext.get().partitionId() << COUNTER_BITS, 0, {}

        def tile(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = map(list, zip(*waiting.pop(dim), strict=True))
            ids = np.array(ids, np.int64)
            order = np.argsort(ids, kind="stable")
            number = base + made
            made += 1
            v = np.array(vectors, np.float64).reshape(len(ids), dim)[order]
            return _table([_tile_row(dim, number, (number << TILE_BITS) + np.arange(len(ids)), ids[order], v)], _TILE_ARROW)

        for b in batches:
            for dim, i, v in zip(*_usable(b.column("embedding"), b.column("vec_id"), scale), strict=True):
                waiting.setdefault(int(dim), []).append((i, v))
                if len(waiting[int(dim)]) == TILE_ROWS:
                    yield tile(int(dim))
        for dim in sorted(waiting):
            yield tile(dim)

    return f


def _asked(every: int):
    """Tiles -> a row for each of their query rows."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, rids, v = _longs(r["ids"]), _longs(r["rids"]), _matrix(r)
                for i in np.flatnonzero(ids % every == 0):
                    yield _table([_tile_row(r["dim"], r["tile"], rids[i : i + 1], ids[i : i + 1], v[i : i + 1])], _TILE_ARROW)

    return f


def _block(t: pa.Table) -> pa.Table:
    """Query rows of a block as one row; its number takes the tile's place."""
    rows = sorted(t.to_pylist(), key=lambda r: r["rids"])
    dim, block = rows[0]["dim"], rows[0]["block"]
    v = np.concatenate([_matrix(r).astype(np.float64) for r in rows])
    one = _tile_row(dim, block, np.concatenate([_longs(r["rids"]) for r in rows]), np.concatenate([_longs(r["ids"]) for r in rows]), v)
    return pa.Table.from_batches([_table([one], _TILE_ARROW)])


def _products(q: np.ndarray, v: np.ndarray, bound: int) -> np.ndarray:
    if bound < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return whole(q) @ whole(v).T


def _bound(q: np.ndarray, v: np.ndarray) -> int:
    most = lambda x: int(abs(float(x.max()))) if x.size and x.max() > -x.min() else int(abs(float(x.min()))) if x.size else 0
    return most(q.astype(np.float64)) * most(v.astype(np.float64)) * max(1, q.shape[1])


def _select(scores: np.ndarray, own: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k best places, best first, ties to the lower place; their scores, and which places are real.

    own: the place of the query itself in this tile, or -1.
    """
    n, m = scores.shape
    k = min(k, m)
    at = np.flatnonzero(own >= 0)
    if bound < 1 << (62 - TILE_BITS):
        key = (scores << TILE_BITS) | np.arange(m - 1, -1, -1)[None]  # all different, so a partial selection is exact
        key[at, own[at]] = NONE
        top = np.argpartition(key, m - k, axis=1)[:, m - k :]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
    else:
        top = np.empty((n, k), np.int64)
        for i in range(n):
            order = sorted(range(m), key=lambda j: (j == own[i], -int(scores[i, j]), j))  # noqa: B023
            top[i] = order[:k]
    return top, np.take_along_axis(scores, top, 1), top != own[:, None]


def _fold(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of candidates; ids and scores of what is missing are NONE."""
    order = np.lexsort((ids, -np.maximum(scores, -np.iinfo(np.int64).max)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _meet(k: int):
    def f(tiles: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for b in blocks.to_pylist():
            q, rids, qids = _matrix(b), _longs(b["rids"]), _longs(b["ids"])
            best_ids, best = np.full((len(q), k), NONE, np.int64), np.full((len(q), k), NONE, np.int64)
            for r in tiles.to_pylist():
                v, ids = _matrix(r), _longs(r["ids"])
                own = np.where(rids >> TILE_BITS == r["tile"], rids & (TILE_ROWS - 1), -1)
                bound = _bound(q, v)
                step = max(1, SLICE_BYTES // (8 * len(v)))
                for a in range(0, len(q), step):
                    z = slice(a, a + step)
                    top, scores, real = _select(_products(q[z], v, bound), own[z], k, bound)
                    limit = np.iinfo(np.int64).max
                    if scores.dtype == object:
                        scores = np.clip(scores, 1 - limit, limit).astype(np.int64)
                    found, scores = np.where(real, ids[top], NONE), np.where(real, scores, NONE)
                    best_ids[z], best[z] = _fold(np.concatenate([best_ids[z], found], 1), np.concatenate([best[z], scores], 1), k)
            out.append({"dim": b["dim"], "block": b["block"], "part": b["part"], "rids": b["rids"], "qids": qids.tobytes(), "ids": best_ids.tobytes(), "scores": best.tobytes()})
        return pa.Table.from_batches([_table(out, _LISTS_ARROW)])

    return f


def _merge(k: int):
    def f(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        shape = (len(rows[0]["qids"]) // 8, k)
        ids, scores = (np.concatenate([_longs(r[c]).reshape(shape) for r in rows], 1) for c in ("ids", "scores"))
        ids, scores = _fold(ids, scores, k)
        one = {c: rows[0][c] for c in ("dim", "block", "rids", "qids")} | {"part": rows[0]["part"] // FAN, "ids": ids.tobytes(), "scores": scores.tobytes()}
        return pa.Table.from_batches([_table([one], _LISTS_ARROW)])

    return f


def _listed(k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, scores = _longs(r["ids"]).reshape(-1, k), _longs(r["scores"]).reshape(-1, k)
                real = scores != NONE
                q, rank = np.nonzero(real)
                yield pa.RecordBatch.from_arrays([pa.array(_longs(r["qids"])[q]), pa.array((rank + 1).astype(np.int32)), pa.array(ids[real]), pa.array(scores[real])], ["query_id", "rank", "vec_id", "score"])

    return f


def top_inner_products(spark: SparkSession, rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row whose vec_id is divisible by every."""
    scratch = Scratch(spark, "topk")
    points = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    tiles = scratch.save(points.mapInArrow(_pack(scale), _TILE), "tiles")
    # a row per dimension of vectors; the number of tiles sets the number of groups
    per_tile = F.octet_length("ids") / F.lit(8)
    dims = tiles.groupBy("dim").agg(F.count(F.lit(1)).alias("tiles"), F.sum(per_tile).alias("n"))
    shape = dims.agg(F.sum("tiles"), F.max((F.col("dim") + 1) * 8)).first()
    n_tiles, width = shape[0] or 0, shape[1] or 8
    groups = max(1, -(-n_tiles // GROUP))
    asked = scratch.save(tiles.mapInArrow(_asked(every), _TILE), "asked")
    blocks = max(1, -(-asked.count() * width // BLOCK_BYTES))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("rids"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(_block, _TILE)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = packed.withColumn("block", F.col("tile").cast("int")).withColumn("part", all_of(groups))
    held = tiles.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int")).withColumn("block", all_of(blocks))
    key = ("dim", "part", "block")
    lists = held.groupBy(*key).cogroup(packed.groupBy(*key)).applyInArrow(_meet(k), _LISTS)
    while groups > 1:
        groups = -(-groups // FAN)
        lists = lists.groupBy("dim", "block", F.floor(F.col("part") / F.lit(FAN)).alias("to")).applyInArrow(_merge(k), _LISTS)
    return lists.mapInArrow(_listed(k), "query_id long, rank int, vec_id long, score long")


ORACLE = f"""
with rows as (
    select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
    select q.rid, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from rows q join rows c on q.rid <> c.rid and len(q.v) = len(c.v)
    where q.vec_id % {EVERY} = 0
), ranked as (select *, row_number() over (partition by rid order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= {K}
"""
