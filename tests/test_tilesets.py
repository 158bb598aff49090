"""Tile identity, grid sizes, map files, colour cubes and resampling against plain code."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import resample as Z
from rasterloom.operators import tilesets as T
from rasterloom.operators import volumes as U


def turned(tile, turn):
    t, v, h = turn
    out = tile.transpose(1, 0, 2) if t else tile
    out = out[:, ::-1] if h else out
    return out[::-1] if v else out


@pytest.mark.parametrize("w,h", [(3, 3), (4, 2), (1, 1)])
def test_tiles_are_found_under_every_turn(spark, w, h):
    r = np.random.default_rng(w)
    kinds = [r.integers(0, 2, (h, w, 4)) * 90 for _ in range(3)]
    turns = T.TURNS if w == h else T.TURNS[:4]
    tiles = [turned(kinds[r.integers(3)], turns[r.integers(len(turns))]) for _ in range(30)]
    rows = [(1, k, y, x, *map(int, tile[y, x])) for k, tile in enumerate(tiles) for y in range(h) for x in range(w)] + [(1, 99, 0, 0, 1, 1, 1, 1)] * (w * h > 1)
    px = spark.createDataFrame(rows, "s long, tile long, y int, x int, r int, g int, b int, a int")
    want = {}
    for k, tile in enumerate(tiles):
        want[k] = next((j, n) for j in range(k + 1) for n, t in enumerate(turns) if (turned(tiles[j], t) == tile).all())
    assert {q.tile: (q.found, q.turn) for q in T.identified(px, w, h, ["s"]).collect()} == want
    firsts = sorted({j for j, _ in want.values()})
    assert {q.tile: q["index"] for q in T.tile_set(px, w, h, ["s"]).collect()} == {k: firsts.index(j) + 1 for k, (j, _) in want.items()}
    flags = spark.range(8).select("id", *(c.alias(n) for c, n in zip(T.turn_flags(F.col("id")), ("h", "v", "t"))))
    assert {q.id: (int(q.t), int(q.v), int(q.h)) for q in flags.collect()} == dict(enumerate(T.TURNS))


@pytest.mark.parametrize("shape", ["rectangular", "isometric", "hexagonal"])
def test_grid_sizes_count_whole_cells(spark, shape):
    rng = random.Random(3)
    cases = [(rng.randint(0, 9000), rng.randint(0, 9000)) if k % 3 == 0 else (rng.randint(0, 90), rng.randint(0, 70)) for k in range(60)]
    df = spark.createDataFrame(cases, "w int, h int")
    for ox, oy in ((0, 0), (3, 5), (40, 0), (-1, 2)):
        got = {(r.w, r.h): (r.cols, r.rows) for r in df.select("w", "h", *(c.alias(n) for c, n in zip(G.grid_size(shape, F.col("w"), F.col("h"), 16, 12, ox, oy), ("cols", "rows")))).collect()}
        for w, h in cases:
            def fits(c, r):
                x, y = {"rectangular": (c * 16, r * 12), "isometric": ((c - r) * 8, (c + r) * 6), "hexagonal": (c * 16 + r % 2 * 8, r * 9)}[shape]
                return ox + x >= 0 and oy + y >= 0 and ox + x + 16 <= w and oy + y + 12 <= h

            cols = next(c for c in range(10_000) if not fits(c, 0))
            rows = next(r for r in range(10_000) if not fits(0, r))
            assert got[w, h] == (cols, rows), (w, h, ox, oy)


def test_map_files_need_whole_grids(spark):
    maps = spark.createDataFrame([(1, "hexagonal", 2, 1, 8, 7, 3, 1, "m", "m.png"), (2, "isometric", 2, 2, 8, 6, 3, 1, "m", "m.png"), (3, "rectangular", 1, 1, 8, 6, 0, 1, "m", "m.png"), (4, "rectangular", 1, 1, 8, 6, 3, 3, "m", "m.png")], "map_id long, shape string, cols int, rows int, tile_width int, tile_height int, tiles int, scale int, name string, image string")
    cells = spark.createDataFrame([(m, 0, c, c + 1, True, False, False) for m in (1, 2, 3, 4) for c in range(2 if m < 3 else 1)], "map_id long, row int, col int, tile int, flip_h boolean, flip_v boolean, transpose boolean")
    got = {r.map_id: json.loads(r.json) for r in T.shaped_map_json(maps, cells).collect()}
    assert set(got) == {1} and got[1]["hexsidelength"] == 3 and got[1]["layers"][0]["data"] == [1 + (1 << 31), 2 + (1 << 31)] and got[1]["orientation"] == "hexagonal"


def test_boxes_from_a_summed_volume(spark):
    r = np.random.default_rng(5)
    px = [(i, int(a), int(b), int(c), int(al)) for i in (1, 2) for a, b, c, al in r.integers(0, 256, (300, 4))]
    df = spark.createDataFrame(px, "image_id long, r int, g int, b int, a int")
    edges = [(-1, 31, -1, 31, -1, 31), (-1, 0, -1, 31, 4, 9), (3, 20, 5, 30, -1, 15), (7, 7, 0, 3, 0, 3)]
    boxes = spark.createDataFrame([(i, k, *e) for i in (1, 2, 3) for k, e in enumerate(edges)], "image_id long, box_id long, r0 int, r1 int, g0 int, g1 int, b0 int, b1 int")
    found = U.box_moments(boxes, U.summed_volume(U.color_cells(df))).withColumn("v", U.variance(F.col("w"), (F.col("sr"), F.col("sg"), F.col("sb")), F.col("m2")))
    for q in found.collect():
        r0, r1, g0, g1, b0, b1 = edges[q.box_id]
        own = np.array([p[1:4] for p in px if p[0] == q.image_id and p[4] >= 128 and r0 < p[1] >> 3 <= r1 and g0 < p[2] >> 3 <= g1 and b0 < p[3] >> 3 <= b1]).reshape(-1, 3).astype(float)
        assert (q.w, q.sr, q.sg, q.sb) == (len(own), *own.sum(0))
        assert math.isclose(q.v, ((own - own.mean(0)) ** 2).sum() if len(own) else 0.0, abs_tol=1e-6)


@pytest.mark.parametrize("kernel,src,dst", [("lanczos3", 9, 4), ("lanczos3", 5, 13), ("bilinear", 8, 3), ("bilinear", 3, 8), ("bilinear", 6, 6)])
def test_resampling_of_a_line(spark, kernel, src, dst):
    v = np.random.default_rng(src).integers(0, 256, src).astype(float)
    px = spark.createDataFrame([(0, 0, x, float(v[x])) for x in range(src)], "image_id long, y int, x int, v double")
    got = {r.x: r.v for r in Z.resample(px, ["v"], (src, 1), (dst, 1), kernel).collect()}
    scale = max(1, src / dst)
    sinc = lambda x: math.sin(math.pi * x) / (math.pi * x) if x else 1.0
    f = (lambda x: sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0) if kernel == "lanczos3" else (lambda x: max(0.0, 1 - abs(x)))
    for t in range(dst):
        w = [f((s + 0.5 - (t + 0.5) * src / dst) / scale) for s in range(src)]
        assert math.isclose(got[t], sum(a * b for a, b in zip(w, v)) / sum(w), abs_tol=1e-9)
