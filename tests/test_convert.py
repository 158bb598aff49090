"""Conversion with palettes of each image's own, against plain loops."""

import os
import subprocess
import sys

import numpy as np
import pytest

from rasterloom.operators import convert as V
from rasterloom.operators import kernels as K
from rasterloom.operators import raster as R


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(5)
    rows = [(i, y, x, *map(int, rng.integers(0, 256, 3)), 0 if i == 2 or (x + y) % 7 == 0 else 255) for i in (0, 1, 2) for y in range(8) for x in range(8)]
    rows += [(3, y, x, 200 if x < 4 else 20, 0, 0, 255) for y in range(8) for x in range(8)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")


@pytest.mark.parametrize("dither", ["none", "bayer2"])
def test_own_palettes_are_nearest(images, dither):
    s = V.Settings(8, 8, max_colors=5, dither=dither)
    palettes = V.colors_of(images, s)
    pal = {}
    for r in sorted(palettes.collect(), key=lambda r: (r.image_id, r.i)):
        pal.setdefault(r.image_id, []).append((r.r, r.g, r.b))
    assert {k: len(v) for k, v in pal.items()} == {0: 5, 1: 5, 2: 1, 3: 2} and pal[2] == [(0, 0, 0)] and pal[3] == [(20, 0, 0), (200, 0, 0)]
    bayer = np.array([[0, 2], [3, 1]])
    got = {(r.image_id, r.y, r.x): (r.idx, r.a) for r in V.quantized(images, s, palettes).collect()}
    assert len(got) == 4 * 64
    for p in images.collect():
        idx, a = got[p.image_id, p.y, p.x]
        if p.a < 128:
            assert (idx, a) == (R.TRANSPARENT, 0)
            continue
        labs = np.array([R.lab_of(c) for c in pal[p.image_id]])
        lab = np.array(R.lab_of((p.r, p.g, p.b)))
        if dither == "bayer2":
            lab[0] += ((bayer[p.y % 2, p.x % 2] + 0.5) / 4 - 0.5) * R.palette_spread(pal[p.image_id])
        d = ((labs - lab) ** 2).sum(1)
        assert a == 255 and d[idx] <= d.min() + 1e-8


def test_own_palettes_with_diffusion_and_few_colours(images):
    for dither in ("none", "floyd-steinberg", "atkinson", "bayer4"):
        s = V.Settings(8, 8, max_colors=4, dither=dither)
        palettes = V.colors_of(images, s)
        out = V.render(V.quantized(images, s, palettes), palettes).collect()
        assert len(out) == 4 * 64
        assert all((r.r, r.g, r.b, r.a) == ((200 if r.x < 4 else 20), 0, 0, 255) for r in out if r.image_id == 3 and dither in ("none", "floyd-steinberg", "atkinson"))
        assert all((r.r, r.g, r.b, r.a) == (0, 0, 0, 0) for r in out if r.image_id == 2)
    assert V.convert(images, V.Settings(4, 4, max_colors=3), 8, 8).count() == 4 * 16


def plain_palette(tones, size, rounds=8):
    """The automatic palette from {(r, g, b): count}, with boxes as bounds and plain loops."""
    if not tones:
        return [(0, 0, 0)]
    if len(tones) <= size:
        return sorted(tones)
    inside = lambda box: [(c, n) for c, n in tones.items() if all(lo <= v >> 3 < hi for v, (lo, hi) in zip(c, box))]

    def spread(box):
        own = inside(box)
        w = sum(n for _, n in own)
        return sum(n * (c[0] ** 2 + c[1] ** 2 + c[2] ** 2) for c, n in own) - sum(sum(n * c[k] for c, n in own) ** 2 for k in range(3)) / w if w else 0

    def held(own):
        w = sum(n for _, n in own)
        return sum(sum(n * c[k] for c, n in own) ** 2 for k in range(3)) / w

    boxes, spreads = [[(0, 32)] * 3], [spread([(0, 32)] * 3)]
    while len(boxes) < size and max(spreads) > 0:
        k = spreads.index(max(spreads))
        best = (0, None, None)
        for axis in range(3):
            for cut in range(boxes[k][axis][0] + 1, boxes[k][axis][1]):
                a, b = list(boxes[k]), list(boxes[k])
                a[axis], b[axis] = (a[axis][0], cut), (cut, b[axis][1])
                if inside(a) and inside(b) and held(inside(a)) + held(inside(b)) > best[0]:
                    best = (held(inside(a)) + held(inside(b)), a, b)
        if best[1] is None:
            spreads[k] = 0
            continue
        boxes[k], spreads[k] = best[1], spread(best[1])
        boxes.append(best[2]), spreads.append(spread(best[2]))
    middle = []
    for box in boxes:
        w = sum(n for _, n in inside(box))
        middle.append(R.lab_of(tuple(int(sum(n * c[k] for c, n in inside(box)) / w + 0.5) for k in range(3))))
    apart = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q))
    for _ in range(rounds):
        sums = [[0.0] * 4 for _ in middle]
        for c, n in sorted(tones.items()):
            lab, own = R.lab_of(c), 0
            for k in range(1, len(middle)):
                own = k if apart(lab, middle[k]) < apart(lab, middle[own]) - 1e-9 else own
            for k, v in enumerate((1, *lab)):
                sums[own][k] += n * v
        middle = [tuple(v / s[0] for v in s[1:]) if s[0] else m for s, m in zip(sums, middle)]
    return sorted({tuple(map(int, K.srgb(np.array([m]))[0])) for m in middle})


@pytest.mark.parametrize("size", [1, 3, 8, 20])
def test_automatic_palette_against_plain_loops(spark, size):
    rng, rows, want = np.random.default_rng(size), [], {}
    for i in range(5):
        tones = {tuple(map(int, c)): int(n) for c, n in zip(rng.integers(0, 256, (40, 3)), rng.integers(1, 9, 40))}
        if i == 1:  # most of the weight in one cell, which cannot be cut
            tones = {(200 + k % 8, 96 + k // 8, 48): 60 for k in range(60)} | {tuple(map(int, c)): 1 for c in rng.integers(0, 256, (16, 3))}
        if i == 2:
            tones = {(0, 0, 0): 9, (0, 0, 1): 3}
        if i == 3:
            tones = {}
        want[i] = plain_palette(tones, size)
        flat = [c for c, n in tones.items() for _ in range(n)]
        rows += [(i, k // 64, k % 64, *c, 255) for k, c in enumerate(flat)] + [(i, 99, k, 7 * k, 1, 2, 127) for k in range(5)]
    got = {}
    for r in sorted(K.auto_palette(spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int"), size).collect(), key=lambda r: r.i):
        got.setdefault(r.image_id, []).append((r.r, r.g, r.b))
    assert got == want and (size != 8 or len(got[1]) == 8)


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
q = __spark_entry__.queries()
for name in ("auto_palette", "atkinson", "quantize_oklab", "despeckled", "background_removal", "convert_automatic"):
    print(name, q[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and len(out.stdout.split()) == 12, out.stderr[-2000:]
