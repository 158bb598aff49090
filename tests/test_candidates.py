"""Short lists of palette entries against plain loops over all of them."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rasterloom.operators import candidates as N
from rasterloom.operators import kernels as K
from rasterloom.operators import raster as R


def palette(n, seed=0):
    r = np.random.default_rng(seed)
    return [tuple(map(int, c)) for c in r.integers(0, 256, (n, 3))]


@pytest.mark.parametrize("n", [1, 2, 9, 54, 256])
def test_nearest_equals_the_plain_loop(n):
    entries = np.array([R.lab_of(c) for c in palette(n)] * (2 if n == 9 else 1))
    r = np.random.default_rng(n)
    lab = K.oklab(r.integers(0, 256, (60_000, 3)))
    odd = np.concatenate([lab, entries, entries + 1e-10, (entries[:1] + entries[-1:]) / 2, r.normal(0, 1, (2000, 3)), N.LOW[None], N.HIGH[None], N.LOW[None] + N.STEP * 3])
    lists = N.Candidates(entries)
    assert (lists.nearest(odd) == N.plain_nearest(odd, entries)).all()
    if n == 256:
        assert lists.compared(lab) * 10 < n * len(lab)


def test_no_colours():
    assert len(N.Candidates(np.array([R.lab_of((1, 2, 3))])).nearest(np.zeros((0, 3)))) == 0


def test_diffusion_is_the_same_with_lists(monkeypatch):
    r = np.random.default_rng(5)
    h = w = 40
    y, x = (c.ravel() for c in np.mgrid[:h, :w])
    pdf = pd.DataFrame({"image_id": 0, "y": y, "x": x} | {c: r.integers(0, 256, h * w) for c in "rgba"})
    labs = np.array([R.lab_of(c) for c in palette(54, 2)])
    for kernel in K.DIFFUSION:
        monkeypatch.setattr(K, "LISTS_FROM", 1 << 60)
        slow = K.diffused(pdf, labs, kernel, 1.3, 100)
        monkeypatch.setattr(K, "LISTS_FROM", 0)
        assert K.diffused(pdf, labs, kernel, 1.3, 100).equals(slow)


@pytest.mark.parametrize("kernel", list(K.DIFFUSION))
def test_images_diffuse_together_as_alone(spark, kernel):
    """Of several sizes, with holes, and with entries that are equally near."""
    r = np.random.default_rng(7)
    rows = []
    for i in range(30):
        h, w = r.integers(1, 9, 2)
        rows += [(int(i) * 1000003, y, x, *map(int, r.integers(0, 256, 3) if i % 3 else (128, 128, 128)), int(r.integers(0, 256))) for y in range(h) for x in range(w) if r.random() < 0.95]
    pdf = pd.DataFrame(rows, columns=["image_id", "y", "x", *"rgba"])
    pal = [(0, 0, 0), (255, 255, 255), (200, 30, 30), (200, 30, 30), (30, 30, 200)]
    labs = np.array([R.lab_of(c) for c in pal])
    want = pd.concat([K.diffused(own, labs, kernel, 0.9, 100) for _, own in pdf.groupby("image_id")])
    want = {(q.image_id, q.y, q.x): q.idx for q in want.itertuples()}
    got = K.diffused_together(pdf, labs, kernel, 0.9, 100)
    assert {(q.image_id, q.y, q.x): q.idx for q in got.itertuples()} == want
    df = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    assert {(q.image_id, q.y, q.x): q.idx for q in K.diffuse(df, pal, kernel, 0.9, 100).collect()} == want


def test_quantising_and_ordered_dithering_use_them(spark):
    pal = palette(64, 3)
    r = np.random.default_rng(6)
    rows = [(0, i // 50, i % 50, *map(int, r.integers(0, 256, 3)), 255) for i in range(2500)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    entries = np.array([R.lab_of(c) for c in pal])
    lab = K.oklab(np.array([q[3:6] for q in rows]))
    got = [q.idx for q in R.quantize(px, pal).orderBy("y", "x").collect()]
    assert got == N.plain_nearest(lab, entries).tolist()
    lift = [float(v) for (v,) in R.quantize_ordered(px, pal, 4).select(((R.bayer(F.col("x"), F.col("y"), 4) + 0.5) / 16.0 - 0.5) * R.palette_spread(pal)).collect()]
    got = [q.idx for q in R.quantize_ordered(px, pal, 4).orderBy("y", "x").collect()]
    moved = lab.copy()
    moved[:, 0] += lift
    assert (np.array(got) == N.plain_nearest(moved, entries)).mean() > 0.999


def test_lists_are_kept_within_bounds():
    for k in range(N.KEPT + 5):
        N.of(np.array([[k / 100, 0.0, 0.0]] * 2))
    assert len(N._MADE) <= N.KEPT
    assert len(cloudpickle.dumps(N.of)) < 50_000  # what is kept does not travel with functions
    began = time.perf_counter()
    N.of(np.array([R.lab_of(c) for c in palette(256)]))
    assert time.perf_counter() - began < 20
