"""Conversions by a relation of settings against the same settings one by one, and mask processing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import convert as V
from rasterloom.operators import kernels as K
from rasterloom.operators import matrix as M
from rasterloom.operators import raster as R
from rasterloom.sources.palettes import colors

GAMEBOY, C64 = tuple(colors("gameboy")), tuple(colors("c64"))
S = V.Settings
CASES = [
    S(5, 4, palette=GAMEBOY), S(5, 4, "nearest", palette=C64, dither="bayer4", strength=0.5), S(6, 5, "dominant", palette=C64, dither="floyd-steinberg"), S(20, 5, palette=GAMEBOY, dither="atkinson", strength=0.7),
    S(5, 4, max_colors=3), S(5, 4, max_colors=4, dither="bayer2"), S(7, 7, palette=C64, color_space="srgb", alpha_threshold=100, preserve_alpha=True), S(5, 5, palette=GAMEBOY, brightness=0.2, contrast=-0.3, saturation=0.5, hue=-60.0),
    S(5, 5, palette=C64, background=0.3, mask_threshold=100, mask_close=1, mask_feather=2), S(4, 4, palette=C64, crop=(1.5, 2.0, 7.0, 6.0)), S(4, 4, palette=C64, fit=True, crop=(1.0, 1.0, 7.0, 7.0), alpha_threshold=200), S(8, 8, palette=C64, despeckle=2),
    S(8, 8, palette=C64, alpha_threshold=180, outline_color=(190, 40, 40, 77), thickness=2), S(8, 8, palette=GAMEBOY, alpha_threshold=180, outline_color=(0, 0, 0, 255), corners=True),
]
SIZES = {0: (12, 10), 1: (9, 14)}


def images(spark):
    r = np.random.default_rng(1)
    rows = [(i, y, x, *map(int, r.integers(0, 256, 3) // (1 if i else 40) * (1 if i else 40)), int(r.integers(0, 256)) if i else 255) for i, (w, h) in SIZES.items() for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    return px, spark.createDataFrame([(i, w, h) for i, (w, h) in SIZES.items()], "image_id long, width int, height int")


@pytest.fixture(scope="module")
def converted(spark):
    px, sizes = images(spark)
    settings = M.settings_table(spark, [(s, None) for s in CASES])
    asked = sizes.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(len(CASES) - 1))).alias("setting_id"))
    got = {}
    for q in M.convert_each(px, sizes, asked, settings).collect():
        got.setdefault(q.setting_id, {})[q.image_id, q.y, q.x] = q.idx, q.a
    return got


@pytest.mark.parametrize("k", range(len(CASES)))
def test_each_setting_gives_what_it_gives_alone(spark, converted, k):
    px, _ = images(spark)
    want = {}
    for i, (w, h) in SIZES.items():
        for q in V.convert(px.where(F.col("image_id") == i), CASES[k], w, h).collect():
            want[i, q.y, q.x] = q.idx, q.a
    assert converted[k] == want


def test_sizes_by_the_image_and_what_is_asked_for(spark):
    px, sizes = images(spark)
    settings = M.settings_table(spark, [(S(palette=GAMEBOY), 4), (S(3, 2, palette=GAMEBOY), None)])
    asked = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (1, 1)], "image_id long, setting_id long")
    got = [(q.image_id, q.setting_id, q.y, q.x) for q in M.convert_each(px, sizes, asked, settings).collect()]
    size = {(i, k): (max(x for a, b, _, x in got if (a, b) == (i, k)) + 1, max(y for a, b, y, _ in got if (a, b) == (i, k)) + 1) for i, k in {g[:2] for g in got}}
    assert size == {(0, 0): (3, 3), (1, 0): (2, 4), (1, 1): (3, 2)} and len(got) == len(set(got)) == 9 + 8 + 6


def test_masks_are_processed_alike_in_windows_and_arrays(spark):
    r = np.random.default_rng(3)
    a = np.where(r.random((9, 11)) < 0.5, 0, r.integers(0, 256, (9, 11)))
    px = spark.createDataFrame([(0, y, x, int(a[y, x])) for y in range(9) for x in range(11)], "image_id long, y int, x int, a int")
    for threshold, close_by, feather_by in [(None, 0, 0), (100, 0, 0), (None, 1, 0), (None, 3, 0), (0, 2, 3), (200, 1, 12)]:
        got = np.zeros_like(a)
        for q in R.post_process(px, threshold, close_by, feather_by).collect():
            got[q.y, q.x] = q.a
        assert (got == K.processed_mask(a, threshold, close_by, feather_by)).all(), (threshold, close_by, feather_by)
    slow = px
    for step in (R.dilate, R.dilate, R.erode, R.erode):
        slow = step(slow)
    assert sorted(slow.collect()) == sorted(R.close(px, 2).collect())


def test_differences_and_the_worst(spark):
    rows = [(0, 0, 0, 0, 1), (0, 0, 0, 1, 65535), (0, 1, 0, 0, 1), (0, 1, 0, 1, 2), (0, 2, 0, 0, 3), (0, 2, 0, 1, 4)]
    done = spark.createDataFrame(rows, "image_id long, setting_id long, y int, x int, idx int")
    cases = M.differences(done, spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "setting_id long, plain_id long"))
    assert sorted(tuple(r) for r in cases.collect()) == [(0, 0, 2, 1, 0, None, None), (0, 1, 2, 2, 1, 0, 1), (0, 2, 2, 2, 2, 0, 0)]
    assert [r.setting_id for r in M.worst(cases, 2).collect()] == [2, 1]
