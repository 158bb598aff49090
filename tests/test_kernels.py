"""Sequential operators against plain loops."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rasterloom.operators import documents as D
from rasterloom.operators import kernels as K
from rasterloom.operators.raster import lab_of
from rasterloom.sources import palettes as P


def image(seed, w=9, h=7):
    r = np.random.default_rng(seed)
    return pd.DataFrame([(0, y, x, *map(int, r.integers(0, 256, 3)), int(r.choice([0, 255], p=[0.2, 0.8]))) for y in range(h) for x in range(w)], columns=["image_id", "y", "x", "r", "g", "b", "a"])


def frame(spark, pdf):
    return spark.createDataFrame(pdf).select(F.col("image_id").cast("long"), *(F.col(c).cast("int") for c in ["y", "x", "r", "g", "b", "a"]))


def plain_diffusion(pdf, palette, kernel, w=9, h=7):
    terms, turns = K.DIFFUSION[kernel]
    lab = {(r.y, r.x): list(lab_of((r.r, r.g, r.b))) for r in pdf.itertuples()}
    alpha = {(r.y, r.x): r.a for r in pdf.itertuples()}
    labs, out = [lab_of(c) for c in palette], {}
    for y in range(h):
        right = not turns or y % 2 == 0
        for x in range(w) if right else reversed(range(w)):
            if alpha[y, x] < 128:
                out[y, x] = 65535
                continue
            best, d = 0, float("inf")
            for k, e in enumerate(labs):
                dist = sum((p - q) ** 2 for p, q in zip(lab[y, x], e))
                if dist < d - 1e-9:
                    best, d = k, dist
            out[y, x] = best
            for dx, dy, share in terms:
                q = (y + dy, x + (dx if right else -dx))
                if q in lab:
                    lab[q] = [v + (o - c) * share for v, o, c in zip(lab[q], lab[y, x], labs[best])]
    return out


def test_error_diffusion(spark):
    for kernel in K.DIFFUSION:
        pdf = image(3)
        got = {(r.y, r.x): r.idx for r in K.diffuse(frame(spark, pdf), P.colors("gameboy"), kernel).collect()}
        assert got == plain_diffusion(pdf, P.colors("gameboy"), kernel)


def test_auto_palette_keeps_few_colours(spark):
    pdf = image(5).assign(r=lambda d: d.x % 3 * 100, g=10, b=20, a=255)
    got = [(r.r, r.g, r.b) for r in K.auto_palette(frame(spark, pdf), 8).orderBy("i").collect()]
    assert got == [(0, 10, 20), (100, 10, 20), (200, 10, 20)]


def test_auto_palette_size_and_order(spark):
    got = [(r.r, r.g, r.b) for r in K.auto_palette(frame(spark, image(6)), 5).orderBy("i").collect()]
    assert 1 < len(got) <= 5 and got == sorted(got)


def test_latest_wins(spark):
    def plain(events, busy):
        free, waits, ran = -(1 << 40), None, []
        for e in events:
            if waits is not None and free <= e:
                ran.append(waits)
                free, waits = free + busy, None
            if free <= e:
                ran.append(e)
                free = e + busy
            else:
                waits = e
        return ran + ([waits] if waits is not None else [])

    events = [1, 2, 3, 12, 13, 30, 31, 32, 33, 80]
    df = spark.createDataFrame([(1, e) for e in events], "u int, e long")
    assert sorted(r.e for r in D.latest_wins(df, "u", "e", 10).collect()) == plain(events, 10)


def test_palette_files(spark):
    files = spark.createDataFrame(
        [("a.hex", "; note\r\n#FF0000\n\n00ff0080 x\nzz"), ("b.gpl", "GIMP Palette\nName: N\n# c\n 1  2 3 name\n300 0 0"), ("c.pal", "JASC-PAL\n0100\n2\n1 2 3\n4 5 6"), ("d.txt", "; c\n80FF0001"), ("e.hex", None)],
        "name string, content string",
    )
    got = sorted((r.name, r.r, r.g, r.b, r.a) for r in P.parse_palettes(files).collect())
    assert got == [("a.hex", 0, 255, 0, 128), ("a.hex", 255, 0, 0, 255), ("b.gpl", 1, 2, 3, 255), ("b.gpl", 255, 0, 0, 255), ("c.pal", 1, 2, 3, 255), ("c.pal", 4, 5, 6, 255), ("d.txt", 255, 0, 1, 128)]


def test_riff(spark):
    raw = bytearray(b"RIFF\0\0\0\0PAL data\0\0\0\0\0\3" + (2).to_bytes(2, "little") + bytes([1, 2, 3, 0, 4, 5, 6, 0]))
    got = [tuple(r) for r in P.parse_riff(spark.createDataFrame([("p", raw), ("q", bytearray(b"no"))], "name string, content binary")).collect()]
    assert got == [("p", 0, 1, 2, 3, 255), ("p", 1, 4, 5, 6, 255)]
