"""Shapes, codecs, projects, conversion and streams against plain code."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import convert as V
from rasterloom.operators import shapes as H
from rasterloom.plans.editing import flatten_layers
from rasterloom.sources import images as I
from rasterloom.sources import palettes as P
from rasterloom.sources.rasters import SIDE, pixels
from rasterloom.streaming import logs as L

DIR = "/root/testdata/sf0.001"


def test_lines_and_ellipses(spark):
    boxes = spark.createDataFrame([(0, 0, 3, 1), (2, 2, 2, 2), (5, 1, 0, 4), (1, 6, 2, 0)], "a int, b int, c int, d int")
    got = [[(p.x, p.y) for p in r[0]] for r in boxes.select(H.line(*map(F.col, "abcd"))).collect()]
    assert got[:2] == [[(0, 0), (1, 0), (2, 1), (3, 1)], [(2, 2)]]
    for (x0, y0, x1, y1), p in zip([tuple(r) for r in boxes.collect()], got):
        assert p[0] == (x0, y0) and p[-1] == (x1, y1) and all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(p, p[1:]))
    boxes = spark.createDataFrame([(0, 0, w, h) for w in range(14) for h in range(14)] + [(7, 9, 3, 2)], "a int, b int, c int, d int")
    for r in boxes.select("*", H.ellipse(*map(F.col, "abcd")).alias("p")).collect():
        p, (left, right), (top, bottom) = {(q.x, q.y) for q in r.p}, sorted((r.a, r.c)), sorted((r.b, r.d))
        assert p == {(left + right - x, y) for x, y in p} == {(x, top + bottom - y) for x, y in p} and len(r.p) == len(p)
        assert {min(x for x, _ in p), max(x for x, _ in p)} == {left, right} and {y for _, y in p} == set(range(top, bottom + 1))
        todo, seen = [next(iter(p))], set()  # one closed curve: each point touches others
        while todo:
            x, y = todo.pop()
            if (x, y) not in seen:
                seen.add((x, y))
                todo += [q for q in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if q in p]
        assert seen == p
    five = {(q.x, q.y) for q in boxes.where("c = 4 AND d = 4 AND a = 0").select(H.ellipse(*map(F.col, "abcd")).alias("p")).first().p}
    assert five == {(1, 0), (2, 0), (3, 0), (0, 1), (4, 1), (0, 2), (4, 2), (0, 3), (4, 3), (1, 4), (2, 4), (3, 4)}


def test_png_and_filters():
    r = np.random.default_rng(1)
    img = r.integers(0, 256, (7, 5, 4), dtype=np.uint8)
    assert np.array_equal(I.png_pixels(I.png_bytes(img)), img)
    raw = I.png_bytes(img)
    at = raw.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(raw[at + 4 : -16]), np.uint8).reshape(7, 21)[:, 1:].astype(int)
    for kind in (1, 2, 3, 4):
        enc = np.zeros((7, 21), np.uint8)
        for y in range(7):
            enc[y, 0] = kind
            for i in range(20):
                a, b = rows[y, i - 4] if i >= 4 else 0, rows[y - 1, i] if y else 0
                c = rows[y - 1, i - 4] if y and i >= 4 else 0
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                enc[y, i + 1] = (rows[y, i] - {1: a, 2: b, 3: (a + b) // 2, 4: paeth}[kind]) % 256
        body = zlib.compress(enc.tobytes())
        n = len(body).to_bytes(4, "big")
        assert np.array_equal(I.png_pixels(raw[: at - 4] + n + b"IDAT" + body + b"\0\0\0\0" + raw[-12:]), img)


def test_broken_png_is_a_row_with_an_error(spark):
    files = spark.createDataFrame([(1, bytearray(b"junk")), (2, bytearray(I.png_bytes(np.zeros((1, 2, 4)))))], "image_id long, png binary")
    got = I.decode_png(files).collect()
    assert [(r.image_id, r.error is not None) for r in got] == [(1, True), (2, False), (2, False)]


def gif_indices(raw):
    """A plain decoder of the first image."""
    at = 13 + 768
    while raw[at] != 0x2C:
        at += 2
        if raw[at - 1] == 0xFF:
            at += 12
        while raw[at]:
            at += raw[at] + 1
        at += 1
    at += 11
    data = b""
    while raw[at]:
        data += raw[at + 1 : at + 1 + raw[at]]
        at += raw[at] + 1
    bits, width, table, out, prev, pos = int.from_bytes(data, "little"), 9, None, [], None, 0
    while True:
        code = (bits >> pos) & ((1 << width) - 1)
        pos += width
        if code == 257:
            return out
        if code == 256:
            table, width, prev = [[i] for i in range(256)] + [None, None], 9, None
            continue
        word = table[code] if code < len(table) else prev + [prev[0]]
        if prev is not None and len(table) < 4096:
            table.append(prev + [word[0]])
            if len(table) == 1 << width and width < 12:
                width += 1
        out += word
        prev = word


def test_gif():
    r = np.random.default_rng(2)
    img = np.where(r.random((90, 110)) < 0.6, 7, r.integers(0, 40, (90, 110)))
    raw = I.gif_bytes([img, img], P.colors("nes"), [1, 40])
    assert raw[:6] == b"GIF89a" and gif_indices(raw) == img.ravel().tolist()
    assert raw[raw.index(b"\x21\xf9") + 4 :][:2] == b"\x01\x00"


def test_project(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "layer_id int, name string")
    I.save_project({"layer": a, "frame": a}, f"{tmp_path}/p")
    tables, warnings = I.load_project(spark, f"{tmp_path}/p")
    assert sorted(tables) == ["frame", "layer"] and not warnings and tables["layer"].collect() == a.collect()
    import shutil

    shutil.rmtree(tmp_path / "p" / "frame")
    assert I.load_project(spark, f"{tmp_path}/p")[1] == ["frame is missing"]
    spark.createDataFrame([(json.dumps({"formatVersion": 99, "tables": []}),)], "value string").write.mode("overwrite").text(f"{tmp_path}/p/manifest")
    with pytest.raises(ValueError):
        I.load_project(spark, f"{tmp_path}/p")


def test_neutral_adjustment_is_not_planned(spark):
    px = pixels(spark, DIR)
    s = V.Settings(SIDE, SIDE, palette=tuple(P.colors("gameboy")))
    assert V.adjust_image(px) is px
    out = V.convert(px, s, SIDE, SIDE)
    assert out.count() == px.count()


def test_conversion_steps_compose(spark):
    px = pixels(spark, DIR).where("image_id = 0")
    whole = V.convert(px, V.Settings(16, 16, palette=tuple(P.colors("gameboy")), despeckle=1, outline=2), SIDE, SIDE)
    assert {r.idx for r in whole.select("idx").distinct().collect()} <= {0, 1, 2, 3, 65535}
    assert whole.where("idx = 65535 AND a <> 0 OR idx <> 65535 AND a = 0").count() == 0


def test_flatten_order(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1, 255, 0, 0, 255, 0.5), (0, 0, 0, 0, 0, 0, 255, 255, 1.0)], "image_id long, y int, x int, z int, r int, g int, b int, a int, o double")
    assert tuple(flatten_layers(rows).first())[3:] == (128, 0, 128, 255)


def test_streams(spark, tmp_path):
    schema = "owner long, seq long, command string, key string"
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, "do", "a"), (1, 2, "do", "a"), (1, 3, "do", None)], schema).coalesce(1).write.parquet(source)
    q = L.history_stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("history").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 4, "undo", None), (1, 5, "undo", None), (1, 6, "redo", None), (2, 1, "redo", None)], schema).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("history").collect()].count((1, 2, 0)) == 1 and {tuple(r) for r in spark.table("history").collect()} == {(1, 2, 0), (1, 1, 1), (2, 0, 0)}
    source = f"{tmp_path}/in2"
    spark.createDataFrame([(1, s) for s in (1, 2, 3, 12)], "owner long, seq long").coalesce(1).write.parquet(source)
    q = L.preview_stream(spark.readStream.schema("owner long, seq long").parquet(source), 10).writeStream.format("memory").queryName("preview").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, s) for s in (13, 30, 31, 32)], "owner long, seq long").coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert [r.seq for r in spark.table("preview").orderBy("seq").collect()] == [1, 3, 13, 30]


def test_onion_frames_against_a_loop(spark):
    from rasterloom.operators.documents import onion_frames

    for n in range(1, 8):
        for before in range(4):
            for after in range(5):
                taken, want = {2 % n}, []
                if n > 1:
                    for sign, most in ((-1, before), (1, after)):
                        for k in range(1, most + 1):
                            f = (2 + sign * k) % n
                            if f in taken:
                                break
                            taken.add(f)
                            want.append((f, sign * k))
                got = spark.range(1).select(onion_frames(F.lit(n), F.lit(2 % n), before, after).alias("g")).first().g
                assert [tuple(g) for g in got] == want, (n, before, after)
