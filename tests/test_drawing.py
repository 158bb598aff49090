"""Generated images, rotation, sampling, charts and readers against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import chart as H
from rasterloom.operators import compose as K
from rasterloom.operators import rotate as O
from rasterloom.operators.raster import lab_of
from rasterloom.sources import generated as N
from rasterloom.sources import images as I

PX = "image_id long, y int, x int, r int, g int, b int, a int"


def rows_of(image, i=1):
    return [(i, y, x, *map(int, image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]


def image_of(rows, h, w):
    out = np.full((h, w, 4), -1)
    for r in rows:
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"], r["a"]
    return out


def test_draws_are_those_of_the_sequence(spark):
    state, want = 0x504F5254, []
    for _ in range(50):
        state = (state + 0x6D2B79F5) % 2**32
        t = (state ^ state >> 15) * (state | 1) % 2**32
        t ^= (t + (t ^ t >> 7) * (t | 61)) % 2**32
        want.append((t ^ t >> 14) / 2**32)
    assert [r[0] for r in spark.range(50).orderBy("id").select(N.draw(0x504F5254, F.col("id"))).collect()] == want


def test_generated_sizes_and_corners(spark):
    got = {(r["image"], r["y"], r["x"]): (r["r"], r["g"], r["b"], r["a"]) for r in N.all_generated(spark).collect()}
    assert len(got) == sum(w * h for w, h in N.SIZES.values())
    assert got["gradient", 0, 0] == (0, 0, 255, 255) and got["gradient", 63, 127] == (255, 255, 0, 255)
    assert got["alpha", 0, 0] == (0, 255, 0, 0) and got["alpha", 48, 48] == (245, 120, 40, 255)
    assert got["pixel-art", 45, 50] == (24, 20, 37, 255) and got["pixel-art", 0, 0] == (0, 0, 0, 0)


def turned(image, angle, px=None, py=None):
    """Nine samples a target, one after the other."""
    h, w = image.shape[:2]
    px, py = w / 2 if px is None else px, h / 2 if py is None else py
    out = np.zeros_like(image)

    def like(p, q):
        return (p[3] == 0 and q[3] == 0) or all(abs(int(i) - int(j)) <= 100 for i, j in zip(p, q))

    for y in range(h):
        for x in range(w):
            for k in range(9):
                u, v = 3 * (x - px) + k % 3 - 1, 3 * (y - py) + k // 3 - 1
                to, far = math.atan2(v, u) + angle, math.sqrt(u * u + v * v)
                ox, oy = (math.floor(p * 3 + 1 + far * f(to) + 0.5) + w % 2 for p, f in ((px, math.cos), (py, math.sin)))
                if 0 <= ox < 3 * w and 0 <= oy < 3 * h:
                    break
            else:
                continue
            sx, sy = math.floor((ox - 1) / 3 + 0.5), math.floor((oy - 1) / 3 + 0.5)
            own = out[y, x] = image[sy, sx]
            if sx in (0, w - 1) or sy in (0, h - 1):
                continue
            around = {(i, j): image[sy + j, sx + i] for i in (-1, 0, 1) for j in (-1, 0, 1)}
            i, j = ox % 3 - 1, oy % 3 - 1

            def corner(i, j):
                p, q = around[i, 0], around[0, j]
                return like(p, q) and not like(p, around[0, -j]) and not like(q, around[-i, 0])

            if i and j and corner(i, j):
                out[y, x] = around[i, 0]
            elif i and not j and any(corner(i, s) and not like(own, around[i, -s]) for s in (-1, 1)):
                out[y, x] = around[i, 0]
            elif j and not i and any(corner(s, j) and not like(own, around[-s, j]) for s in (-1, 1)):
                out[y, x] = around[0, j]
    return out


@pytest.mark.parametrize("h,w,angle,pivot", [(9, 12, 0.5, (None, None)), (12, 9, 2.3, (None, None)), (11, 11, -0.8, (3.5, 4.0)), (8, 14, 4.0, (7.0, 1.0)), (1, 1, 0.3, (None, None))])
def test_rotation_by_nine_samples(spark, h, w, angle, pivot):
    r = np.random.default_rng(h * w)
    image = r.choice([0, 80, 200, 255], (h, w, 1)).repeat(4, 2)
    image[r.random((h, w)) < 0.3, 3] = 0
    other = image[::-1].copy()
    got = O.rotate(spark.createDataFrame(rows_of(image) + rows_of(other, 2), PX), w, h, angle, *pivot).collect()
    for i, src in ((1, image), (2, other)):
        assert image_of([g for g in got if g["image_id"] == i], h, w).tolist() == turned(src, angle, *pivot).tolist()


def test_quarter_turns_are_exact(spark):
    image = np.arange(6 * 6 * 4).reshape(6, 6, 4)
    px = spark.createDataFrame(rows_of(image), PX)
    for quarters in (0, 1, 2, 3, 5, -1):
        got = image_of(O.rotate(px, 6, 6, quarters * math.pi / 2).collect(), 6, 6)
        assert got.tolist() == np.rot90(image, quarters).tolist()  # columns of arrays grow down, so positive is counterclockwise as seen
    wide = np.arange(3 * 5 * 4).reshape(3, 5, 4) + 1
    got = image_of(O.rotate(spark.createDataFrame(rows_of(wide), PX), 5, 3, math.pi / 2).collect(), 3, 5)
    assert got[:, 1:4].tolist() == np.rot90(wide[:, 1:4]).tolist() and not got[:, [0, 4]].any()
    assert O.rotate(px.limit(0), 6, 6, 0.4).count() == 0


def painted(width, height, cells, legend, cell):
    """A chart drawn on a canvas, one thing after the other."""
    s, pad = max(cell // 10, 1), max(cell // 10, 2)
    wide = lambda t: (4 * len(t) - 1) * s
    left, top, sw = wide(str(height)) + 2 * pad, 5 * s + 2 * pad, max(cell, 5 * s + 2 * pad)
    places = len(str(max((e[4] for e in legend), default=0)))
    need = left + sw + 3 * pad + 3 * 11 * s + 9 * pad + (4 * places - 1) * s + pad
    canvas = np.full((top + height * cell + 2 * pad + (len(legend) * (sw + 2 * pad) + 4 * pad if legend else 0), max(left + width * cell + pad, need), 4), 255)

    def box(x, y, w, h, color):
        canvas[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = color

    def text(t, x, y, color):
        for i, d in enumerate(t):
            for r in range(5):
                for c in range(3):
                    if H.DIGITS[int(d)][r] >> (2 - c) & 1:
                        box(x + (4 * i + c) * s, y + r * s, s, s, color)

    def step(most):
        return next((n for n in (1, 2, 5, 10, 20, 25, 50, 100, 200, 500) if cell * n >= wide(str(most)) + 2 * s), 500)

    def numbered(n, x, y, side, color):
        t = str(n)
        if wide(t) + 2 <= side and 5 * s + 2 <= side:
            text(t, x + int((side - wide(t)) / 2), y + int((side - 5 * s) / 2), (0, 0, 0, 255) if lab_of(color[:3])[0] > 0.6 else (255, 255, 255, 255))

    black = (0, 0, 0, 255)
    for c in range(0, width, step(width)):
        text(str(c + 1), left + c * cell + int((cell - wide(str(c + 1))) / 2), pad, black)
    for r in range(0, height, step(height)):
        text(str(r + 1), max(left - pad - wide(str(r + 1)), 0), top + r * cell + int((cell - 5 * s) / 2), black)
    colors = {e[0]: (*e[1:4], 255) for e in legend}
    for (r, c), i in cells.items():
        if i in colors:
            box(left + c * cell, top + r * cell, cell, cell, colors[i])
            numbered(i + 1, left + c * cell, top + r * cell, cell, colors[i])
    for c in range(width + 1):
        box(left + c * cell, top, 1, height * cell, (200, 200, 200, 255) if c % 10 else (70, 70, 70, 255))
    for r in range(height + 1):
        box(left, top + r * cell, width * cell, 1, (200, 200, 200, 255) if r % 10 else (70, 70, 70, 255))
    y = top + height * cell + 5 * pad
    for i, r, g, b, n in legend:
        box(left, y, sw, sw, (r, g, b, 255))
        numbered(i + 1, left, y, sw, (r, g, b))
        ty, x = y + int((sw - 5 * s) / 2), left + sw + 3 * pad
        for v in (r, g, b):
            text(f"{v:03}", x, ty, black)
            x += 11 * s + 3 * pad
        text(str(n).zfill(places), x, ty, black)
        y += sw + 2 * pad
    return canvas


@pytest.mark.parametrize("width,height,cell,colors", [(13, 11, 14, 12), (3, 2, 4, 3), (12, 101, 7, 2), (2, 2, 33, 0)])
def test_charts(spark, width, height, cell, colors):
    r = np.random.default_rng(cell)
    cells = {(y, x): int(r.integers(-1, max(colors, 1))) for y in range(height) for x in range(width)}
    legend = [(i, *map(int, r.integers(0, 256, 3)), sum(v == i for v in cells.values())) for i in range(colors)]
    charts = spark.createDataFrame([(5, width, height)], "chart_id long, width int, height int")
    grid = spark.createDataFrame([(5, y, x, v) for (y, x), v in cells.items()], "chart_id long, row int, col int, idx int")
    known = spark.createDataFrame([(5, *e) for e in legend], "chart_id long, idx int, r int, g int, b int, count long")
    want = painted(width, height, cells, legend, cell)
    got = H.chart_pixels(charts, grid, known, cell).collect()
    assert len(got) == want.shape[0] * want.shape[1]
    assert (image_of(got, *want.shape[:2]) == want).all()


def test_chart_refuses_cell_sizes(spark):
    none = spark.createDataFrame([], "chart_id long, idx int, r int, g int, b int, count long, width int, height int, row int, col int")
    with pytest.raises(ValueError):
        H.chart_pixels(none, none, none, 3)


@pytest.mark.parametrize("kind", [None, "drop-shadow"])
def test_sample_is_a_pixel_of_the_flattened_frame(spark, kind):
    r = np.random.default_rng(5)
    effect = {"kind": kind or "outline", "enabled": kind is not None, "color": [9, 8, 7, 200], "thickness": 1, "corners": False, "dx": 1, "dy": 1, "h": 0.0, "s": 0.0, "v": 0.0, "palette": []}
    sprites = spark.createDataFrame([(1, 6, 5), (2, 6, 5)], "sprite_id long, width int, height int")
    layers = spark.createDataFrame([(s, 0, 1, None, "raster", True, 1.0, "normal", False, [effect] if s == 1 else None) for s in (1, 2)] + [(s, 1, 2, None, "raster", True, 0.6, "multiply", True, None) for s in (1, 2)], "sprite_id long, z int, layer_id long, parent_id long, kind string, visible boolean, opacity double, blend string, clipping boolean, effects " + f"array<{K.EFFECT}>")
    cels = spark.createDataFrame([(s, f, k, s * 100 + f * 10 + k, k - 1, f, None) for s in (1, 2) for f in (1, 2) for k in (1, 2)], "sprite_id long, frame_id long, layer_id long, cel_id long, x int, y int, linked_to long")
    px = spark.createDataFrame([(s * 100 + f * 10 + k, y, x, *map(int, r.integers(0, 256, 4))) for s in (1, 2) for f in (1, 2) for k in (1, 2) for y in range(5) for x in range(6) if r.random() < 0.6], "cel_id long, y int, x int, r int, g int, b int, a int")
    whole = {tuple(v[:4]): tuple(v) for v in K.flatten(sprites, layers, cels, px).collect()}
    for x, y in ((0, 0), (2, 3), (5, 4)):
        got = K.sample(sprites, layers, cels, px, spark.createDataFrame([(1, x, y), (2, x, y)], "sprite_id long, x int, y int")).collect()
        assert sorted(map(tuple, got)) == sorted(v for k, v in whole.items() if k[2:] == (y, x)) and len(got) == 4
    assert K.sample(sprites, layers, cels, px, spark.createDataFrame([(1, 6, 0)], "sprite_id long, x int, y int")).count() == 0


def test_photos(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for y in range(8):
        for x in range(16):
            image.setRGB(x, y, 0xC83C1E if x < 8 else 0x1E3CC8)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    flat = np.full((2, 3, 4), (1, 2, 3, 4), np.uint8)
    (tmp_path / "b.png").write_bytes(I.png_bytes(flat))
    (tmp_path / "c.jpeg").write_bytes(b"no image")
    got = I.read_photos(spark, str(tmp_path)).collect()
    assert [g["error"] for g in got if g["error"]] == ["the image cannot be decoded"]
    by = {}
    for g in got:
        by.setdefault(g["image_id"], []).append(g)
    sizes = {len(v): v for v in by.values()}
    assert sorted(sizes) == [1, 6, 128]
    assert {(g["r"], g["g"], g["b"], g["a"]) for g in sizes[6]} == {(1, 2, 3, 4)}
    photo = image_of(sizes[128], 8, 16)
    assert np.abs(photo[:, 1:7] - (0xC8, 0x3C, 0x1E, 255)).max() < 12 and np.abs(photo[:, 9:15] - (0x1E, 0x3C, 0xC8, 255)).max() < 12


def test_bare_files(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (3, 5, 4)).astype(np.uint8)
    (tmp_path / "one.rgba").write_bytes(image.tobytes())
    (tmp_path / "two.rgba").write_bytes(b"12345")
    (tmp_path / "three.txt").write_bytes(b"")
    sizes = spark.createDataFrame([("one", 5, 3), ("two", 1, 1), ("four", 2, 2)], "name string, width int, height int")
    got = I.read_raw(spark, str(tmp_path), sizes).collect()
    assert [g["error"] for g in got if g["error"]] == ["two.rgba has 5 bytes, not 4"]
    assert image_of([g for g in got if g["error"] is None], 3, 5).tolist() == image.tolist()


@pytest.mark.parametrize("bounds,method", [((2, -1, 6, 7), "nine"), (None, "nine"), ((3, 2, 4, 4), "clean"), ((20, 20, 3, 3), "nine")])
def test_transformed_selections(spark, bounds, method):
    from rasterloom.operators.kernels import clean_edge

    r = np.random.default_rng(2)
    image = r.choice([0, 90, 255], (9, 10, 1)).repeat(4, 2)
    px = spark.createDataFrame(rows_of(image), PX)
    got = image_of(O.transformed(px, 10, 9, bounds, 25.0, 150.0, method).collect(), 9, 10)
    x, y, w, h = bounds or (0, 0, 10, 9)
    x, y, right, bottom = max(x, 0), max(y, 0), min(x + w, 10), min(y + h, 9)
    want = image.copy()
    if x < right and y < bottom:
        part = image[y:bottom, x:right]
        want[y:bottom, x:right] = turned(part, math.radians(25)) if method == "nine" else image_of(clean_edge(spark.createDataFrame(rows_of(part), PX), right - x, bottom - y, math.radians(25), 1.5).collect(), bottom - y, right - x)
    assert got.tolist() == want.tolist()


def test_proxy_sizes():
    from rasterloom.operators.raster import proxy_size

    assert [proxy_size(*s) for s in ((1024, 3), (2048, 1024), (3000, 1), (1500, 1001))] == [(1024, 3), (1024, 512), (1024, 1), (1024, 683)]
