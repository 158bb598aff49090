"""Layered files, tile symmetries and refused edits on small cases."""

import struct
import zlib

from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import documents as D
from rasterloom.operators import kernels as K
from rasterloom.operators import tilemaps as M
from rasterloom.operators import trees as T
from rasterloom.sources import layered

LAYERS = "sprite_id long, layer_id long, parent_id long, kind string, z int"


def text(s):
    return struct.pack("<H", len(s)) + s.encode()


def chunk(kind, body):
    return struct.pack("<IH", len(body) + 6, kind) + body


def layer(name, kind=0, level=0, tiles=None):
    return chunk(layered.LAYER, struct.pack("<HHHHHHB3x", 3, kind, level, 0, 0, 0, 255) + text(name) + (struct.pack("<I", tiles) if tiles is not None else b""))


def cel(at, kind, body):
    return chunk(layered.CEL, struct.pack("<HhhBH7x", at, 1, -2, 200, kind) + body)


def file(depth, frames, size=(4, 3), clear=0):
    out = b""
    for ms, chunks in frames:
        body = b"".join(chunks)
        out += struct.pack("<IHHHHI", len(body) + 16, layered.FRAME_MAGIC, len(chunks), ms, 0, len(chunks)) + body
    head = struct.pack("<IHHHHH", len(out) + 128, layered.MAGIC, len(frames), *size, depth)
    return head + bytes(28 - len(head)) + bytes([clear]) + bytes(99) + out


def sample():
    palette = chunk(layered.PALETTE, struct.pack("<III8x", 3, 0, 2) + struct.pack("<HBBBB", 0, 9, 9, 9, 255) + struct.pack("<HBBBB", 1, 10, 20, 30, 255) + text("red") + struct.pack("<HBBBB", 0, 40, 50, 60, 70))
    tags = chunk(layered.TAGS, struct.pack("<H8x", 1) + struct.pack("<HHB12x", 0, 1, 2) + text("walk"))
    tiles = zlib.compress(bytes([1] * 4 + [2] * 4))
    tileset = chunk(layered.TILESET, struct.pack("<IIIHH16x", 7, 2, 3, 2, 2) + text("set") + struct.pack("<I", len(tiles)) + tiles)
    numbers = zlib.compress(struct.pack("<2I", 1 | 1 << 31, 2 | 1 << 29))
    grid = struct.pack("<HHHIIII10x", 2, 1, 32, (1 << 28) - 1, 1 << 31, 1 << 30, 1 << 29) + numbers
    first = [palette, tags, tileset, layer("group", 1), layer("ink", 0, 1), layer("map", 2, 0, 7), layer("lost", 2, 0, 8), cel(1, 2, struct.pack("<HH", 2, 2) + zlib.compress(bytes([0, 1, 2, 9]))), cel(2, 3, grid), cel(3, 3, grid)]
    return file(8, [(100, first), (50, [cel(1, 1, struct.pack("<H", 0))])])


def test_layered_file(spark):
    whole = sample()
    gray = file(16, [(1, [layer("a"), cel(0, 0, struct.pack("<HH", 1, 1) + bytes([5, 6]))])])
    files = spark.createDataFrame([(1, whole), (2, b"junk"), (3, whole[:300]), (4, None), (5, gray)], "image_id long, content binary")
    rows = layered.decode_layered(files).collect()
    of = lambda i, kind: [r for r in rows if r.image_id == i and r.kind == kind]
    assert [len(of(i, "error")) for i in (1, 2, 3, 4, 5)] == [0, 1, 1, 1, 0]
    assert all(len([r for r in rows if r.image_id == i]) == 1 for i in (2, 3, 4))
    assert [(r.n, r.value) for r in of(1, "frame")] == [(0, 100), (1, 50)]
    assert [(r.n, r.parent, r.name) for r in of(1, "layer")] == [(0, None, "group"), (1, 0, "ink"), (2, None, "map")]
    assert len(of(1, "warning")) == 1 and "lost" in of(1, "warning")[0].name
    ink, grid = of(1, "cel")
    assert (ink.layer, ink.frame, ink.x, ink.y, ink.width, ink.height, ink.value) == (1, 0, 1, -2, 2, 2, 200)
    assert bytes(ink.data) == bytes([0, 0, 0, 0, 10, 20, 30, 255, 40, 50, 60, 70, 0, 0, 0, 0])
    assert struct.unpack("<2I", grid.data) == (1 | 1 << 28, 2 | 1 << 30)
    assert [(r.layer, r.frame, r.value) for r in of(1, "link")] == [(1, 1, 0)]
    assert [(r.x, r.y, r.value, r.name) for r in of(1, "tag")] == [(0, 1, 2, "walk")]
    assert [bytes(r.data)[:4] for r in of(1, "tile")] == [bytes([10, 20, 30, 255]), bytes([40, 50, 60, 70]), bytes(4)]
    assert of(1, "color")[1].value == 0x0A141EFF
    assert bytes(of(5, "cel")[0].data) == bytes([5, 5, 5, 6])


def test_tree_edits_that_are_refused(spark):
    rows = [(1, 1, None, "group", 0), (1, 2, 1, "group", 1), (1, 3, 2, "raster", 2), (2, 4, None, "raster", 0), (2, 5, None, "raster", 1)]
    layers = spark.createDataFrame(rows, LAYERS)
    same = lambda df: sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    for edit in ((1, 1, 2), (1, 1, 1), (1, 1, None), (2, 4, 5), (2, 4, 99), (2, 99, None)):
        assert same(T.reparent(layers, spark.createDataFrame([edit], "sprite_id long, layer_id long, target long"))), edit
    moved = T.reparent(layers, spark.createDataFrame([(1, 3, 1)], "sprite_id long, layer_id long, target long"))
    assert moved.where("layer_id = 3").first().parent_id == 1
    edits = lambda *e: spark.createDataFrame(list(e), "sprite_id long, layer_id long")
    assert same(T.delete_cascade(layers, edits((1, 1), (2, 99))))
    assert sorted(r.layer_id for r in T.delete_cascade(layers, edits((1, 2), (2, 5))).collect()) == [1, 4]
    assert same(T.ungroup(layers, edits((1, 3), (2, 4))))
    assert same(T.move_among_siblings(layers, spark.createDataFrame([(1, 1, 1), (2, 5, 1)], "sprite_id long, layer_id long, delta long")))
    assert T.delete_cascade(layers.limit(0), edits((1, 1))).count() == 0


def test_tile_turns(spark):
    pixels = spark.createDataFrame([(1, y, x, 10 * y + x, 0, 0, 255) for y in range(2) for x in range(2)], "tile long, ty int, tx int, r int, g int, b int, a int")
    image = [[0, 1], [10, 11]]
    for k in range(8):
        h, v, t = k & 1, k >> 1 & 1, k >> 2
        cells = spark.createDataFrame([(1, 0, 0)], "image_id long, col int, row int").withColumn("packed", G.pack_tile(F.lit(1), F.lit(h), F.lit(v), F.lit(t)))
        got = {(r.y, r.x): r.r for r in M.render_tilemap(cells, pixels, "rect", 2, 2, 2, 2).collect()}
        want = [list(r) for r in zip(*image)] if t else image
        want = [r[::-1] for r in want] if h else want
        want = want[::-1] if v else want
        assert got == {(y, x): want[y][x] for y in range(2) for x in range(2)}, k


def test_wand_outside_and_clean_edge_identity(spark):
    px = spark.createDataFrame([(1, y, x, x, y, 0, 255) for y in range(3) for x in range(3)], "image_id long, y int, x int, r int, g int, b int, a int")
    assert K.wand(px, 7, 7).count() == 0 and K.wand(px, 1, 1).count() == 1
    assert sorted(map(tuple, K.clean_edge(px, 3, 3, 0.0, 1.0).collect())) == sorted(map(tuple, px.collect()))


def test_large_layer_tree(spark):
    flat = spark.range(1_200_000).select(F.col("id").alias("layer_id"), F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent_id"), F.col("id").cast("int").alias("z"), F.lit(True).alias("visible"))
    assert D.layer_tree(spark, flat).count() == 1_200_000
