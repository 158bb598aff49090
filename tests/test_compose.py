"""Flattening, effects, sheets, indices and conversion settings against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import geometry as G
from rasterloom.operators import compose as K
from rasterloom.operators import convert as V
from rasterloom.operators import export as X
from rasterloom.operators import indexed as N
from rasterloom.operators import raster as R

EMPTY = {"enabled": True, "color": [9, 8, 7, 200], "thickness": 2, "corners": False, "dx": 0, "dy": 0, "h": 0.0, "s": 0.0, "v": 0.0, "palette": []}


def some(seed, h=7, w=9):
    r = np.random.default_rng(seed)
    px = r.integers(0, 256, (h, w, 4)).astype(float)
    px[r.random((h, w)) < 0.6] = 0
    return px


@pytest.mark.parametrize("mode", C.MODES)
def test_blends_are_those_of_the_columns(spark, mode):
    src, dst = some(1), some(2)
    src[0, 0], dst[0, 0], src[0, 1], dst[0, 1] = (255, 0, 255, 255), (0, 255, 255, 255), (0, 0, 0, 255), (255, 255, 255, 128)
    rows = [(int(i), *map(int, s), *map(int, t)) for i, (s, t) in enumerate(zip(src.reshape(-1, 4), dst.reshape(-1, 4)))]
    df = spark.createDataFrame(rows, "i int, sr int, sg int, sb int, sa int, dr int, dg int, db int, da int")
    s, t = (tuple(F.col(f"{k}{c}") for c in "rgba") for k in "sd")
    got = C.over_modes(df, s, F.lit(0.7), t, [mode]).select("i", *(f"out_{c}" for c in "rgba"))
    assert mode in C.NON_SEPARABLE or got.exceptAll(df.select("i", *C.over(s, F.lit(0.7), t, mode))).count() == 0
    want = K.over(src, 0.7, dst, mode).reshape(-1, 4)
    assert [list(r[1:]) for r in got.orderBy("i").collect()] == want.astype(int).tolist()


@pytest.mark.parametrize("name", ["composite_separable", "composite_non_separable", "oklab_roundtrip"])
def test_generated_code_is_compiled(spark, name):
    """Methods of more than 8,000 bytes are never compiled by the JVM, and of more than 64 KB not even loaded."""
    from rasterloom.plans import QUERIES

    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    stages = debug.codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and 0 < max(sizes) < 8000, sizes


def test_rings_go_by_steps_from_the_silhouette():
    px = some(3)
    seen = px[..., 3] > 0
    at = np.argwhere(seen)
    for corners in (False, True):
        out = K.with_effects(px, [EMPTY | {"kind": "outline", "corners": corners}])
        for y, x in np.ndindex(seen.shape):
            d = np.abs(at - (y, x))
            near = (d.max(1) if corners else d.sum(1)).min() <= 2
            assert out[y, x].tolist() == (px[y, x].tolist() if seen[y, x] or not near else [9, 8, 7, 200])
    out = K.with_effects(px, [EMPTY | {"kind": "outline-inner"}])
    holes = [(y, x) for y in range(-1, 8) for x in range(-1, 10) if not (0 <= y < 7 and 0 <= x < 9 and seen[y, x])]
    for y, x in np.ndindex(seen.shape):
        ring = min(abs(y - i) + abs(x - j) for i, j in holes) <= 2
        assert out[y, x].tolist() == ([9, 8, 7, min(px[y, x, 3], 200)] if seen[y, x] and ring else px[y, x].tolist())


def test_shadow_gradient_hue_and_order():
    px = some(4)
    out = K.with_effects(px, [EMPTY | {"kind": "drop-shadow", "dx": 2, "dy": -1}])
    for y, x in np.ndindex(px.shape[:2]):
        under = np.array([9, 8, 7, 200.0]) if 0 <= y + 1 < 7 and 0 <= x - 2 < 9 and px[y + 1, x - 2, 3] > 0 else np.zeros(4)
        assert out[y, x].tolist() == (under if px[y, x, 3] == 0 else K.over(px[y, x], 1.0, under)).tolist()
    ramp = [[0, 0, 0, 255], [255, 0, 0, 255], [255, 255, 255, 255]]
    out = K.with_effects(px, [EMPTY | {"kind": "gradient-map", "palette": ramp}])
    seen = px[..., 3] > 0
    light = K._lab(px[..., :3])[..., 0]
    lo, hi = (np.where(seen, light, v) for v in (9, -9))
    assert out[np.unravel_index(lo.argmin(), lo.shape)][:3].tolist() == [0, 0, 0] and out[np.unravel_index(hi.argmax(), hi.shape)][:3].tolist() == [255, 255, 255]
    assert (out[..., 3] == px[..., 3]).all() and (out[~seen] == px[~seen]).all()
    assert (K.with_effects(px, [EMPTY | {"kind": "gradient-map"}]) == px).all()
    same = K.with_effects(px, [EMPTY | {"kind": "hsv-shift", "h": 360.0}])
    assert np.abs(same - px).max() <= 1
    first, then = EMPTY | {"kind": "outline"}, EMPTY | {"kind": "drop-shadow", "dx": 1, "dy": 1}
    assert (K.with_effects(px, [first, then]) != K.with_effects(px, [then, first])).any()
    assert (K.with_effects(px, [first | {"enabled": False}]) == px).all()


def test_hsv_columns_and_arrays_agree(spark):
    px = some(5)
    df = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(px.reshape(-1, 4))], "i int, r int, g int, b int, a int")
    got = [list(r)[1:] for r in C.hsv_shift(df, -200.0, 20.0, -15.0).orderBy("i").collect()]
    assert got == K.with_effects(px, [EMPTY | {"kind": "hsv-shift", "h": -200.0, "s": 20.0, "v": -15.0}]).reshape(-1, 4).astype(int).tolist()


def flattened(spark, layers, content, shape=(7, 9)):
    """K.flatten of one sprite with a frame, whose raster layers have the contents."""
    h, w = shape
    sprites = spark.createDataFrame([(1, w, h)], "sprite_id long, width int, height int")
    rows = [(1, *(x[c] for c in "z layer_id parent_id kind visible opacity blend clipping effects".split())) for x in layers]
    tree = spark.createDataFrame(rows, f"sprite_id long, z int, layer_id long, parent_id long, kind string, visible boolean, opacity double, blend string, clipping boolean, effects array<{K.EFFECT}>")
    cels = spark.createDataFrame([(1, 1, x["layer_id"], x["layer_id"], 0, 0, None) for x in layers if x["kind"] != "group"], "sprite_id long, frame_id long, layer_id long, cel_id long, x int, y int, linked_to long")
    held = [(k, y, x, *map(int, v[y, x])) for k, v in content.items() for y in range(h) for x in range(w) if v[y, x].any()]
    px = spark.createDataFrame(held, "cel_id long, y int, x int, r int, g int, b int, a int")
    out = np.zeros((h, w, 4))
    for r in K.flatten(sprites, tree, cels, px).collect():
        out[r.y, r.x] = r.r, r.g, r.b, r.a
    return out


def test_a_clip_without_a_base_shows_nothing_and_groups_are_units(spark, monkeypatch):
    px = {1: some(6), 2: some(7), 3: some(8)}
    layer = lambda k, z, parent=None, kind="raster", **more: {"layer_id": k, "z": z, "parent_id": parent, "kind": kind, "visible": True, "opacity": 1.0, "blend": "normal", "clipping": False, "effects": None} | more
    flat = lambda *layers: flattened(spark, layers, px)
    assert (flat(layer(1, 0, clipping=True)) == 0).all()
    assert (flat(layer(1, 0, visible=False), layer(2, 1, clipping=True)) == 0).all()
    one = K.over(px[2], 1.0, K.over(px[1], 1.0, np.zeros((7, 9, 4))))
    half = np.where(one[..., 3:] > 0, K.over(one, 0.5, np.zeros((7, 9, 4))), 0)
    assert (flat(layer(9, 0, kind="group", opacity=0.5), layer(1, 0, 9), layer(2, 1, 9)) == half).all()
    # a clip in a group does not see layers outside it
    alone = flat(layer(1, 0))
    assert (flat(layer(1, 0), layer(9, 1, kind="group"), layer(2, 0, 9, clipping=True)) == alone).all()
    deep = [layer(100, 0, kind="group"), *(layer(100 + k, 0, 99 + k, kind="group") for k in range(1, 60)), layer(3, 0, 159)]
    assert (flat(*deep) == K.over(px[3], 1.0, np.zeros((7, 9, 4)))).all()
    # a layer below no root, and one whose ancestors run in a circle, show nowhere
    assert (flat(layer(1, 0), layer(2, 0, 77), layer(50, 0, 51, kind="group"), layer(51, 0, 50, kind="group"), layer(3, 0, 50)) == alone).all()
    # blocks: without effects a pixel hangs on its own place only
    tree = [layer(9, 0, kind="group", opacity=0.5, blend="multiply"), layer(1, 0, 9), layer(2, 1, 9, clipping=True, opacity=0.7), layer(3, 1, blend="hue")]
    whole = flat(*tree)
    monkeypatch.setattr(K, "BLOCK", 4)
    assert (flat(*tree) == whole).all()
    ring = [{"kind": "outline", "enabled": True, "color": [1, 2, 3, 255], "thickness": 2, "corners": True, "dx": 0, "dy": 0, "h": 0.0, "s": 0.0, "v": 0.0, "palette": None}]
    edged = flat(layer(1, 0, effects=ring))
    assert (edged == K.over(K.with_effects(px[1], ring), 1.0, np.zeros((7, 9, 4)))).all()


def test_scales_sheets_and_tiles(spark):
    px = spark.createDataFrame([(0, 0, 0, 1, 2, 3, 4)], "image_id long, y int, x int, r int, g int, b int, a int")
    assert sorted((r.y, r.x) for r in X.scale_nearest(px, 2).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    with pytest.raises(ValueError):
        X.scale_nearest(px, 3)
    tags = spark.createDataFrame([(1, "a", 7, 2, 5), (1, "b", -3, 0, 5)], "sprite_id int, tag string, lo int, hi int, frames int")
    assert sorted((r.tag, r.first, r.taken, r["from"], r["to"]) for r in X.rebased_tags(tags).collect()) == [("a", 2, 3, 0, 2), ("b", 0, 1, 0, 0)]


def test_settings_of_the_conversion(spark):
    r = np.random.default_rng(9)
    rows = [(i, y, x, *map(int, r.integers(0, 256, 3)), int(r.integers(0, 256)) if i and 2 <= x < 9 and 3 <= y < 8 else 0) for i in (0, 1, 2) for y in range(12) for x in range(12)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    pal = ((0, 0, 0), (255, 255, 255), (200, 30, 30), (30, 30, 200))
    s = V.Settings(6, 6, mode="nearest", palette=pal, fit=True, alpha_threshold=60, preserve_alpha=True, color_space="srgb", outline_color=(190, 40, 40, 77), thickness=2)
    got = {(q.image_id, q.y, q.x): (q.idx, q.a) for q in V.convert(px, s, 12, 12).collect()}
    assert len(got) == 3 * 36
    for i in (0, 1, 2):
        own = {(y, x): p for j, y, x, *p in rows if j == i}
        seen = [k for k, p in own.items() if p[3] >= 60]
        (y0, x0), (y1, x1) = ((min(k[n] for k in seen) for n in (0, 1)), (max(k[n] for k in seen) for n in (0, 1))) if seen else ((0, 0), (11, 11))
        h, w = y1 - y0 + 1, x1 - x0 + 1
        small = {(y, x): own[y0 + min(h - 1, (2 * y + 1) * h // 12), x0 + min(w - 1, (2 * x + 1) * w // 12)] for y in range(6) for x in range(6)}
        full = [k for k, p in small.items() if p[3] >= 60]
        for (y, x), p in small.items():
            if p[3] >= 60:
                d = [sum((u - v) ** 2 for u, v in zip(p, c)) for c in pal]
                want = (d.index(min(d)), p[3])
            elif any(abs(y - j) + abs(x - k) <= 2 for j, k in full):
                want = (2, 77)
            else:
                want = (65535, 0)
            assert got[i, y, x] == want, (i, y, x)
    own = V.convert(px, V.Settings(6, 6, max_colors=3, alpha_threshold=60, outline_color=(190, 40, 40, 77)), 12, 12).collect()
    assert len(own) == 108 and all(q.a in (0, 77, 255) for q in own)
    with pytest.raises(ValueError):
        V.crop(px, 12, 0, 5, 5, 12, 12)


def test_corners_are_removed_as_the_stroke_goes(spark):
    r, rows = random.Random(2), []
    for k in range(60):
        p = [(0, 0)]
        for _ in range(20):
            dx, dy = r.choice([(1, 0), (0, 1), (0, 0), (-1, 0), (1, 1)])
            p.append((p[-1][0] + dx, p[-1][1] + dy))
        rows.append((k, p))
    df = spark.createDataFrame(rows, "k int, p array<struct<x:int,y:int>>")
    for k, got in df.select("k", G.without_corners(F.col("p"))).collect():
        kept = []
        for q in rows[k][1]:
            if kept and kept[-1] == q:
                continue
            kept.append(q)
            if len(kept) > 2:
                (ax, ay), (bx, by), (cx, cy) = kept[-3:]
                if abs(ax - cx) == abs(ay - cy) == 1 and abs(ax - bx) + abs(ay - by) == abs(cx - bx) + abs(cy - by) == 1:
                    del kept[-2]
        assert [(q.x, q.y) for q in got] == kept


def test_buffers_and_indices(spark):
    layers = spark.createDataFrame([(1, "raster"), (2, "group"), (3, "tilemap")], "layer_id long, kind string")
    cels = spark.createDataFrame([(1, 10, None), (1, 11, 10), (3, 12, None), (1, 13, None)], "layer_id long, cel_id long, linked_to long")
    assert sorted(r.buffer_id for r in N.raster_buffers(layers, cels).collect()) == [10, 13]
    px = spark.createDataFrame([(0, 0, 0, 1, 2, 3, 4)], "image_id long, y int, x int, r int, g int, b int, a int")
    assert N.to_indexed(px, []).first().i == 0 and N.from_indexed(px.withColumn("i", F.lit(3)), []).first().a == 0
    assert N.to_indexed(px, [(255, 255, 255), (0, 0, 0)]).first().i == 2
    assert R.nearest_of((250, 250, 250), [(0, 0, 0), (255, 255, 255)]) == 1
