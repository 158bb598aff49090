"""Fingerprints of frames: they change with what a frame shows, and with nothing else."""

import json

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import cache as H
from rasterloom.operators import compose as K

RING = {"kind": "outline", "enabled": True, "color": [1, 2, 3, 255], "thickness": 1, "corners": False, "dx": 0, "dy": 0, "h": 0.0, "s": 0.0, "v": 0.0, "palette": None}


def document(spark):
    sprites = spark.createDataFrame([(1, 3, 2), (2, 3, 2)], "sprite_id long, width int, height int")
    rows = [(s, z, 10 * s + z, None if z < 2 else 10 * s, "group" if z == 0 else "raster", True, 1.0, "normal", z == 3, None) for s in (1, 2) for z in range(4)]
    layers = spark.createDataFrame(rows, f"sprite_id long, z int, layer_id long, parent_id long, kind string, visible boolean, opacity double, blend string, clipping boolean, effects array<{K.EFFECT}>")
    cels = spark.createDataFrame([(s, f, 10 * s + z, 100 * s + z, 0, 0, None) for s in (1, 2) for f in (0, 1) for z in (1, 2, 3)], "sprite_id long, frame_id long, layer_id long, cel_id long, x int, y int, linked_to long")
    px = spark.createDataFrame([(100 * s + z, y, x, z, x, y, 255) for s in (1, 2) for z in (1, 2, 3) for y in range(2) for x in range(3)], "cel_id long, y int, x int, r int, g int, b int, a int")
    return sprites, layers, cels, px


def prints(*tables):
    return {(r.sprite_id, r.frame_id): r.fingerprint for r in H.frame_fingerprints(*tables).collect()}


def test_what_changes_a_fingerprint(spark):
    sprites, layers, cels, px = document(spark)
    one = F.col("sprite_id") == 1
    effects = lambda on: F.when(one & (F.col("layer_id") == 11), F.expr(f"from_json('[{json.dumps(RING | {'enabled': on})}]', 'array<{K.EFFECT}>')")).otherwise(F.col("effects"))
    was = prints(sprites, layers, cels, px)
    assert len(was) == 4 and was[1, 0] == was[1, 1]
    changes = {
        "opacity": (sprites, layers.withColumn("opacity", F.when(F.col("layer_id") == 12, 0.5).otherwise(1.0)), cels, px),
        "blend": (sprites, layers.withColumn("blend", F.when(F.col("layer_id") == 10, "screen").otherwise("normal")), cels, px),
        "hidden": (sprites, layers.withColumn("visible", F.col("layer_id") != 13), cels, px),
        "order": (sprites, layers.withColumn("z", F.when(one, -F.col("z")).otherwise(F.col("z"))), cels, px),
        "effect": (sprites, layers.withColumn("effects", effects(True)), cels, px),
        "place": (sprites, layers, cels.withColumn("x", F.when(one, 1).otherwise(0)), px),
        "pixel": (sprites, layers, cels, px.withColumn("r", F.when((F.col("cel_id") == 102) & (F.col("x") == 0), 77).otherwise(F.col("r")))),
        "size": (sprites.withColumn("width", F.when(one, 4).otherwise(3)), layers, cels, px),
    }
    for name, tables in changes.items():
        now = prints(*tables)
        assert now[1, 0] != was[1, 0] and now[2, 0] == was[2, 0], name
    same = {
        "rows": (sprites, layers, cels, px.orderBy(F.rand(1)).repartition(3)), "disabled": (sprites, layers.withColumn("effects", effects(False)), cels, px),
        "empty pixels": (sprites, layers, cels, px.union(spark.createDataFrame([(102, 5, 5, 0, 0, 0, 0)], px.schema))), "a hidden layer": (sprites, layers.union(spark.createDataFrame([(1, 9, 99, None, "raster", False, 1.0, "hue", False, None)], layers.schema)), cels, px),
    }
    for name, tables in same.items():
        assert prints(*tables) == was, name


@pytest.mark.parametrize("gone", [False, True])
def test_only_changed_frames_are_made_anew(spark, gone):
    sprites, layers, cels, px = document(spark)
    cached = spark.createDataFrame(H.filled(sprites, layers, cels, px).collect(), "sprite_id long, frame_id long, fingerprint string, y int, x int, r int, g int, b int, a int")
    moved = cels.withColumn("x", F.when((F.col("sprite_id") == 1) & (F.col("frame_id") == 1), 1).otherwise(0))
    moved = moved.where("sprite_id = 1") if gone else moved
    got = H.refreshed(cached, sprites, layers, moved, px).collect()
    want = K.flatten(sprites, layers, moved, px).collect()
    assert sorted((r.sprite_id, r.frame_id, r.y, r.x, r.r, r.g, r.b, r.a) for r in got) == sorted(map(tuple, want))
    assert {(r.sprite_id, r.frame_id) for r in got if not r.reused} == {(1, 1)}
    assert {r.sprite_id for r in got} == ({1} if gone else {1, 2})
