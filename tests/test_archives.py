"""Project archives: opened, refused, written and opened again."""

import io
import json
import zipfile

import duckdb
import numpy as np
import pytest

import __spark_entry__
from rasterloom.sources import archives as A
from rasterloom.sources.images import png_bytes

LAYER = {"name": "x", "visible": True, "locked": False, "opacity": 0.5, "blendMode": "hard-light"}


def document(**more):
    return {
        "width": 6, "height": 5, "layers": [{"kind": "raster", "id": "r", **LAYER, "effects": [{"kind": "drop-shadow", "id": "e", "enabled": True, "dx": 1, "dy": -2, "color": [1, 2, 3, 4]}]}, {"kind": "group", "id": "g", "collapsed": True, **LAYER},
        {"kind": "tilemap", "id": "t", "parentId": "g", "clippingMask": True, "tilesetId": "s", "grid": {"shape": "rect", "tileWidth": 2, "tileHeight": 2, "offsetX": 0, "offsetY": 0}, **LAYER},
        {"kind": "conversion", "id": "v", "source": {"sourceId": 3, "settings": {"width": 8, "palette": [1, 2]}}, **LAYER}],
        "frames": [{"id": "f1", "durationMs": 100}, {"id": "f2", "durationMs": 50}],
        "cels": [{"id": "a", "layerId": "r", "frameId": "f1", "x": 1, "y": 0, "width": 3, "height": 2}, {"id": "b", "layerId": "r", "frameId": "f2", "x": 0, "y": 0, "width": 3, "height": 2, "linkedTo": "a"},
                 {"id": "c", "layerId": "t", "frameId": "f1", "x": 0, "y": 0, "width": 4, "height": 4}, {"id": "d", "layerId": "v", "frameId": "f1", "x": 0, "y": 0, "width": 1, "height": 1}],
        "tags": [{"id": "q", "name": "walk", "from": 0, "to": 1, "direction": "pingpong", "color": "#e15554"}],
        "tilesets": [{"id": "s", "name": "s", "tileWidth": 2, "tileHeight": 2, "tiles": [{"id": "0"}, {"id": "1"}]}], **more,
    }


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("folder/", b"")
        for name, data in files.items():
            z.writestr(name, json.dumps(data) if isinstance(data, dict) else data)
    return out.getvalue()


PIXELS = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
MANIFEST = {"formatVersion": 1, "appVersion": "0", "width": 6, "height": 5, "layerCount": 4, "frameCount": 2}
FULL = {"manifest.json": MANIFEST, "sprite.json": document(), "cels/a.png": png_bytes(PIXELS), "cels/c.bin": b"12345678", "tiles/s/0.png": png_bytes(PIXELS[:2, :2]), "tiles/s/1.png": png_bytes(PIXELS), "cels/gone.png": b"old", "later/notes.txt": b"kept", "thumbnail.png": b"old"}


@pytest.fixture(scope="module")
def opened(spark):
    files = [
        (1, archive(**FULL)), (2, b"no zip"), (3, None), (4, archive()), (5, archive(**{"manifest.json": MANIFEST})), (6, archive(**{**FULL, "manifest.json": {**MANIFEST, "formatVersion": 2}})),
        (7, archive(**{**FULL, "sprite.json": document(colorMode="grayscale")})), (8, archive(**{**FULL, "sprite.json": b"{"})), (9, archive(**{"manifest.json": MANIFEST, "sprite.json": document(colorMode="indexed"), "cels/a.bin": b"123456", "cels/c.bin": b""})),
    ]
    entry = A.entries(spark.createDataFrame(files, "archive_id long, content binary")).cache()
    return entry, A.documents(entry).cache()


def test_archives_that_cannot_be_opened_say_why(opened):
    got = {r["archive_id"]: r["error"] for r in opened[1].collect()}
    assert sorted(got) == list(range(1, 10)) and got[1] is None and got[9] is None
    assert got[2].startswith("not an archive") and got[3].startswith("not an archive")
    assert got[4] == "archive has no manifest.json" and got[5] == "archive has no sprite.json"
    assert got[6] == "written by a newer version: format 2 > 1" and got[7] == "unsupported color mode grayscale" and got[8] == "sprite.json cannot be read"
    assert opened[1].where("error IS NOT NULL AND sprite IS NOT NULL").count() == 0


def test_parts_of_the_document(opened):
    layers = [r for r in A.parts(opened[1], "layers").orderBy("pos").collect() if r["archive_id"] == 1]
    assert [r["kind"] for r in layers] == ["raster", "group", "tilemap", "conversion"] and layers[2]["grid"]["tileWidth"] == 2 and layers[2]["parentId"] == "g"
    assert layers[0]["effects"][0]["dy"] == -2 and layers[1]["collapsed"] and layers[0]["opacity"] == 0.5
    assert [(r["from"], r["to"], r["direction"]) for r in A.parts(opened[1], "tags").where("archive_id = 1").collect()] == [(0, 1, "pingpong")]


def test_contents_and_warnings(opened):
    entry, document_ = opened
    got = {(r["archive_id"], r["kind"], r["id"]): r for r in A.contents(document_, entry).collect()}
    assert sorted(k[1:] for k in got if k[0] == 1) == [("cel", "a"), ("cel", "c"), ("cel", "d"), ("tile", "0"), ("tile", "1")]
    assert bytes(got[1, "cel", "a"]["data"]) == PIXELS.tobytes() and got[1, "cel", "a"]["warning"] is None
    assert bytes(got[1, "cel", "c"]["data"]) == b"12345678" and got[1, "cel", "c"]["raw"]
    assert got[1, "cel", "d"]["warning"] == "missing cels/d.png; layer opens empty" and got[1, "cel", "d"]["data"] is None
    assert "3x2 but the document says 2x2" in got[1, "tile", "1"]["warning"]
    assert bytes(got[9, "cel", "a"]["data"]) == b"123456" and got[9, "tile", "0"]["warning"] == "missing tiles/s/0.png; tile is blank"


def test_written_archives_open_alike_and_keep_what_is_unknown(spark, opened):
    entry, document_ = opened
    content = A.contents(document_, entry)
    thumbs = spark.createDataFrame([(1, b"new")], "archive_id long, png binary")
    packed = A.packed(document_, content, thumbs, entry)
    rows = {r["archive_id"]: bytes(r["content"]) for r in packed.collect()}
    assert sorted(rows) == [1, 9]
    with zipfile.ZipFile(io.BytesIO(rows[1])) as z:
        assert z.namelist() == ["cels/a.png", "cels/c.bin", "later/notes.txt", "manifest.json", "sprite.json", "thumbnail.png", "tiles/s/0.png", "tiles/s/1.png"]
        assert z.read("later/notes.txt") == b"kept" and z.read("thumbnail.png") == b"new"
        assert json.loads(z.read("manifest.json")) == {"formatVersion": 1, "appVersion": "1", "width": 6, "height": 5, "layerCount": 4, "frameCount": 2}
        sprite = json.loads(z.read("sprite.json"))
        assert sprite["layers"][3]["source"] == {"sourceId": 3, "settings": {"width": 8, "palette": [1, 2]}} and sprite["cels"][1]["linkedTo"] == "a"
    again = A.entries(spark.createDataFrame(list(rows.items()), "archive_id long, content binary"))
    key = lambda df: sorted((r["archive_id"], r["kind"], r["id"], bytes(r["data"] or b""), r["width"]) for r in df.where("data IS NOT NULL").collect())
    assert key(A.contents(A.documents(again), again)) == key(content)


def test_no_archives(spark, opened):
    none = opened[0].limit(0)
    assert A.documents(none).count() == 0 and A.contents(A.documents(none), none).count() == 0


def test_canvases_end_with_their_last_row_and_are_transparent_where_nothing_is(spark):
    px = spark.createDataFrame([(7, 1, 2, 9, 8, 7, 255), (7, 0, 0, 1, None, 3, 4), (8, 0, 1, 5, 6, 7, 8), (None, None, None, 1, 1, 1, 1)], "image_id long, y int, x int, r int, g int, b int, a int")
    got = {r["image_id"]: (r["height"], bytes(r["data"])) for r in A.canvases(px, 3).collect()}
    assert got == {7: (2, bytes([1, 0, 3, 4] + [0] * 16 + [9, 8, 7, 255])), 8: (1, bytes([0] * 4 + [5, 6, 7, 8] + [0] * 4))}


def test_content_pixels_keep_the_other_columns(spark):
    content = spark.createDataFrame([(1, "a", 3, PIXELS.tobytes()), (2, "b", 3, None), (3, "c", 1, b"\x01\x02\x03\x04")], "archive_id long, of string, width int, data binary")
    rows = A.content_pixels(content)
    assert rows.columns == ["archive_id", "of", "y", "x", *"rgba"]
    assert sorted(map(tuple, rows.collect())) == [(1, "a", y, x, *map(int, PIXELS[y, x])) for y in range(2) for x in range(3)] + [(3, "c", 0, 0, 1, 2, 3, 4)]


def test_project_archives_make_no_row_that_carries_its_image(spark, tmp_path):
    rows = [(k, None if k % 5 == 0 else k % 97) for k in range(4096 + 70)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    out = __spark_entry__.queries()["project_archives"](spark, str(tmp_path))
    sql = __spark_entry__.oracle_sql()["project_archives"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(db.execute(sql).fetchall())
    assert out._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("MapInArrow")
