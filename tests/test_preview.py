"""The preview's stateful core over several batches, and its one-image conversion against the relational one."""

import datetime as dt
import json

import numpy as np
import pytest

from rasterloom.operators import convert as V
from rasterloom.sources.palettes import colors
from rasterloom.streaming import preview as P

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def image(seed, w, h):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4))


@pytest.mark.parametrize("more", [{}, {"mode": "nearest"}, {"dither": "floyd-steinberg"}, {"palette": (), "max_colors": 5}, {"alpha_threshold": 10, "palette": tuple(colors("c64"))}])
def test_one_image_converts_as_a_relation_does(spark, more):
    px = image(3, 13, 11)
    s = {"width": 6, "height": 5, "palette": tuple(colors("gameboy"))} | more
    _, idx = P.converted(px, {k: [list(c) for c in v] if k == "palette" else v for k, v in s.items()})
    rows = [(0, y, x, *map(int, px[y, x])) for y in range(11) for x in range(13)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    want = {(r.y, r.x): r.idx for r in V.convert(df, V.Settings(**s), 13, 11).collect()}
    assert {(y, x): int(idx[y, x]) for y in range(5) for x in range(6)} == want


def test_sessions_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        px = image(1, 4, 4)
        raw = bytearray(px.astype(np.uint8).tobytes())
        settings = json.dumps({"width": 2, "height": 2, "palette": [[0, 0, 0], [255, 255, 255]]})
        at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
        batches = [
            [(1, 1, at(0), "put", 10, 4, 4, raw, None), (1, 2, at(1), "get", 10, None, None, None, None), (1, 3, at(2), "put", 11, 4, 4, raw, None), (2, 1, at(0), "put", 10, 4, 3, raw, None)],
            [(1, 4, at(3), "release", 11, None, None, None, None), (1, 5, at(4), "get", 11, None, None, None, None), (1, 6, at(5), "convert", 10, None, None, None, settings), (1, 7, at(6), "convert", 10, None, None, None, '{"width": 0, "height": 1}'), (1, 8, at(6), "dance", 10, None, None, None, None)],
            [(3, 1, at(500), "release", 99, None, None, None, None)],
            [(1, 9, at(510), "get", 10, None, None, None, None), (1, 10, at(511), "put", 12, 4, 4, raw, None), (1, 11, at(512), "take", 12, None, None, None, None), (1, 12, at(513), "take", 12, None, None, None, None)],
        ]
        got, source = [], str(tmp_path / "in")
        for k, rows in enumerate(batches):
            spark.createDataFrame([(*r[:5], r[5], r[6], r[7], r[8]) for r in rows], P.MESSAGE).coalesce(1).write.mode("append").parquet(source)
            q = P.preview_replies(spark.readStream.schema(P.MESSAGE).parquet(source), ttl_seconds=60).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
        by = {(r.session, r.seq): r for r in got if r.kind != "expired"}
        assert by[1, 2].kind == "get" and bytes(by[1, 2].data) == bytes(raw)
        assert by[2, 1].kind == "error" and "64 bytes" in by[2, 1].message
        assert by[1, 5].kind == "error" and by[1, 7].kind == "error" and by[1, 8].kind == "error"
        done, idx = P.converted(px, json.loads(settings))
        assert bytes(by[1, 6].data) == done.tobytes() and bytes(by[1, 6].indices) == idx.tobytes() and (by[1, 6].width, by[1, 6].height) == (2, 2)
        assert {(r.session, r.handle) for r in got if r.kind == "expired"} == {(1, 10)}
        assert by[1, 9].kind == "error" and by[1, 11].kind == "take" and by[1, 12].kind == "error"
        assert set(by) == {(1, 2), (2, 1), (1, 5), (1, 6), (1, 7), (1, 8), (1, 9), (1, 11), (1, 12)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
