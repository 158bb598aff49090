"""Data sources: round trips, partitions a file, and writes that leave nothing behind when they fail."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import formats
from rasterloom.sources.images import gif_bytes, gif_frames, png_pixels


@pytest.fixture(scope="module")
def sources(spark):
    formats.register(spark)
    return spark


def frames(spark, names, n=3, w=17, h=9):
    r = np.random.default_rng(len(names))
    palette = bytearray(r.integers(0, 256, 30).astype(np.uint8).tobytes())
    return [(name, k, 40 * k, w, h, bytearray(r.integers(0, 10, w * h).astype(np.uint8).tobytes()), palette) for name in names for k in range(n)]


def save(df, folder, **options):
    df.repartition(3, "name").sortWithinPartitions("name", "frame").write.format("gif").mode("append").options(**options).save(str(folder))


def test_lzw_of_every_length_and_table():
    r = np.random.default_rng(1)
    for img in [np.zeros((1, 1), np.uint8), r.integers(0, 256, (120, 130)).astype(np.uint8), np.zeros((300, 300), np.uint8), np.tile(np.arange(256, dtype=np.uint8), (40, 2))]:
        (got, ms, palette), = gif_frames(gif_bytes([img], [(1, 2, 3)], [77]))
        assert (got == img).all() and ms == 70 and palette[:3] == b"\1\2\3"
    with pytest.raises(ValueError):
        gif_frames(b"no")


def test_gif_round_trip(sources, tmp_path):
    rows = frames(sources, ["a", "b", "c d"])
    df = sources.createDataFrame(rows, formats.GIF)
    save(df, tmp_path)
    assert sorted(os.listdir(tmp_path)) == ["a.gif", "b.gif", "c d.gif"]
    back = sources.read.format("gif").load(str(tmp_path))
    assert back.rdd.getNumPartitions() == 3
    got = {(r.name, r.frame): r for r in back.collect()}
    for name, k, ms, w, h, idx, palette in rows:
        g = got[name, k]
        assert (g.ms, g.width, g.height) == (max(ms, 10), w, h) and bytes(g.indices) == bytes(idx) and bytes(g.palette)[:30] == bytes(palette)
    assert len(got) == len(rows)
    save(df.where("name = 'a'"), tmp_path, scale="2")
    a = sources.read.format("gif").load(str(tmp_path / "a.gif")).orderBy("frame").first()
    assert (a.width, a.height) == (34, 18) and (np.frombuffer(bytes(a.indices), np.uint8).reshape(18, 34)[::2, ::2].tobytes()) == bytes(rows[0][5])
    df.where("name = 'b'").coalesce(1).sortWithinPartitions("frame").write.format("gif").mode("overwrite").save(str(tmp_path))
    assert os.listdir(tmp_path) == ["b.gif"]
    assert sources.read.format("gif").load(str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("fault", ["task", "twice", "order", "name", "scale"])
def test_a_failed_write_leaves_no_file(sources, tmp_path, fault):
    rows = frames(sources, ["a", "b", "c", "d"])
    df = sources.createDataFrame(rows, formats.GIF).repartition(4, "name").sortWithinPartitions("name", "frame")
    options = {}
    if fault == "task":
        df = df.withColumn("frame", F.when((F.col("name") == "d") & (F.col("frame") == 2), F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("frame")))
    elif fault == "twice":
        df = df.repartition(6, "frame")
    elif fault == "order":
        df = df.sortWithinPartitions("name", F.desc("frame"))
    elif fault == "name":
        df = df.withColumn("name", F.concat(F.lit("../"), "name"))
    else:
        options = {"scale": "3"}
    with pytest.raises(Exception):
        df.write.format("gif").mode("append").options(**options).save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_png_files(sources, tmp_path):
    r = np.random.default_rng(2)
    images = {f"i{k}": r.integers(0, 256, (5, 4 + k, 4)).astype(np.uint8) for k in range(3)}
    sources.createDataFrame([(n, v.shape[1], v.shape[0], bytearray(v.tobytes())) for n, v in images.items()], formats.PNG).write.format("png").mode("append").save(str(tmp_path))
    for n, v in images.items():
        assert (png_pixels((tmp_path / f"{n}.png").read_bytes()) == v).all()
    with pytest.raises(Exception):
        sources.createDataFrame([("x", 2, 2, bytearray(3))], formats.PNG).write.format("png").mode("append").save("s3://bucket/x")


def test_layered_files_one_partition_each(sources, tmp_path):
    frame = struct.pack("<IHHHBBI", 16, 0xF1FA, 0, 100, 0, 0, 0)
    head = struct.pack("<IHHHHHIH", 128 + len(frame), 0xA5E0, 1, 3, 2, 32, 1, 100).ljust(128, b"\0")
    (tmp_path / "good.ase").write_bytes(head + frame)
    (tmp_path / "bad.ase").write_bytes(b"oops")
    (tmp_path / "other.txt").write_bytes(b"")
    df = sources.read.format("layered").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    got = {(r.name, r.kind): r for r in df.collect()}
    assert (got["good", "file"].width, got["good", "file"].height, got["good", "frame"].value) == (3, 2, 100) and ("bad", "error") in got and len(got) == 3
