"""Data sources for Spark's readers and writers: layered animation files (read), GIF (read and write), PNG (write).

    formats.register(spark)
    spark.read.format("layered").load(folder)
    spark.read.format("gif").load(folder)
    frames.repartition("name").sortWithinPartitions("name", "frame").write.format("gif").mode("append").save(folder)

A file is a partition when it is read. Writing tasks put their files into a folder of the
write's own below the target; the commit on the driver moves them to their places, and an
abort, or a failed commit, deletes that folder, so a failed task or a lost executor leaves
no file. The folder is one that driver and executors share as a mounted path.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from rasterloom.sources.images import gif_bytes, gif_frames, png_bytes
from rasterloom.sources.layered import COLUMNS, read_records

GIF = "name string, frame int, ms int, width int, height int, indices binary, palette binary"
PNG = "name string, width int, height int, rgba binary"
LAYERED = "name string, kind string, n int, layer int, frame int, parent int, label string, x int, y int, width int, height int, value long, data binary"
SCALES = (1, 2, 4, 8)
PENDING = "_pending-"


def _folder(options: dict) -> str:
    path = options.get("path")
    if not path:
        raise ValueError("a path is needed")
    path = path.removeprefix("file://")
    if "://" in path:
        raise ValueError(f"{path} is not a mounted folder")
    return path


@dataclass
class OneFile(InputPartition):
    path: str


class _Files(DataSourceReader):
    """A partition for each file of a folder with the ending, or for the one file that the path names."""

    def __init__(self, options: dict, ending: str):
        self.path, self.ending = _folder(options), ending

    def partitions(self) -> Sequence[OneFile]:
        if os.path.isfile(self.path):
            return [OneFile(self.path)]
        return [OneFile(p) for p in sorted(glob.glob(os.path.join(glob.escape(self.path), f"*{self.ending}"))) if os.path.isfile(p)]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if not isinstance(partition, OneFile):  # a folder without such files
            return
        with open(partition.path, "rb") as f:
            raw = f.read()
        yield from self.rows(os.path.basename(partition.path).removesuffix(self.ending), raw)

    def rows(self, name: str, raw: bytes) -> Iterator[tuple]:
        raise NotImplementedError


class LayeredReader(_Files):
    def rows(self, name: str, raw: bytes) -> Iterator[tuple]:
        for r in read_records(raw):
            yield (name, *(r.get(c) for c in COLUMNS))


class GifReader(_Files):
    def rows(self, name: str, raw: bytes) -> Iterator[tuple]:
        for k, (img, ms, palette) in enumerate(gif_frames(raw)):
            yield (name, k, ms, img.shape[1], img.shape[0], img.tobytes(), palette)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file lies, and its name


class _FileWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool, ending: str):
        self.folder, self.overwrite, self.ending, self.options = _folder(options), overwrite, ending, dict(options)
        self.pending = os.path.join(self.folder, f"{PENDING}{uuid.uuid4().hex}")
        os.makedirs(self.pending)

    def encoded(self, rows: Iterator[Row]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Written:
        own, files = os.path.join(self.pending, uuid.uuid4().hex), []
        os.mkdir(own)  # fails once the write was given up and its folder is gone
        for name, raw in self.encoded(iterator):
            if not name or os.path.basename(name) != name or name.startswith((".", "_")):
                raise ValueError(f"{name!r} cannot be the name of a file")
            at = os.path.join(own, f"{len(files)}{self.ending}")
            with open(at, "wb") as f:
                f.write(raw)
            files.append((at, name + self.ending))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        try:
            files = [f for m in messages if m is not None for f in m.files]
            names = [n for _, n in files]
            if len(set(names)) < len(names):
                raise ValueError(f"{next(n for n in names if names.count(n) > 1)} was written by two tasks; repartition by name first")
            old = set(glob.glob(os.path.join(glob.escape(self.folder), f"*{self.ending}"))) if self.overwrite else set()
            for at, name in files:
                os.replace(at, os.path.join(self.folder, name))
            for p in old - {os.path.join(self.folder, n) for n in names}:
                os.remove(p)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        gone = f"{self.pending}-gone"
        if os.path.isdir(self.pending):
            os.rename(self.pending, gone)  # tasks that still run find no folder to write into
            shutil.rmtree(gone, ignore_errors=True)


class GifWriter(_FileWriter):
    """A file for each run of rows of a name, whose frames come in order."""

    def encoded(self, rows: Iterator[Row]) -> Iterator[tuple[str, bytes]]:
        scale = int(self.options.get("scale", 1))
        if scale not in SCALES:
            raise ValueError(f"no scale {scale}")
        for name, own in groupby(rows, key=lambda r: r["name"]):
            frames, delays, palette, last = [], [], None, -1
            for r in own:
                if r["frame"] <= last:
                    raise ValueError(f"frames of {name} are not in order")
                img = np.frombuffer(bytes(r["indices"]), np.uint8).reshape(r["height"], r["width"])
                frames.append(img.repeat(scale, 0).repeat(scale, 1)), delays.append(r["ms"])
                palette, last = palette or bytes(r["palette"]), r["frame"]
            yield name, gif_bytes(frames, [tuple(palette[i : i + 3]) for i in range(0, len(palette), 3)], delays)


class PngWriter(_FileWriter):
    def encoded(self, rows: Iterator[Row]) -> Iterator[tuple[str, bytes]]:
        for r in rows:
            yield r["name"], png_bytes(np.frombuffer(bytes(r["rgba"]), np.uint8).reshape(r["height"], r["width"], 4))


class LayeredSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layered"

    def schema(self) -> str:
        return LAYERED

    def reader(self, schema: StructType) -> LayeredReader:
        return LayeredReader(self.options, self.options.get("ending", ".ase"))


class GifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gif"

    def schema(self) -> str:
        return GIF

    def reader(self, schema: StructType) -> GifReader:
        return GifReader(self.options, ".gif")

    def writer(self, schema: StructType, overwrite: bool) -> GifWriter:
        return GifWriter(self.options, overwrite, ".gif")


class PngSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return PNG

    def writer(self, schema: StructType, overwrite: bool) -> PngWriter:
        return PngWriter(self.options, overwrite, ".png")


def register(spark: SparkSession) -> None:
    for source in (LayeredSource, GifSource, PngSource):
        spark.dataSource.register(source)
