"""PNG, GIF, bare and project files, with encoders and a decoder that need only zlib; other images by Spark's image source."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def png_bytes(rgba: np.ndarray) -> bytes:
    """height x width x 4 bytes -> a PNG with alpha."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = rgba.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


#: Samples of a pixel by colour type; fixed values of the format, as are the passes of interlacing: first x and y, and steps.
BANDS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Scan lines without their filters; step is the distance in bytes to the pixel on the left.

    Lines that hang on the left or the upper neighbour alone are running sums. If any hangs on
    both, all go together along the diagonals, whose places hang on the two diagonals before.
    """
    h, n = lines.shape
    if kinds.size and kinds.max() > 4:
        raise ValueError(f"no filter {kinds.max()}")
    if not (kinds > 2).any():
        out = lines.copy()
        for y in range(h):
            if kinds[y] == 1:
                padded = np.pad(out[y], (0, -n % step)).reshape(-1, step)
                out[y] = np.add.accumulate(padded, 0, dtype=np.uint8).reshape(-1)[:n]
            elif kinds[y] == 2 and y:
                out[y] += out[y - 1]
        return out
    w = -(-n // step)
    cells = np.pad(lines, ((0, 0), (0, w * step - n))).reshape(h, w, step).astype(np.int16)
    out = np.zeros((h + 1, w + 1, step), np.int16)
    for t in range(w + h - 1):
        y = np.arange(max(0, t - w + 1), min(h - 1, t) + 1)
        x, kind = t - y, kinds[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + up - corner
        of_left, of_up, of_corner = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        nearest = np.where((of_left <= of_up) & (of_left <= of_corner), left, np.where(of_up <= of_corner, up, corner))
        guess = np.where(kind == 4, nearest, np.where(kind == 3, (left + up) >> 1, np.where(kind == 2, up, np.where(kind == 1, left, 0))))
        out[y + 1, x + 1] = (cells[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, w * step)[:, :n].astype(np.uint8)


def _samples(data: bytes, at: int, w: int, h: int, depth: int, bands: int) -> tuple[np.ndarray, int]:
    """h x w x bands samples as they are stored, from scan lines that begin at a place; and where they end."""
    n = -(-w * depth * bands // 8)
    if len(data) < at + h * (n + 1):
        raise ValueError("the pixels end early")
    rows = np.frombuffer(data, np.uint8, h * (n + 1), at).reshape(h, n + 1)
    lines = unfiltered(rows[:, 0], rows[:, 1:], max(1, depth * bands // 8))
    if depth == 16:
        px = lines.reshape(h, w, bands, 2).astype(np.uint16)
        px = (px[..., 0] << 8) | px[..., 1]
    elif depth == 8:
        px = lines.reshape(h, w, bands)
    else:
        bits = np.unpackbits(lines, axis=1)[:, : w * depth].reshape(h, w, depth)
        px = (bits << np.arange(depth - 1, -1, -1)).sum(-1, dtype=np.uint8)[..., None]
    return px, at + h * (n + 1)


def png_pixels(raw: bytes) -> np.ndarray:
    """A PNG of any colour type and depth, interlaced or not -> height x width x 4 bytes; 16 bits are rounded to 8."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, colors, clear, head = 8, [], None, b"", None
    while at + 8 <= len(raw):
        (n,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            colors = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None:
        raise ValueError("no header")
    w, h, depth, color, _, _, lace = head
    if depth not in DEPTHS.get(color, ()) or not w or not h or lace > 1:
        raise ValueError(f"no PNG has {w} x {h} pixels of {depth} bits and colour type {color}")
    stream, bands = zlib.decompress(b"".join(data)), BANDS[color]
    if not lace:
        px, _ = _samples(stream, 0, w, h, depth, bands)
    else:
        px, at = np.zeros((h, w, bands), np.uint16 if depth == 16 else np.uint8), 0
        for x0, y0, dx, dy in PASSES:
            pw, ph = -(-max(0, w - x0) // dx), -(-max(0, h - y0) // dy)
            if pw and ph:  # a pass without pixels has no lines
                px[y0::dy, x0::dx], at = _samples(stream, at, pw, ph, depth, bands)
    full = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        if colors is None or px.max() >= len(colors):
            raise ValueError("a colour is not in the palette")
        full[..., :3] = colors[px[..., 0]]
        table = np.full(256, 255, np.uint8)
        table[: len(clear)] = np.frombuffer(clear, np.uint8)
        full[..., 3] = table[px[..., 0]]
        return full
    eight = px if depth == 8 else ((px.astype(np.uint32) + 128) // 257 if depth == 16 else px.astype(np.uint32) * 255 // ((1 << depth) - 1))
    full[..., :3] = eight[..., :3] if bands >= 3 else eight[..., :1]
    if bands in (2, 4):
        full[..., 3] = eight[..., -1]
    elif clear:
        see_through = np.frombuffer(clear, ">u2")[:bands]
        full[..., 3] = np.where((px == see_through).all(-1), 0, 255)
    return full


def encode_png(px: DataFrame) -> DataFrame:
    """Pixels -> image_id, width, height, png; missing pixels are transparent."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, 4), np.uint8)
        img[pdf["y"], pdf["x"]] = pdf[["r", "g", "b", "a"]]
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "width": [img.shape[1]], "height": [img.shape[0]], "png": [png_bytes(img)]})

    return px.groupBy("image_id").applyInPandas(f, "image_id long, width int, height int, png binary")


def decode_png(files: DataFrame) -> DataFrame:
    """(image_id, png) -> pixels; a file that does not decode gives one row with its error instead."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, raw in zip(b["image_id"], b["png"], strict=True):
                try:
                    img = png_pixels(raw)
                except (ValueError, KeyError, TypeError, zlib.error, struct.error) as e:
                    yield pd.DataFrame({"image_id": [i], "y": [None], "x": [None], "r": [None], "g": [None], "b": [None], "a": [None], "error": [str(e) or type(e).__name__]})
                    continue
                h, w = img.shape[:2]
                flat = img.reshape(-1, 4)
                yield pd.DataFrame({"image_id": i, "y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h), **{c: flat[:, k] for k, c in enumerate("rgba")}, "error": None})

    return files.select("image_id", "png").mapInPandas(f, "image_id long, y int, x int, r int, g int, b int, a int, error string")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """The regular files of a folder (not its subfolders), as path and content, for decode_png(); empty ones, which Spark's reader skips, too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    empty = [(s.getPath().toString(), b"") for s in listed if s.isFile() and not s.getLen() and s.getPath().getName()[0] not in "._"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", F.col("content").alias("png"))
    return files.union(spark.createDataFrame(empty, files.schema)).withColumn("image_id", F.xxhash64("path"))


#: Endings of files that can be decoded.
ENDINGS = ("png", "jpg", "jpeg")


def is_image(path: Column) -> Column:
    """Whether what follows a path's last dot, in any case, is one of the endings."""
    return F.coalesce(F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*ENDINGS), F.lit(False))


def first_images(dropped: DataFrame) -> DataFrame:
    """The first image of each drop of files (drop_id, pos, path): drop_id, path, null where there is none."""
    return dropped.groupBy("drop_id").agg(F.min_by("path", F.when(is_image(F.col("path")), F.col("pos"))).alias("path"))


def _exploded(images: DataFrame) -> DataFrame:
    """(image_id, width, height, rgba, error) -> a row a pixel, or one with the error."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, raw, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat, n = (np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(np.int32), w * h) if error is None else (None, 1)
                at = np.arange(n, dtype=np.int32)
                place = [pa.nulls(1, pa.int32())] * 6 if error is not None else [pa.array(at // w), pa.array(at % w), *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int64)), *place, pa.array([error] * n, pa.string())], ["image_id", "y", "x", *"rgba", "error"])

    return images.select("image_id", "width", "height", "rgba", "error").mapInArrow(f, "image_id long, y int, x int, r int, g int, b int, a int, error string")


def read_photos(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of a folder's JPEG and other images, decoded by Spark's image source on the JVM; a file that does not decode gives its error."""
    files = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, n, raw in zip(*(b.column(c).to_pylist() for c in ("height", "width", "nChannels", "data")), strict=True):
                if n not in (1, 3, 4):
                    out.append((0, 0, None, "the image cannot be decoded"))
                    continue
                flat = np.frombuffer(raw, np.uint8).reshape(-1, n)
                alpha = flat[:, 3:] if n == 4 else np.full((len(flat), 1), 255, np.uint8)
                out.append((w, h, np.hstack([flat[:, 2::-1] if n > 1 else flat.repeat(3, 1), alpha]).tobytes(), None))
            w, h, rgba, error = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(rgba, pa.binary()), pa.array(error, pa.string())], ["image_id", "width", "height", "rgba", "error"])

    path = F.regexp_replace("origin", "^file:/+", "file:/")  # as the other readers write it
    images = files.select(F.xxhash64(path).alias("image_id"), "height", "width", "nChannels", "data").mapInArrow(f, "image_id long, width int, height int, rgba binary, error string")
    return _exploded(images)


def decode_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of a folder's files, told apart by their first bytes: PNG by decode_png(), all others as photos."""
    files = read_images(spark, folder)
    png = F.col("png").startswith(F.lit(b"\x89PNG")) | (F.octet_length("png") == 0)
    return decode_png(files.where(png)).union(read_photos(spark, folder).join(files.where(~png).select("image_id"), "image_id", "left_semi"))


def read_raw(spark: SparkSession, folder: str, sizes: DataFrame) -> DataFrame:
    """Pixels of files of bare RGBA bytes (NAME.rgba); sizes (name, width, height). A file of another length gives its error.

    Files that sizes lacks are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rgba").load(folder)
    named = files.select("path", "length", F.col("content").alias("rgba"), F.regexp_extract("path", r"([^/]*)\.rgba$", 1).alias("name")).join(sizes.select("name", "width", "height"), "name")
    want = F.col("width") * F.col("height") * 4
    error = F.when(F.col("length") != want, F.concat("name", F.lit(".rgba has "), F.col("length").cast("string"), F.lit(" bytes, not "), want.cast("string")))
    return _exploded(named.select(F.xxhash64("name").alias("image_id"), "width", "height", "rgba", error.alias("error")))


def gif_bytes(frames: list[np.ndarray], palette: list[tuple[int, int, int]], delays_ms: list[int], transparent: int = 255) -> bytes:
    """Index images of one size -> a GIF that loops for ever; delays of 10 ms at least; LZW codes of variable width."""
    h, w = frames[0].shape
    table = b"".join(bytes(c) for c in palette[:255]).ljust(768, b"\0")
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), table, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for img, ms in zip(frames, delays_ms, strict=True):
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 0x09, max(1, max(ms, 10) // 10), transparent, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, w, h, 0, 8))
        codes, bits, held, width = {bytes([i]): i for i in range(256)}, 256, 9, 9
        packed = bytearray()

        def put(code: int, width: int) -> None:
            nonlocal bits, held
            bits |= code << held
            held += width
            while held >= 8:
                packed.append(bits & 255)
                bits >>= 8
                held -= 8

        next_code, word = 258, b""
        bits, held = 0, 0
        put(256, width)
        for v in img.astype(np.uint8).ravel().tolist():
            longer = word + bytes([v])
            if longer in codes:
                word = longer
                continue
            put(codes[word], width)
            if next_code < 4096:
                codes[longer] = next_code
                next_code += 1
                if next_code - 1 == 1 << width and width < 12:
                    width += 1
            else:
                put(256, width)
                codes, next_code, width = {bytes([i]): i for i in range(256)}, 258, 9
            word = bytes([v])
        if word:
            put(codes[word], width)
        put(257, width)
        if held:
            packed.append(bits & 255)
        out += [bytes([len(packed[i : i + 255])]) + bytes(packed[i : i + 255]) for i in range(0, len(packed), 255)] + [b"\0"]
    return b"".join([*out, b"\x3b"])


def _unpacked(data: bytes, bits: int) -> bytes:
    """LZW codes of growing width -> indices; a code that cannot be is an error."""
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out, held, count, width, last = bytearray(), 0, 0, bits + 1, b""
    for byte in data:
        held |= byte << count
        count += 8
        while count >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            count -= width
            if code == end:
                return bytes(out)
            if code == clear or not table:
                table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
                if code == clear:
                    continue
            if code < len(table):
                word = table[code]
            elif code == len(table) and last:
                word = last + last[:1]
            else:
                raise ValueError(f"code {code} is not known yet")
            if last and len(table) < 4096:
                table.append(last + word[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            out += word
            last = word
    return bytes(out)


def gif_frames(raw: bytes) -> list[tuple[np.ndarray, int, bytes]]:
    """A GIF's frames: indices, milliseconds, and the colours (three bytes each) they mean; frames of the whole canvas that are not interlaced."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    flags, at = raw[10], 13
    shared = b""
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared, at = raw[at : at + n], at + n
    frames, ms = [], 0

    def blocks() -> bytes:
        nonlocal at
        out = bytearray()
        while raw[at]:
            out += raw[at + 1 : at + 1 + raw[at]]
            at += 1 + raw[at]
        at += 1
        return bytes(out)

    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            label, at = raw[at + 1], at + 2
            own = blocks()
            if label == 0xF9:
                ms = int.from_bytes(own[1:3], "little") * 10
        elif raw[at] == 0x2C:
            w, h, own = *struct.unpack_from("<HH", raw, at + 5), raw[at + 9]
            if own & 0x40:
                raise ValueError("interlaced frames are not read")
            at += 10
            palette = shared
            if own & 0x80:
                n = 3 << (own & 7) + 1
                palette, at = raw[at : at + n], at + n
            bits, at = raw[at], at + 1
            pixels = _unpacked(blocks(), bits)
            if len(pixels) < w * h:
                raise ValueError("a frame ends early")
            frames.append((np.frombuffer(pixels[: w * h], np.uint8).reshape(h, w), ms, palette))
        else:
            raise ValueError(f"no block begins with {raw[at]}")
    return frames


def encode_gifs(frames: DataFrame) -> DataFrame:
    """(sprite_id, frame, ms, y, x, idx) -> sprite_id, gif; a sprite's frames have one size, and what a frame lacks has index 0. Colour i is gray i."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        shape, images, delays = (pdf["y"].max() + 1, pdf["x"].max() + 1), [], []
        for _, own in pdf.groupby("frame"):
            img = np.zeros(shape, np.uint8)
            img[own["y"], own["x"]] = own["idx"]
            images.append(img), delays.append(int(own["ms"].iloc[0]))
        return pd.DataFrame({"sprite_id": [pdf["sprite_id"].iloc[0]], "gif": [gif_bytes(images, [(i, i, i) for i in range(255)], delays)]})

    return frames.groupBy("sprite_id").applyInPandas(f, "sprite_id long, gif binary")


def decode_gifs(files: DataFrame) -> DataFrame:
    """(sprite_id, gif) -> sprite_id, frame, ms, width, height, indices row by row."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, raw in zip(b["sprite_id"], b["gif"], strict=True):
                for k, (img, ms, _) in enumerate(gif_frames(bytes(raw))):
                    yield pd.DataFrame({"sprite_id": [s], "frame": [k], "ms": [ms], "width": [img.shape[1]], "height": [img.shape[0]], "indices": [img.ravel().astype(np.int32)]})

    return files.select("sprite_id", "gif").mapInPandas(f, "sprite_id long, frame int, ms int, width int, height int, indices array<int>")


FORMAT_VERSION = 1


def save_project(tables: dict[str, DataFrame], folder: str) -> None:
    """A project is a folder of Parquet tables and a manifest; tables of the folder that are not given stay as they are."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest = json.dumps({"formatVersion": FORMAT_VERSION, "tables": sorted(tables)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load_project(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Tables and warnings: a table that the manifest names but the folder lacks is a warning; a newer format is an error."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    if manifest["formatVersion"] > FORMAT_VERSION:
        raise ValueError(f"format {manifest['formatVersion']} is newer than {FORMAT_VERSION}")
    found, warnings = {}, []
    for name in manifest["tables"]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found[name] = spark.read.parquet(f"{folder}/{name}")
        else:
            warnings.append(f"{name} is missing")
    return found, warnings
