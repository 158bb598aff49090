"""Layered animation files (.ase) as records: one relation for all kinds of parts, read file by file on the executors.

Rows are (image_id, kind, n, layer, frame, parent, name, x, y, width, height, value, data):

| kind | n | other columns |
|---|---|---|
| file | 0 | width, height; value: bits a pixel |
| frame | frame | value: milliseconds |
| layer | layer | parent; name; x: kind (0 pixels, 1 group, 2 tiles); y: blend mode; width: opacity; height: tile set; value: flags (1 visible, 2 editable) |
| cel | count | layer, frame; x, y, width, height; value: opacity; data: straight RGBA, or packed tile ids as little-endian integers |
| link | count | layer, frame; value: the frame whose cel it shows |
| tag | count | x, y: first and last frame; value: direction (0 forward, 1 reverse, 2 and 3 back and forth); name |
| color | index | value: r, g, b, a from the highest byte |
| tile | index | parent: tile set; width, height; data: RGBA |
| warning, error | count | name: what is wrong |

A file that cannot be read gives one error row; the other files are not affected. A tile
that its set's data lacks is blank; a layer of tiles whose set is missing is left out with
its cels, with a warning.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("kind", "n", "layer", "frame", "parent", "name", "x", "y", "width", "height", "value", "data")
SCHEMA = "image_id long, kind string, n int, layer int, frame int, parent int, name string, x int, y int, width int, height int, value long, data binary"
# Fixed values of the format.
MAGIC, FRAME_MAGIC = 0xA5E0, 0xF1FA
LAYER, CEL, TAGS, PALETTE, OLD_PALETTE, TILESET = 0x2004, 0x2005, 0x2018, 0x2019, 0x0004, 0x2023
GROUP, TILES = 1, 2


class _Bytes:
    """A reader of little-endian values."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.raw, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def text(self) -> str:
        (n,) = self.take("H")
        self.at += n
        return self.raw[self.at - n : self.at].decode("utf-8", "replace")

    def rest(self) -> bytes:
        return self.raw[self.at :]


def to_rgba(data: bytes, depth: int, palette: dict[int, tuple[int, int, int, int]], clear: int) -> bytes:
    """Pixels of 32, 16 (gray, alpha) or 8 bits (index; the clear one and those without a colour are transparent)."""
    if depth == 32:
        return data
    if depth == 16:
        v = np.frombuffer(data, np.uint8).reshape(-1, 2)
        return v[:, [0, 0, 0, 1]].tobytes()
    table = np.zeros((256, 4), np.uint8)
    for i, c in palette.items():
        if i < 256 and i != clear:
            table[i] = c
    return table[np.frombuffer(data, np.uint8)].tobytes()


def packed_tiles(data: bytes, masks: tuple[int, int, int, int]) -> bytes:
    """Tile numbers, whose bits the masks tell (index, across, down, diagonal) -> our packed ids."""
    raw = np.frombuffer(data, "<u4").astype(np.int64)
    out = raw & masks[0]
    for bit, m in zip((28, 29, 30), masks[1:], strict=True):
        out |= ((raw & m) != 0).astype(np.int64) << bit
    return out.astype("<u4").tobytes()


def records(raw: bytes) -> list[dict]:
    """All records of one file; ValueError, struct.error or zlib.error if it cannot be read."""
    head = _Bytes(raw)
    _, magic, n_frames, width, height, depth = head.take("IHHHHH")
    if magic != MAGIC or depth not in (8, 16, 32):
        raise ValueError("not a layered animation file")
    clear = raw[28] if depth == 8 else -1
    out, palette, old, layers, levels, sets, cels = [{"kind": "file", "n": 0, "width": width, "height": height, "value": depth}], {}, {}, [], {}, {}, []
    at = 128
    for frame in range(n_frames):
        size, magic, few, ms, _, many = _Bytes(raw, at).take("IHHHHI")
        if magic != FRAME_MAGIC:
            raise ValueError(f"frame {frame} is damaged")
        out.append({"kind": "frame", "n": frame, "value": ms})
        chunk = at + 16
        for _ in range(many or few):
            length, kind = _Bytes(raw, chunk).take("IH")
            if length < 6 or chunk + length > len(raw):
                raise ValueError(f"frame {frame} ends early")
            b = _Bytes(raw[chunk + 6 : chunk + length])
            if kind == LAYER:
                flags, sort, level, _, _, blend, opacity = b.take("HHHHHHB3x")
                name = b.text()
                levels[level] = len(layers)
                layers.append({"kind": "layer", "n": len(layers), "parent": levels.get(level - 1) if level else None, "name": name, "x": sort, "y": blend, "width": opacity, "value": flags, "height": b.take("I")[0] if sort == TILES else None})
            elif kind == CEL:
                cels.append((frame, b))
            elif kind == PALETTE:
                _, first, last = b.take("III8x")
                for i in range(first, last + 1):
                    named, *color = b.take("HBBBB")
                    palette[i] = tuple(color)
                    if named & 1:
                        b.text()
            elif kind == OLD_PALETTE:
                i = 0
                for _ in range(b.take("H")[0]):
                    skip, n = b.take("BB")
                    i += skip
                    for _ in range(n or 256):
                        old[i] = (*b.take("BBB"), 255)
                        i += 1
            elif kind == TAGS:
                for k in range(b.take("H8x")[0]):
                    first, last, way = b.take("HHB12x")
                    out.append({"kind": "tag", "n": k, "x": first, "y": last, "value": way, "name": b.text()})
            elif kind == TILESET:
                number, flags, n, tw, th = b.take("IIIHH16x")
                b.text()
                if flags & 1:
                    b.take("II")
                sets[number] = (n, tw, th, zlib.decompress(b.raw[b.at + 4 : b.at + 4 + b.take("I")[0]]) if flags & 2 else b"")
            chunk += length
        at += size
    palette = palette or old
    out += [{"kind": "color", "n": i, "value": int.from_bytes(bytes(c), "big")} for i, c in sorted(palette.items())]
    gone = {x["n"] for x in layers if x["x"] == TILES and x["height"] not in sets}
    out += [x for x in layers if x["n"] not in gone]
    out += [{"kind": "warning", "n": i, "name": f"layer {layers[i]['name']!r} is left out: its tile set is missing"} for i in sorted(gone)]
    for number, (n, tw, th, data) in sorted(sets.items()):
        step = tw * th * depth // 8
        for i in range(n):
            part = data[i * step : (i + 1) * step]
            out.append({"kind": "tile", "n": i, "parent": number, "width": tw, "height": th, "data": to_rgba(part, depth, palette, clear) if len(part) == step else bytes(tw * th * 4)})
    for k, (frame, b) in enumerate(cels):
        layer, x, y, opacity, sort = b.take("HhhBH7x")
        if layer in gone or layer >= len(layers):
            continue
        row = {"n": k, "layer": layer, "frame": frame, "x": x, "y": y, "value": opacity}
        if sort == 1:
            out.append({"kind": "link", "n": k, "layer": layer, "frame": frame, "value": b.take("H")[0]})
            continue
        w, h = b.take("HH")
        if sort == 3:
            bits, *masks = b.take("HIIII10x")
            if bits != 32:
                raise ValueError(f"tiles of {bits} bits")
            out.append(row | {"kind": "cel", "width": w, "height": h, "data": packed_tiles(zlib.decompress(b.rest()), tuple(masks))})
            continue
        data = zlib.decompress(b.rest()) if sort == 2 else b.rest()
        if len(data) < w * h * depth // 8:
            raise ValueError(f"cel {k} ends early")
        out.append(row | {"kind": "cel", "width": w, "height": h, "data": to_rgba(data[: w * h * depth // 8], depth, palette, clear)})
    return out


def read_records(raw: bytes) -> list[dict]:
    """A file's records, or one that says why it cannot be read."""
    try:
        return records(raw)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error) as e:
        return [{"kind": "error", "n": 0, "name": str(e) or type(e).__name__}]


def decode_layered(files: DataFrame) -> DataFrame:
    """(image_id, content) -> records."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, raw in zip(b["image_id"], b["content"], strict=True):
                rows = read_records(bytes(raw or b""))
                yield pd.DataFrame([[i, *(r.get(c) for c in COLUMNS)] for r in rows], columns=["image_id", *COLUMNS], dtype=object)

    return files.select("image_id", "content").mapInPandas(f, SCHEMA)


#: The file's numbers of blend modes, from 0, that have a counterpart, and of tag directions.
BLENDS = (
    "normal", "multiply", "screen", "overlay", "darken", "lighten", "color-dodge", "color-burn",
    "hard-light", "soft-light", "difference", "exclusion", "hue", "saturation", "color", "luminosity",
)
WAYS = ("forward", "reverse", "pingpong")


def _named(number: Column, names: tuple[str, ...], fallback: str, what: str, of: Column) -> tuple[Column, Column]:
    known = F.get(F.array(*map(F.lit, names)), number.cast("int"))
    warning = F.concat(F.lit(f"{what} '"), F.coalesce(of, F.lit("")), F.lit("': number "), F.coalesce(number.cast("string"), F.lit("null")), F.lit(f" is not known here; taken for {fallback}"))
    return F.coalesce(known, F.lit(fallback)), F.when(known.isNull(), warning)


def blend_mode(number: Column, layer: Column) -> tuple[Column, Column]:
    """A layer's blend mode, and a warning (else null) where the number has none: it is normal then."""
    return _named(number, BLENDS, "normal", "layer", layer)


def tag_direction(number: Column, tag: Column) -> tuple[Column, Column]:
    """A tag's direction, and a warning (else null) where the number has none: it is pingpong then."""
    return _named(number, WAYS, "pingpong", "tag", tag)
