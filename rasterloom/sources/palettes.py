"""Palettes: built-in colours, and files in five text and binary formats as rows (pos, r, g, b, a)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The colours of the built-in palettes, in order, repeats included.
BUILTIN = {
    "gameboy": "0f380f 306230 8bac0f 9bbc0f",
    "nes": (
        "7c7c7c 0000fc 0000bc 4428bc 940084 a80020 a81000 881400 503000 007800 006800 005800 004058 000000 000000 000000 "
        "bcbcbc 0078f8 0058f8 6844fc d800cc e40058 f83800 e45c10 ac7c00 00b800 00a800 00a844 008888 000000 000000 000000 "
        "f8f8f8 3cbcfc 6888fc 9878f8 f878f8 f85898 f87858 fca044 f8b800 b8f818 58d854 58f898 00e8d8 787878 000000 000000 "
        "fcfcfc a4e4fc b8b8f8 d8b8f8 f8b8f8 f8a4c0 f0d0b0 fce0a8 f8d878 d8f878 b8f8b8 b8f8d8 00fcfc f8d8f8 000000 000000"
    ),
    "cga": "000000 0000aa 00aa00 00aaaa aa0000 aa00aa aa5500 aaaaaa 555555 5555ff 55ff55 55ffff ff5555 ff55ff ffff55 ffffff",
    "c64": "000000 ffffff 880000 aaffee cc44cc 00cc55 0000aa eeee77 dd8855 664400 ff7777 333333 777777 aaff66 0088ff bbbbbb",
    "zx-spectrum": "000000 0000d7 d70000 d700d7 00d700 00d7d7 d7d700 d7d7d7 000000 0000ff ff0000 ff00ff 00ff00 00ffff ffff00 ffffff",
}
GRAY_STEPS = (4, 8, 16)


def colors(name: str) -> list[tuple[int, int, int]]:
    """The distinct colours of a built-in palette in order of first occurrence."""
    if name.startswith("grayscale-"):
        n = int(name.split("-")[1])
        return [(v, v, v) for v in (int(i * 255 / (n - 1) + 0.5) for i in range(n))]
    return [tuple(bytes.fromhex(h)) for h in dict.fromkeys(BUILTIN[name].split())]


def builtin_palettes(spark: SparkSession) -> DataFrame:
    """palette_id, i, r, g, b of all built-in palettes; repeats within a palette removed, the first kept."""
    names = [*BUILTIN, *(f"grayscale-{n}" for n in GRAY_STEPS)]
    return spark.createDataFrame([(n, i, *c) for n in names for i, c in enumerate(colors(n))], "palette_id string, i int, r int, g int, b int")


def _hex(s: Column, at: int) -> Column:
    return F.conv(F.substring(s, at, 2), 16, 10).cast("int")


def _lines(files: DataFrame) -> DataFrame:
    """name, pos, line: without a byte-order mark, line ends of any kind, trimmed, empty lines dropped."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n", "\n"), "\r", "\n")
    rows = files.select("name", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", "\\s+", " "))).where("line <> ''")


def parse_palettes(files: DataFrame) -> DataFrame:
    """(name, content) of text palette files -> name, format, pos, r, g, b, a.

    The header decides first (GIMP, JASC), then the extension (.txt has alpha first);
    all else is read as hex lines with alpha last. Lines that do not parse are dropped.
    """
    head = F.when(F.col("content").rlike("^﻿?GIMP Palette"), "gpl").when(F.col("content").rlike("^﻿?JASC-PAL"), "jasc").when(F.lower("name").endswith(".txt"), "paintnet").otherwise("hex")
    rows = _lines(files).join(files.select("name", head.alias("format")), "name")
    byte = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.regexp_extract("line", r"^(-?\d+) (-?\d+) (-?\d+)", k).cast("int")))
    triple = F.col("line").rlike(r"^-?\d+ -?\d+ -?\d+")
    rgb = rows.where(F.col("format").isin("gpl", "jasc") & triple).select("name", "format", "pos", byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"), F.lit(255).alias("a"))
    token = F.regexp_extract("line", r"^#?([0-9A-Fa-f]+)\b", 1)
    hexes = rows.where(F.col("format").isin("hex", "paintnet") & ~F.col("line").rlike(r"^(;|//)")).withColumn("h", token)
    last = hexes.where("format = 'hex' AND length(h) IN (6, 8)").select("name", "format", "pos", _hex(F.col("h"), 1).alias("r"), _hex(F.col("h"), 3).alias("g"), _hex(F.col("h"), 5).alias("b"), F.when(F.length("h") == 8, _hex(F.col("h"), 7)).otherwise(255).alias("a"))
    first = hexes.where("format = 'paintnet' AND length(h) = 8").select("name", "format", "pos", _hex(F.col("h"), 3).alias("r"), _hex(F.col("h"), 5).alias("g"), _hex(F.col("h"), 7).alias("b"), _hex(F.col("h"), 1).alias("a"))
    return rgb.unionByName(last).unionByName(first)


def parse_riff(files: DataFrame) -> DataFrame:
    """(name, content BINARY) of RIFF palettes -> name, pos, r, g, b, a: a count at byte 22, four bytes each from 24."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, raw in zip(b["name"], b["content"], strict=True):
                if raw is not None and raw[:4] == b"RIFF" and raw[8:12] == b"PAL " and len(raw) >= 24:
                    n = min(int.from_bytes(raw[22:24], "little"), (len(raw) - 24) // 4)
                    rows += [(name, i, *raw[24 + 4 * i : 27 + 4 * i], 255) for i in range(n)]
            yield pd.DataFrame(rows, columns=["name", "pos", "r", "g", "b", "a"])

    return files.select("name", "content").mapInPandas(f, "name string, pos int, r int, g int, b int, a int")


def registered_ids(ids: Column) -> Column:
    """The ids under which palettes are kept, of those they were added with, in order: a taken id gets the first free number from 2 behind it."""

    def kept(done: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda k: F.when(k == 1, name).otherwise(F.concat(name, F.lit("-"), k.cast("string"))))
        return F.array_append(done, F.get(F.array_except(tries, done), F.lit(0)))

    return F.aggregate(ids, F.array().cast("array<string>"), kept)


def custom_colors(colors: Column) -> Column:
    """A list of added colours without those it has already."""
    return F.array_distinct(colors)


def without_color(colors: Column, at: Column) -> Column:
    """A list of colours without the one at a place, from 0; all of them if there is none."""
    return F.filter(colors, lambda _, i: i != at)
