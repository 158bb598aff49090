"""Project archives (zip files with a manifest, a document and its pixels) as relations, read and written on the executors.

Tables: entry(archive_id, name, data, error), a row a file of an archive, or one with the error of a
file that is no archive; document(archive_id, format, sprite, error), a row an archive;
content(archive_id, kind, owner, id, name, raw, width, height, data, warning), a row a cel that
is not linked, or a tile. An archive is read and written in one piece, as zip files must be.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.images import png_bytes, png_pixels

#: The newest format, and the names of entries.
FORMAT = 1
MANIFEST, SPRITE, THUMBNAIL, CELS, TILES = "manifest.json", "sprite.json", "thumbnail.png", "cels/", "tiles/"
#: Colour modes that can be opened.
COLOR_MODES = ("rgba", "indexed")

_COLOR = "array<int>"
_EFFECT = f"struct<kind:string,id:string,enabled:boolean,color:{_COLOR},thickness:int,corners:boolean,dx:int,dy:int,palette:array<{_COLOR}>,h:double,s:double,v:double>"
_GRID = "struct<shape:string,tileWidth:int,tileHeight:int,offsetX:int,offsetY:int>"
_LAYER = (
    f"struct<kind:string,id:string,name:string,visible:boolean,locked:boolean,opacity:double,blendMode:string,parentId:string,clippingMask:boolean,effects:array<{_EFFECT}>,"
    f"collapsed:boolean,tilesetId:string,grid:{_GRID},source:struct<sourceId:long,settings:variant>>"
)
_CEL = "struct<id:string,layerId:string,frameId:string,x:int,y:int,width:int,height:int,linkedTo:string>"
_TAG = "struct<id:string,name:string,`from`:int,`to`:int,direction:string,repeat:int,color:string>"
_TILESET = "struct<id:string,name:string,tileWidth:int,tileHeight:int,tiles:array<struct<id:string>>>"
_PALETTE = f"struct<id:string,name:string,colors:array<{_COLOR}>>"
DOCUMENT = (
    f"width int, height int, colorMode string, layers array<{_LAYER}>, frames array<struct<id:string,durationMs:int>>, cels array<{_CEL}>, "
    f"tags array<{_TAG}>, tilesets array<{_TILESET}>, palette {_PALETTE}"
)
CONTENT = "archive_id long, kind string, owner string, id string, name string, raw boolean, width int, height int, data binary, warning string"


def entries(files: DataFrame) -> DataFrame:
    """(archive_id, content) -> the files of each archive, without folders."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in zip(b.column("archive_id").to_pylist(), b.column("content"), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_py() or b"")) as z:
                        rows = [(i, e.filename, z.read(e), None) for e in z.infolist() if not e.is_dir()]
                except (zipfile.BadZipFile, zlib.error, struct.error, NotImplementedError, RuntimeError, OSError) as e:
                    rows = [(i, None, None, f"not an archive: {e}")]
                rows = rows or [(i, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)], ["archive_id", "name", "data", "error"])

    return files.select("archive_id", "content").mapInArrow(f, "archive_id long, name string, data binary, error string")


def documents(entry: DataFrame) -> DataFrame:
    """Each archive's document, or why it cannot be opened."""
    text = lambda name: F.max(F.when(F.col("name") == name, F.decode("data", "UTF-8")))
    read = entry.where(F.col("name").isin(MANIFEST, SPRITE) | F.col("name").isNull() | F.col("error").isNotNull())
    every = entry.select("archive_id").distinct()
    both = every.join(read.groupBy("archive_id").agg(text(MANIFEST).alias("m"), text(SPRITE).alias("s"), F.max("error").alias("e")), "archive_id", "left")
    both = both.withColumns({"manifest": F.from_json("m", "formatVersion int, appVersion string, width int, height int, layerCount int, frameCount int"), "sprite": F.from_json("s", DOCUMENT)})
    version, mode = F.col("manifest.formatVersion"), F.coalesce("sprite.colorMode", F.lit("rgba"))
    error = (
        F.when(F.col("e").isNotNull(), F.col("e")).when(F.col("m").isNull(), f"archive has no {MANIFEST}").when(version.isNull(), f"{MANIFEST} cannot be read")
        .when(version > FORMAT, F.concat(F.lit("written by a newer version: format "), version.cast("string"), F.lit(f" > {FORMAT}"))).when(F.col("s").isNull(), f"archive has no {SPRITE}")
        .when(F.col("sprite.width").isNull() | F.col("sprite.height").isNull(), f"{SPRITE} cannot be read").when(~mode.isin(*COLOR_MODES), F.concat(F.lit("unsupported color mode "), mode))
    )
    return both.select("archive_id", version.alias("format"), F.when(error.isNull(), F.col("sprite")).alias("sprite"), error.alias("error"))


def parts(document: DataFrame, of: str) -> DataFrame:
    """The document's layers, frames, cels, tags or tilesets: archive_id, pos (from 0), and their fields."""
    return document.select("archive_id", F.posexplode(f"sprite.{of}").alias("pos", "part")).select("archive_id", "pos", "part.*")


def cel_entry(cel: Column, raw: Column) -> Column:
    return F.concat(F.lit(CELS), cel, F.when(raw, ".bin").otherwise(".png"))


def tile_entry(tileset: Column, tile: Column) -> Column:
    return F.concat(F.lit(TILES), tileset, F.lit("/"), tile, F.lit(".png"))


def expected(document: DataFrame) -> DataFrame:
    """The contents a document names, without their data: cels of tile layers and of indexed pixel layers are raw."""
    kinds = parts(document, "layers").select("archive_id", F.col("id").alias("owner"), F.col("kind").alias("_kind"))
    indexed = document.select("archive_id", (F.coalesce("sprite.colorMode", F.lit("rgba")) == "indexed").alias("_indexed"))
    cels = parts(document, "cels").where("linkedTo IS NULL").select("archive_id", F.col("layerId").alias("owner"), "id", "width", "height")
    cels = cels.join(kinds, ["archive_id", "owner"], "left").join(indexed, "archive_id")
    raw = F.coalesce((F.col("_kind") == "tilemap") | (F.col("_indexed") & (F.col("_kind") == "raster")), F.lit(False))
    cels = cels.select("archive_id", F.lit("cel").alias("kind"), "owner", "id", cel_entry(F.col("id"), raw).alias("name"), raw.alias("raw"), "width", "height")
    tiles = parts(document, "tilesets").select("archive_id", F.col("id").alias("owner"), F.explode("tiles").alias("t"), F.col("tileWidth").alias("width"), F.col("tileHeight").alias("height"))
    tiles = tiles.select("archive_id", F.lit("tile").alias("kind"), "owner", "t.id", tile_entry(F.col("owner"), F.col("t.id")).alias("name"), F.lit(False).alias("raw"), "width", "height")
    return cels.union(tiles)


def contents(document: DataFrame, entry: DataFrame) -> DataFrame:
    """Cels and tiles with their bytes, straight RGBA unless raw; a missing or odd one has a warning, a missing one no bytes."""
    found = expected(document).join(entry.where("name IS NOT NULL").select("archive_id", "name", "data"), ["archive_id", "name"], "left")

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                w, h, data, warning = r.width, r.height, r.data, None
                if data is None:
                    warning = f"missing {r.name}; " + ("layer opens empty" if r.kind == "cel" else "tile is blank")
                elif not r.raw:
                    try:
                        image = png_pixels(bytes(data))
                        h, w = image.shape[:2]
                        data = image.tobytes()
                        if (w, h) != (r.width, r.height):
                            warning = f"{r.name} is {w}x{h} but the document says {r.width}x{r.height}"
                    except (ValueError, KeyError, TypeError, zlib.error, struct.error) as e:
                        data, warning = None, f"{r.name} cannot be decoded: {e}"
                out.append((r.archive_id, r.kind, r.owner, r.id, r.name, r.raw, w, h, data, warning))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTENT.split(", ")])

    return found.mapInPandas(f, CONTENT)


def canvases(px: DataFrame, width: int) -> DataFrame:
    """Pixels -> image_id, height, data: straight RGBA down to the last row with a pixel; what is missing is transparent."""

    def f(t: pa.Table) -> pa.Table:
        y = t.column("y").to_numpy()
        image = np.zeros((int(y.max()) + 1, width, 4), np.uint8)
        image[y, t.column("x").to_numpy()] = np.stack([t.column(c).to_numpy() for c in "rgba"], 1)
        return pa.table({"image_id": t.column("image_id")[:1], "height": pa.array([len(image)], pa.int32()), "data": pa.array([image.tobytes()], pa.binary())})

    known = px.where("image_id IS NOT NULL").select("image_id", "y", "x", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"))
    return known.groupBy("image_id").applyInArrow(f, "image_id long, height int, data binary")


def content_pixels(content: DataFrame) -> DataFrame:
    """Contents with width and data that are not raw -> a row a pixel: the other columns, y, x, r, g, b, a. Those without data give none."""
    others = [c for c in content.schema if c.name not in ("width", "data")]
    names = [c.name for c in others] + ["y", "x", *"rgba"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (w, data) in enumerate(zip(b.column("width").to_pylist(), b.column("data").to_pylist(), strict=True)):
                if data is None:
                    continue
                rgba = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int32)
                at, same = np.arange(len(rgba), dtype=np.int32), pa.array(np.full(len(rgba), k))
                values = (at // np.int32(w), at % np.int32(w), *rgba.T)
                yield pa.RecordBatch.from_arrays([b.column(c.name).take(same) for c in others] + [pa.array(np.ascontiguousarray(v)) for v in values], names)

    return content.mapInArrow(f, ", ".join([f"`{c.name}` {c.dataType.simpleString()}" for c in others] + [f"{c} int" for c in ("y", "x", *"rgba")]))


def preserved(entry: DataFrame, own: DataFrame) -> DataFrame:
    """Entries of older archives that a new one (own: archive_id, name) neither writes nor owns: kept as they are."""
    kept = entry.where(F.col("name").isNotNull() & ~F.col("name").isin(MANIFEST, SPRITE, THUMBNAIL) & ~F.col("name").startswith(CELS) & ~F.col("name").startswith(TILES))
    return kept.select("archive_id", "name", "data").join(own.select("archive_id", "name"), ["archive_id", "name"], "left_anti")


def packed(document: DataFrame, content: DataFrame, thumbnails: DataFrame | None = None, older: DataFrame | None = None, app: str = "1") -> DataFrame:
    """archive_id, content: archives of documents with their contents (as contents() gives them), thumbnails (archive_id, png), and what older entries keep.

    Contents without data are left out, as are documents that could not be opened. Pixels are
    stored as PNG without a second compression, all else is deflated; names are in order.
    """
    ok = document.where("error IS NULL")
    count = lambda c: F.coalesce(F.size(f"sprite.{c}"), F.lit(0))
    manifest = F.to_json(F.struct(F.lit(FORMAT).alias("formatVersion"), F.lit(app).alias("appVersion"), F.col("sprite.width"), F.col("sprite.height"), count("layers").alias("layerCount"), count("frames").alias("frameCount")))
    heads = ok.select("archive_id", F.explode(F.array(F.struct(F.lit(MANIFEST).alias("name"), manifest.alias("t")), F.struct(F.lit(SPRITE).alias("name"), F.to_json("sprite").alias("t")))).alias("e"))
    heads = heads.select("archive_id", "e.name", F.encode("e.t", "UTF-8").alias("data"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [bytes(r.data) if r.raw else png_bytes(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 4)) for r in b.itertuples(index=False)]
            yield pd.DataFrame({"archive_id": b["archive_id"], "name": b["name"], "data": data})

    own = heads.union(content.where("data IS NOT NULL").mapInPandas(encode, "archive_id long, name string, data binary").join(ok.select("archive_id"), "archive_id", "left_semi").select("archive_id", "name", "data"))
    if thumbnails is not None:
        own = own.union(thumbnails.select("archive_id", F.lit(THUMBNAIL), "png").join(ok.select("archive_id"), "archive_id", "left_semi"))
    if older is not None:
        own = own.union(preserved(older.join(ok.select("archive_id"), "archive_id", "left_semi"), own).select("archive_id", "name", "data"))

    def zipped(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in pdf.sort_values("name").itertuples(index=False):
                info = zipfile.ZipInfo(r.name)
                info.compress_type = zipfile.ZIP_STORED if r.name.endswith(".png") else zipfile.ZIP_DEFLATED
                z.writestr(info, bytes(r.data))
        return pd.DataFrame({"archive_id": [pdf["archive_id"].iloc[0]], "content": [out.getvalue()]})

    return own.groupBy("archive_id").applyInPandas(zipped, "archive_id long, content binary")
