"""Convert a folder of images: python -m rasterloom.batch FOLDER --out FOLDER [--settings FILE] [--pixel-size N] [--scale N]

Every regular file of the folder is decoded on the executors, whatever its name; a file that
fails becomes a row with its error and stops nothing. The result is a table of Parquet,
(path, name, width, height, colors_used, png, error); with --files the images are also
written one by one as {stem}.png beside it. With --progress a line tells how far it is.
Exit code 0: all converted; 1: some or all failed; 2: wrong arguments.

Images of one size are converted and written together, so there are as many jobs as sizes; before
each the caller may stop, and what is written stays.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import views
from rasterloom.operators import convert as V
from rasterloom.operators.raster import TRANSPARENT
from rasterloom.sources import images as I

#: Whole-number enlargements of the result.
SCALES = (1, 2, 4, 8)


def settings_from(text: str | None) -> V.Settings:
    """Settings of a JSON object by field name; unknown names are an error."""
    given = json.loads(text) if text else {}
    given = {k: tuple(tuple(c) for c in v) if k == "palette" else tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    return V.Settings(**given)


def convert_folder(spark: SparkSession, folder: str, out: str, settings: V.Settings, pixel_size: float = 8.0, scale: int = 1, proceed: Callable[[int, int], bool] = lambda done, total: True) -> DataFrame:
    """Rows of all files, read back from out; of those done so far, if proceed(files done, files) says no before a job."""
    if scale not in SCALES or not pixel_size > 0:
        raise ValueError("scale is 1, 2, 4 or 8, and the pixel size above zero")
    files = I.read_images(spark, folder)
    names = files.select("image_id", "path").withColumn("name", F.concat(views.base_name(F.col("path")), F.lit(".png")))
    pixels = f"{out}/_pixels"
    I.decode_folder(spark, folder).write.mode("overwrite").parquet(pixels)  # decoded once, whatever the number of sizes
    px = spark.read.parquet(pixels)
    failed = px.where("error IS NOT NULL").select("image_id", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("long").alias("colors_used"), F.lit(None).cast("binary").alias("png"), "error")
    px = px.where("error IS NULL").drop("error")
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    to = f"{out}/converted"

    def write(rows: DataFrame, mode: str) -> None:
        names.join(rows, "image_id").select("path", "name", "width", "height", "colors_used", "png", "error").write.mode(mode).parquet(to)

    write(failed, "overwrite")
    total, done = names.count(), spark.read.parquet(to).count()
    for w, h, n in sizes.groupBy("w", "h").agg(F.count(F.lit(1))).orderBy("w", "h").collect():
        if not proceed(done, total):
            break
        some = px.join(sizes.where((F.col("w") == w) & (F.col("h") == h)).select("image_id"), "image_id", "left_semi")
        cut = settings.crop[2:] if settings.crop else (w, h)
        s = dataclasses.replace(settings, width=max(1, int(cut[0] / pixel_size + 0.5)), height=max(1, int(cut[1] / pixel_size + 0.5)))
        ready = V.prepare(some, s, w, h)
        own = None if s.palette else V.colors_of(ready, s)
        colors = own if own is not None else spark.createDataFrame([(i, *c) for i, c in enumerate(s.palette)], "i int, r int, g int, b int")
        shown = V.render(V.quantized(ready, s, own), colors)
        used = shown.where(F.col("idx") != TRANSPARENT).groupBy("image_id").agg(F.countDistinct("idx").alias("colors_used"))
        for c in "yx":
            shown = shown.withColumn(c, F.explode(F.sequence(F.col(c) * scale, F.col(c) * scale + (scale - 1))))
        ready = I.encode_png(shown).join(used, "image_id", "left").select("image_id", "width", "height", F.coalesce("colors_used", F.lit(0)).cast("long").alias("colors_used"), "png", F.lit(None).cast("string").alias("error"))
        write(ready, "append")
        done += n
    return spark.read.parquet(to)


def write_files(rows: DataFrame, out: str) -> None:
    """The images as files, through Spark's file system, one at a time."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in rows.where("error IS NULL").select("name", "png").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{out}/{r.name}")
        stream = path.getFileSystem(conf).create(path, True)
        stream.write(bytearray(r.png))
        stream.close()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rasterloom.batch")
    p.add_argument("folder")
    p.add_argument("--out", required=True)
    p.add_argument("--settings")
    p.add_argument("--pixel-size", type=float, default=8.0)
    p.add_argument("--scale", type=int, default=1, choices=SCALES)
    p.add_argument("--files", action="store_true")
    p.add_argument("--progress", action="store_true")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.getOrCreate()
    try:
        text = "\n".join(r[0] for r in spark.read.text(a.settings).collect()) if a.settings else None

        def proceed(done: int, total: int) -> bool:
            if a.progress:
                print(json.dumps({"done": done, "total": total}), flush=True)
            return True

        rows = convert_folder(spark, a.folder, a.out, settings_from(text), a.pixel_size, a.scale, proceed)
    except (ValueError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if a.files:
        write_files(rows, a.out)
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count("error").alias("failed")).first()
    print(json.dumps({"succeeded": n["all"] - n["failed"], "failed": n["failed"]}))
    return 1 if n["failed"] or not n["all"] else 0


if __name__ == "__main__":
    sys.exit(main())
