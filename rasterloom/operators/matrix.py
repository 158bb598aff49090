"""Conversions by a relation of settings: many images, each by the settings asked for it, in one plan.

What is chosen in convert.Settings on the driver is here a column: sizes, palettes, dithers,
thresholds and adjustments differ from row to row, and no step is planned per setting or
per size. An image is prepared (cut, adjusted, downscaled) once for all its settings that
agree on how. An image under a setting is one of its own for the operators: its id is
image_id * IDS + setting_id, so setting_ids are 0 to IDS - 1.

Settings are few and meet pixels by broadcast; what has a row per image or per image and
setting grows with the images and is never broadcast, however small its files are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import adjust, with_oklab, with_srgb
from rasterloom.operators import kernels as K
from rasterloom.operators import raster as R
from rasterloom.operators.convert import Settings
from rasterloom.tables import settled

IDS = 1 << 20
SETTING = (
    "setting_id long, pixel_size int, width int, height int, mode string, palette array<array<int>>, max_colors int, dither string, strength double, background double, mask_threshold int, mask_close int, mask_feather int, "
    "crop array<double>, brightness double, contrast double, saturation double, hue double, despeckle int, outline_color array<int>, thickness int, corners boolean, fit boolean, alpha_threshold int, preserve_alpha boolean, color_space string"
)
_NAMES = [f.strip().split(" ")[0] for f in SETTING.split(", ")]
#: What decides how an image looks before its colours are chosen.
_PREPARED_BY = ("pixel_size", "width", "height", "mode", "background", "mask_threshold", "mask_close", "mask_feather", "crop", "fit", "_fit_threshold", "brightness", "contrast", "saturation", "hue")


def settings_table(spark: SparkSession, settings: list[tuple[Settings, int | None]]) -> DataFrame:
    """Settings as rows, numbered from 0; the second of a pair, if not None, is the side of the blocks that become a pixel, and sets the size by the image."""
    rows = []
    for k, (s, block) in enumerate(settings):
        one = vars(s) | {"setting_id": k, "pixel_size": block, "palette": [list(c) for c in s.palette], "crop": list(map(float, s.crop)) if s.crop else None, "outline_color": list(s.outline_color) if s.outline_color else None}
        rows.append(tuple(one[n] for n in _NAMES))
    return spark.createDataFrame(rows, SETTING)


def _adjusted(px: DataFrame) -> DataFrame:
    """Each image by its own brightness, contrast, saturation and hue; one with nothing to adjust makes no round trip."""
    amounts = ("brightness", "contrast", "saturation", "hue")
    some = reduce(lambda x, y: x | y, (F.col(c) != 0 for c in amounts))
    lab = with_oklab(px.withColumns({f"_was_{c}": F.col(c) for c in "rgb"}))
    l, a, b = adjust(tuple(F.col(f"lab_{k}") for k in "lab"), F.col("brightness"), F.col("contrast"), F.col("saturation"))
    turn = F.radians("hue")
    out = with_srgb(lab.withColumns({"lab_l": l, "lab_a": a * F.cos(turn) - b * F.sin(turn), "lab_b": a * F.sin(turn) + b * F.cos(turn)}))
    return out.withColumns({c: F.when(some, F.col(c)).otherwise(F.col(f"_was_{c}")) for c in "rgb"}).select(px.columns)


def _framed(px: DataFrame, any_fit: bool) -> DataFrame:
    """Images cut to their crops, whose edges are cut to whole pixels and to the image, and then to what is opaque, where asked for."""
    inside = lambda v, n: F.greatest(F.lit(0), F.least(v.cast("int"), F.col(n)))  # noqa: E731  the cast cuts toward zero
    c = lambda k: F.col("crop")[k]
    edges = {"_x0": inside(c(0), "_w"), "_y0": inside(c(1), "_h"), "_x1": inside(c(0) + c(2), "_w"), "_y1": inside(c(1) + c(3), "_h")}
    whole = {"_x0": F.lit(0), "_y0": F.lit(0), "_x1": F.col("_w"), "_y1": F.col("_h")}
    px = px.withColumns({n: F.when(F.col("crop").isNull(), whole[n]).otherwise(e) for n, e in edges.items()})
    seen = F.col("fit") & (F.col("a") >= F.col("_fit_threshold"))
    one = Window.partitionBy("image_id")
    px = px.where("x >= _x0 AND x < _x1 AND y >= _y0 AND y < _y1")
    bounds = {"_x0": F.min(F.when(seen, F.col("x"))), "_y0": F.min(F.when(seen, F.col("y"))), "_x1": F.max(F.when(seen, F.col("x") + 1)), "_y1": F.max(F.when(seen, F.col("y") + 1))}
    if any_fit:
        fitted = px.where("fit").withColumns({n: F.coalesce(b.over(one), F.col(n)) for n, b in bounds.items()}).where("x >= _x0 AND x < _x1 AND y >= _y0 AND y < _y1")
        px = px.where("NOT fit").union(fitted.select(px.columns))
    return px.withColumns({"x": F.col("x") - F.col("_x0"), "y": F.col("y") - F.col("_y0"), "_w": F.col("_x1") - F.col("_x0"), "_h": F.col("_y1") - F.col("_y0")}).drop("_x0", "_y0", "_x1", "_y1")


def prepared(px: DataFrame, used: Row) -> DataFrame:
    """image_id, y, x, r, g, b, a of images that carry their size (_w, _h) and the columns that say how they are prepared; used says which steps any of them needs."""
    size = {n: F.when(F.col("pixel_size").isNull(), F.col(c)).otherwise(F.greatest(F.lit(1), F.floor(F.col(s) / F.col("pixel_size") + 0.5))).cast("int") for n, c, s in (("_dst_w", "width", "_w"), ("_dst_h", "height", "_h"))}
    px = px.withColumns(size)
    if used.background:
        cut = K.cut_out(px.where("background IS NOT NULL"), "background", "mask_threshold", "mask_close", "mask_feather")
        px = px.where("background IS NULL").union(cut)
    if used.crop or used.fit:
        px = _framed(px, used.fit)
    if used.adjust:
        px = _adjusted(px)
    if used.background or used.fit:
        px = settled(px, "framed")
    same = F.col("_w").eqNullSafe(F.col("_dst_w")) & F.col("_h").eqNullSafe(F.col("_dst_h"))
    out = px.where(same).select("image_id", "y", "x", "r", "g", "b", "a")
    for mode, down in (("box", R.box_downscale), ("nearest", R.nearest_downscale), ("dominant", R.dominant_downscale)):
        if mode in used.modes:
            out = out.union(down(px.where(~same & (F.col("mode") == mode)), F.col("_w"), F.col("_h"), F.col("_dst_w"), F.col("_dst_h")))
    return settled(out, "prepared")


def _used(settings: DataFrame) -> Row:
    """Which steps the settings need at all: one row, from the settings alone."""
    adjust_ = reduce(lambda x, y: x | y, (F.col(c) != 0 for c in ("brightness", "contrast", "saturation", "hue")))
    some = {"background": F.col("background").isNotNull(), "crop": F.col("crop").isNotNull(), "fit": F.col("fit"), "adjust": adjust_, "despeckle": F.col("despeckle") > 0, "automatic": F.size("palette") == 0, "diffused": F.col("dither").isin(list(K.DIFFUSION))}
    rings = F.max(F.when(F.col("outline_color").isNotNull(), F.col("thickness")))
    return settings.agg(*(F.coalesce(F.bool_or(e), F.lit(False)).alias(n) for n, e in some.items()), F.collect_set("mode").alias("modes"), F.coalesce(rings, F.lit(0)).alias("rings")).first()


def _entries(colors_: DataFrame, by: str) -> DataFrame:
    """pal (entries by number, in both colour spaces) and spread of each palette, from its colours (i, r, g, b)."""
    entry = F.struct("i", F.col("lab_l").alias("l"), F.col("lab_a").alias("p"), F.col("lab_b").alias("q"), "r", "g", "b")
    pal = with_oklab(colors_).groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("pal"))
    apart = lambda p, q: sum(((p[k] - q[k]) * (p[k] - q[k]) for k in "lpq"), F.lit(0.0))
    near = F.transform("pal", lambda p: F.sqrt(F.array_min(F.transform(F.filter("pal", lambda q: q["i"] != p["i"]), lambda q: apart(p, q)))))
    spread = F.when(F.size("pal") < 2, 0.0).otherwise(F.aggregate(near, F.lit(0.0), lambda x, y: x + y) / F.size("pal"))
    return pal.withColumn("spread", spread)


def _palettes(px: DataFrame, settings: DataFrame, automatic: bool) -> tuple[DataFrame, DataFrame | None]:
    """The palettes of settings (_setting, pal, spread), and those made from the pixels of images whose settings have none (image_id, pal, spread)."""
    given = settings.where(F.size("palette") > 0).select(F.col("setting_id").alias("_setting"), F.posexplode("palette").alias("i", "c")).select("_setting", "i", *(F.col("c")[k].alias(n) for k, n in enumerate("rgb")))
    own = settled(_entries(K.auto_palette(px.where("automatic"), "max_colors", threshold=F.col("alpha_threshold")), "image_id"), "palettes") if automatic else None
    return settled(_entries(given, "_setting"), "palettes"), own


def _with_palette(rows: DataFrame, palettes: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    """rows with pal and spread of their image."""
    given, own = palettes
    out = rows.join(F.broadcast(given), F.pmod("image_id", F.lit(IDS)) == F.col("_setting")).drop("_setting")
    return out if own is None else out.union(rows.join(own.hint("merge"), "image_id").select(out.columns))


def _nearest(pal: Column, point: dict[str, Column], slack: float) -> Column:
    """Number of the entry nearest to a point, entry by entry."""

    def step(best: Column, e: Column) -> Column:
        d = reduce(lambda x, y: x + y, ((v - e[k]) * (v - e[k]) for k, v in point.items()))
        return F.when(d < best["d"] - slack, F.struct(d.alias("d"), e["i"].alias("i"))).otherwise(best)

    return F.aggregate(pal, F.struct(F.lit(float("inf")).alias("d"), F.lit(0).alias("i")), step, lambda b: b["i"])


def _quantized(px: DataFrame, palettes: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    """px with idx, without diffusion: only the distinct colours of an image, with their shifts, meet its palette."""
    order = F.regexp_extract("dither", r"^bayer(\d)$", 1)
    matrix = lambda n: (R.bayer(F.col("x"), F.col("y"), n) + 0.5) / float(n * n) - 0.5
    shift = F.when(order == "2", matrix(2)).when(order == "4", matrix(4)).when(order == "8", matrix(8)).otherwise(0.0) * F.col("strength")
    plain = (F.col("dither") == "none") & (F.col("color_space") == "srgb")
    rows = px.withColumns({"_shift": shift, "_plain": plain})
    by = ["image_id", "r", "g", "b", "_shift", "_plain"]
    tones = with_oklab(_with_palette(rows.where("_a > 0").select(by).distinct(), palettes)).withColumn("lab_l", F.col("lab_l") + F.col("_shift") * F.col("spread"))
    labs = {"l": F.col("lab_l"), "p": F.col("lab_a"), "q": F.col("lab_b")}
    index = F.when(F.col("_plain"), _nearest(F.col("pal"), {k: F.col(k).cast("double") for k in "rgb"}, 0.0)).otherwise(_nearest(F.col("pal"), labs, R.EPSILON))
    out = rows.join(tones.select(*by, index.alias("_i")), by, "left")
    return out.withColumn("idx", F.when(F.col("_a") == 0, R.TRANSPARENT).otherwise(F.col("_i")).cast("int")).select(*px.columns, "idx")


def _diffused(px: DataFrame, palettes: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    def f(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("image_id", "y", "x", "idx")})
        one = pdf.iloc[0]
        labs = np.array([[e["l"], e["p"], e["q"]] for e in own["pal"].iloc[0]]) if len(own) else np.zeros((1, 3))
        return K.diffused(pdf, labs, one["dither"], float(one["strength"]), int(one["alpha_threshold"]))

    pal = _with_palette(px.select("image_id").distinct(), palettes).select(F.col("image_id").alias("_image"), "pal")
    idx = px.groupBy("image_id").cogroup(pal.groupBy("_image")).applyInPandas(f, "image_id long, y int, x int, idx int")
    return px.join(idx, ["image_id", "y", "x"])


def _cleaned(px: DataFrame, palettes: tuple[DataFrame, DataFrame | None], specks: bool, rings: int) -> DataFrame:
    """Specks and outlines, where asked for; so many steps of rings are planned as the widest outline has."""
    opaque = F.when(F.col("idx") == R.TRANSPARENT, 0).when(F.col("a") == 0, 255).otherwise(F.col("a"))
    if specks:
        rest = px.where("despeckle <= 0")
        px = rest.union(K.despeckle(px.where("despeckle > 0"), "despeckle").withColumn("a", opaque).select(rest.columns))
    if not rings:
        return px
    rest, px = px.where("outline_color IS NULL"), px.where("outline_color IS NOT NULL")
    color = {k: F.col("outline_color")[i] for i, k in enumerate("rgb")}
    wanted = _with_palette(with_oklab(px.select("image_id", *(v.alias(k) for k, v in color.items())).distinct()), palettes)
    wanted = wanted.select("image_id", _nearest(F.col("pal"), {"l": F.col("lab_l"), "p": F.col("lab_a"), "q": F.col("lab_b")}, R.EPSILON).alias("_ring"))
    out = px.join(wanted.hint("merge"), "image_id").withColumn("_was", F.col("idx"))
    for k in range(rings):
        for corners in (False, True):
            grown = R.outline(out.withColumn("_now", F.col("idx")), F.col("_ring"), corners)
            out = grown.withColumn("idx", F.when((F.col("thickness") > k) & (F.col("corners") == corners), F.col("idx")).otherwise(F.col("_now"))).drop("_now")
    new = (F.col("_was") == R.TRANSPARENT) & (F.col("idx") != R.TRANSPARENT)
    return rest.union(out.withColumn("a", F.when(new, F.col("outline_color")[3]).otherwise(F.col("a")).cast("int")).select(rest.columns))


def convert_each(px: DataFrame, sizes: DataFrame, asked: DataFrame, settings: DataFrame) -> DataFrame:
    """image_id, setting_id, y, x, idx, a of every (image_id, setting_id) asked for; an image that a crop leaves nothing of gives no row.

    px (image_id, y, x, r, g, b, a), sizes (image_id, width, height), settings as in settings_table().
    """
    settings = settings.withColumn("_fit_threshold", F.when(F.col("fit"), F.col("alpha_threshold")))
    settings = settings.withColumn("_prep", F.min("setting_id").over(Window.partitionBy(*_PREPARED_BY)))  # settings alone
    asked = asked.select("image_id", "setting_id").distinct().join(F.broadcast(settings.select("setting_id", "_prep")), "setting_id").withColumn("_source", F.col("image_id") * IDS + F.col("_prep"))
    sources = asked.select("image_id", "_source", "_prep").distinct()
    sources = sources.join(sizes.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")).hint("merge"), "image_id")
    used = _used(settings)
    each = px.select("image_id", "y", "x", "r", "g", "b", "a").join(sources.hint("shuffle_hash"), "image_id").drop("image_id").withColumnRenamed("_source", "image_id")
    ready = prepared(each.join(F.broadcast(settings.where("setting_id = _prep").select("_prep", *_PREPARED_BY)), "_prep").drop("_prep"), used)
    works = asked.select((F.col("image_id") * IDS + F.col("setting_id")).alias("_id"), "_source", "setting_id")
    finish = settings.select(*(c for c in _NAMES if c not in (*_PREPARED_BY, "palette")), (F.size("palette") == 0).alias("automatic"))
    rows = ready.withColumnRenamed("image_id", "_source").join(works.hint("shuffle_hash"), "_source").join(F.broadcast(finish), "setting_id").drop("_source", "setting_id")
    rows = rows.withColumnRenamed("_id", "image_id").withColumn("_a", F.when(F.col("a") < F.col("alpha_threshold"), 0).otherwise(F.when(F.col("preserve_alpha"), F.col("a")).otherwise(255)).cast("int"))
    pal = _palettes(rows, settings, used.automatic)
    spreads = F.col("dither").isin(list(K.DIFFUSION))
    out = _quantized(rows.where(~spreads), pal)
    if used.diffused:
        out = out.union(_diffused(rows.where(spreads), pal).select(out.columns))
    out = out.withColumn("a", F.col("_a"))
    if used.despeckle or used.rings:
        out = _cleaned(settled(out, "quantized"), pal, used.despeckle, used.rings)
    return out.select(F.floor(F.col("image_id") / IDS).alias("image_id"), F.pmod("image_id", F.lit(IDS)).alias("setting_id"), "y", "x", "idx", "a")


def differences(converted: DataFrame, plain: DataFrame) -> DataFrame:
    """image_id, setting_id, pixels, used (colours), differing (from the same image under its plain setting) and first differing place.

    plain (setting_id, plain_id) says with which setting a setting is compared.
    """
    converted = settled(converted, "converted")
    other = converted.select("image_id", F.col("setting_id").alias("plain_id"), "y", "x", F.col("idx").alias("_idx"))
    both = converted.join(F.broadcast(plain), "setting_id").join(other.hint("merge"), ["image_id", "plain_id", "y", "x"])
    apart = F.col("idx") != F.col("_idx")
    return both.groupBy("image_id", "setting_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_distinct(F.when(F.col("idx") != R.TRANSPARENT, F.col("idx"))).alias("used"), F.count_if(apart).alias("differing"), F.min(F.when(apart, F.struct("y", "x"))).alias("first")
    ).select("image_id", "setting_id", "pixels", "used", "differing", F.col("first.y").alias("first_y"), F.col("first.x").alias("first_x"))


def worst(cases: DataFrame, k: int = 10) -> DataFrame:
    """The k cases with the largest share of differing pixels, ties by image and setting."""
    share = F.col("differing") / F.col("pixels")
    return cases.withColumn("share", share).orderBy(F.desc("share"), "image_id", "setting_id").limit(k)
