"""The conversion of images to few colours, as one chain of operators chosen from settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import adjust_image
from rasterloom.operators import kernels as K
from rasterloom.operators import raster as R


@dataclass(frozen=True)
class Settings:
    """What to do; defaults do nothing beyond downscaling and nearest colours."""

    width: int = 16
    height: int = 16
    mode: str = "box"  # box, nearest or dominant
    palette: tuple[tuple[int, int, int], ...] = field(default_factory=tuple)
    max_colors: int = 16  # of an automatic palette, where palette is empty
    dither: str = "none"  # none, bayer2, bayer4, bayer8, floyd-steinberg, atkinson
    strength: float = 1.0
    background: float | None = None  # tolerance of the flood fill
    mask_threshold: int | None = None  # of what the flood fill leaves, made all or nothing
    mask_close: int = 0
    mask_feather: int = 0
    crop: tuple[int, int, int, int] | None = None  # x, y, width, height
    brightness: float = 0.0
    contrast: float = 0.0
    saturation: float = 0.0
    hue: float = 0.0
    despeckle: int = 0
    outline: int | None = None  # palette index of one ring, as opaque as can be
    outline_color: tuple[int, int, int, int] | None = None  # of rings in the nearest palette entry, at this alpha
    thickness: int = 1  # of those rings
    corners: bool = False
    fit: bool = False  # cut to what is opaque, after the crop
    alpha_threshold: int = 128
    preserve_alpha: bool = False
    color_space: str = "oklab"  # or srgb; counts without dithering only


def crop(px: DataFrame, x: float, y: float, w: float, h: float, width: int | None = None, height: int | None = None) -> DataFrame:
    """The pixels in a rectangle, whose edges are cut to whole pixels and to the image, from (0, 0); an empty one is an error."""
    inside = lambda v, n: max(0, int(v) if n is None else min(int(v), n))
    x0, y0, x1, y1 = inside(x, width), inside(y, height), inside(x + w, width), inside(y + h, height)
    if x1 <= x0 or y1 <= y0:
        raise ValueError(f"the rectangle {x}, {y}, {w} x {h} holds no pixel of the image")
    return px.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def fit_to_subject(px: DataFrame, width: int, height: int, threshold: int = 128, padding: int = 0) -> DataFrame:
    """Every image cut to the bounds of what is opaque, with its new size as _w and _h; one without such pixels stays as it is."""
    b = R.opaque_bounds(px, threshold)
    lo = lambda c: F.greatest(F.lit(0), F.col(c) - padding)
    b = b.select("image_id", lo("x").alias("_x0"), lo("y").alias("_y0"), F.least(F.lit(width), F.col("x") + F.col("width") + padding).alias("_x1"), F.least(F.lit(height), F.col("y") + F.col("height") + padding).alias("_y1"))
    whole = {"_x0": 0, "_y0": 0, "_x1": width, "_y1": height}
    out = px.join(b, "image_id", "left").fillna(whole).where("x >= _x0 AND x < _x1 AND y >= _y0 AND y < _y1")
    return out.withColumns({"x": F.col("x") - F.col("_x0"), "y": F.col("y") - F.col("_y0"), "_w": F.col("_x1") - F.col("_x0"), "_h": F.col("_y1") - F.col("_y0")}).drop("_x0", "_y0", "_x1", "_y1")


def render(idx: DataFrame, palette: DataFrame) -> DataFrame:
    """idx (65535: transparent) -> r, g, b, a by a join with (i, r, g, b), or (image_id, i, r, g, b) of each image's own; a transparent pixel is all zero."""
    p = palette.select(*(["image_id"] if "image_id" in palette.columns else []), F.col("i").alias("idx"), *(F.col(c).alias(f"_{c}") for c in "rgb"))
    if "image_id" in palette.columns:
        out = idx.join(p, ["image_id", "idx"], "left")
    else:
        out = idx.join(F.broadcast(p), "idx", "left")  # at most 65,535 entries
    zero = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0)).cast("int").alias(c)
    return out.select("image_id", "y", "x", "idx", *map(zero, "rgb"), F.when(F.col("_r").isNull(), 0).otherwise(F.col("a")).cast("int").alias("a"))


def prepare(px: DataFrame, s: Settings, width: int, height: int) -> DataFrame:
    """The images as they are when their colours are chosen: without background, cut, adjusted, downscaled."""
    if s.background is not None:
        px = R.post_process(K.remove_background(px, s.background), s.mask_threshold, s.mask_close, s.mask_feather)
    if s.crop:
        px = crop(px, *s.crop, width, height)
        (x, y, w, h), (left, top) = s.crop, (max(0, int(s.crop[0])), max(0, int(s.crop[1])))
        width, height = min(int(x + w), width) - left, min(int(y + h), height) - top
    if s.fit:
        px = fit_to_subject(px, width, height, s.alpha_threshold)
        width, height = F.col("_w"), F.col("_h")
    px = adjust_image(px, s.brightness, s.contrast, s.saturation, s.hue)
    if s.fit or (s.width, s.height) != (width, height):
        down = {"box": R.box_downscale, "nearest": R.nearest_downscale, "dominant": R.dominant_downscale}[s.mode]
        px = down(px, width, height, s.width, s.height)
    return px


def colors_of(prepared: DataFrame, s: Settings) -> DataFrame:
    """Automatic palettes (image_id, i, r, g, b) of prepared images."""
    return K.auto_palette(prepared, s.max_colors, threshold=s.alpha_threshold)


def convert(px: DataFrame, s: Settings, width: int, height: int) -> DataFrame:
    """image_id, y, x, idx, a of the converted images; steps that do nothing are not planned.

    Without a palette in the settings every image gets its own, see colors_of().
    """
    px = prepare(px, s, width, height)
    return quantized(px, s, None if s.palette else colors_of(px, s))


def quantized(px: DataFrame, s: Settings, palettes: DataFrame | None = None) -> DataFrame:
    """The steps from the choice of colours on, for prepared images."""
    palette, bayer = list(s.palette), int(s.dither[5:]) if s.dither.startswith("bayer") else 0
    alpha = {"threshold": s.alpha_threshold, "preserve": s.preserve_alpha}
    if s.dither in K.DIFFUSION:
        if palettes is None:
            out = K.diffuse(px, palette, s.dither, s.strength, s.alpha_threshold)
        else:
            out = K.diffuse_own(px, palettes, s.dither, s.strength, s.alpha_threshold)
        out = out.join(px.select("image_id", "y", "x", R.resolve_alpha(F.col("a"), **alpha).alias("a")), ["image_id", "y", "x"])
    elif palettes is not None:
        out = R.quantize_own(px, palettes, bayer, s.strength, space="oklab" if bayer else s.color_space, **alpha)
    elif bayer:
        out = R.quantize_ordered(px, palette, bayer, s.strength, **alpha)
    else:
        out = R.quantize(px, palette, space=s.color_space, **alpha)
    out = out.select("image_id", "y", "x", "idx", F.col("a").cast("int").alias("a"))
    opaque = F.when(F.col("idx") == R.TRANSPARENT, 0).when(F.col("a") == 0, 255).otherwise(F.col("a"))
    if s.despeckle:
        out = K.despeckle(out, s.despeckle).withColumn("a", opaque)
    if s.outline is not None:
        out = R.outline(out, s.outline, s.corners).withColumn("a", opaque)
    if s.outline_color is not None:
        if palettes is None:
            color = F.lit(R.nearest_of(s.outline_color[:3], palette))
        else:
            out = out.join(R.nearest_entry(palettes, s.outline_color[:3]), "image_id")
            color = F.col("i")
        out = R.outlined(out, color, s.outline_color[3], s.thickness, s.corners).select("image_id", "y", "x", "idx", "a")
    return out
