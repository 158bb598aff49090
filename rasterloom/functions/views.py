"""View, text and number functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.color import half_up

# Zoom limits, and the ladder of label intervals of a chart with its glyph width.
MIN_ZOOM, MAX_ZOOM = 1, 64
INTERVALS = (1, 2, 5, 10, 20, 25, 50, 100, 200, 500)
GLYPH = 3


def to_document(sx: Column, pan: Column, zoom: Column) -> Column:
    return F.floor((sx - pan) / zoom)


def to_screen(dx: Column, pan: Column, zoom: Column) -> Column:
    return dx * zoom + pan


def center_pan(zoom: Column, size: Column, view: Column) -> Column:
    return half_up((view - size * zoom) / 2)


def fit_zoom(w: Column, h: Column, view_w: Column, view_h: Column, margin: int = 48) -> Column:
    return F.greatest(F.lit(1), F.floor(F.least((view_w - margin) / w, (view_h - margin) / h)))


def zoom_about(pan: Column, zoom: Column, factor: Column, at: Column) -> tuple[Column, Column]:
    """New zoom and pan that keep the point `at` where it is."""
    new = F.greatest(F.lit(float(MIN_ZOOM)), F.least(F.lit(float(MAX_ZOOM)), zoom * factor))
    return new, F.when(new == zoom, pan.cast("double")).otherwise(at - (at - pan) * (new / zoom))


def scroll_thumb(content: Column, view: Column, pan: Column) -> tuple[Column, Column]:
    """Size and place of a scroll bar's thumb, for a view that may scroll one view beyond each end."""
    length = content + 2 * view
    ratio = F.least(F.lit(1.0), view / length)
    most = F.greatest(F.lit(0), length - view)
    scroll = F.least(most, F.greatest(F.lit(0), view - pan))
    return ratio, F.when((most > 0) & (ratio < 1), F.try_divide(scroll.cast("double"), most) * (1 - ratio)).otherwise(0.0)


def megabytes(n: Column) -> Column:
    """Bytes as megabytes with one place; what lies halfway goes to the even digit."""
    return F.format_string("%.1f MB", F.bround(n / F.lit(1048576.0), 1))


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def url_slug(url: Column, folder: str) -> Column:
    """Name of the page right under folder, without a palette file's extension; null if the path is another."""
    name = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), rf"(?i)^/{folder}/([^/]+)/?$", 1)
    return F.nullif(F.regexp_replace(name, r"(?i)\.(hex|gpl|pal|txt|png|ase)$", ""), F.lit(""))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^\\/]*)$", 1), r"\.[^.]+$", "")


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", "imported").otherwise(s)


def label_interval(cell: Column, scale: Column, largest: Column) -> Column:
    """The first interval of the ladder at which the widest number fits, else the last."""
    digits = F.length(largest.cast("string"))
    needed = digits * GLYPH * scale + (digits - 1) * scale + scale * 2
    fits = F.filter(F.array(*map(F.lit, INTERVALS)), lambda i: cell * i >= needed)
    return F.coalesce(F.get(fits, 0), F.lit(INTERVALS[-1]))


def next_frame(at: Column, frames: Column, step: int) -> Column:
    return F.pmod(at + step, frames)


def onion_opacity(distance: Column) -> Column:
    return 0.5 * F.pow(F.lit(0.65), F.abs(distance) - 1)
