"""Grid, rectangle, tag and view arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.color import half_up

# The bits of a packed tile id.
INDEX_BITS, FLIP_H, FLIP_V, TRANSPOSE = 28, 28, 29, 30
#: Vertical step of hexagonal rows, in tile heights.
HEX_STEP = 0.75


def pack_tile(index: Column, flip_h: Column, flip_v: Column, transpose: Column) -> Column:
    bit = lambda c, k: F.shiftleft(c.cast("long"), k)
    return index.cast("long").bitwiseOR(bit(flip_h, FLIP_H)).bitwiseOR(bit(flip_v, FLIP_V)).bitwiseOR(bit(transpose, TRANSPOSE))


def unpack_tile(packed: Column) -> dict[str, Column]:
    bit = lambda k: F.shiftright(packed, k).bitwiseAND(F.lit(1)) == 1
    return {"tile": packed.bitwiseAND(F.lit((1 << INDEX_BITS) - 1)), "flip_h": bit(FLIP_H), "flip_v": bit(FLIP_V), "transpose": bit(TRANSPOSE)}


def cell_origin(shape: str, col: Column, row: Column, tw: int, th: int, ox: int = 0, oy: int = 0) -> tuple[Column, Column]:
    if shape == "isometric":
        return ox + (col - row) * (tw / 2), oy + (col + row) * (th / 2)
    if shape == "hexagonal":
        return ox + col * tw + F.pmod(row, F.lit(2)) * (tw / 2), oy + row * (th * HEX_STEP)
    return ox + col * tw, oy + row * th


def grid_size(shape: str, w: Column, h: Column, tw: int, th: int, ox: int = 0, oy: int = 0) -> tuple[Column, Column]:
    """Cells along the first row and down the first column whose boxes lie on the canvas, up to the first that does not, however many."""
    fit = lambda room, step: F.greatest(F.lit(0), F.floor(room / step) + 1)  # noqa: E731  places 0, step, 2 step, ... within room
    across, down = w - ox - tw, h - oy - th
    first = F.lit(ox >= 0 and oy >= 0) & (across >= 0) & (down >= 0)
    if shape == "isometric":
        # to the right cells also go down, and down they also go to the left
        cols, rows = F.least(fit(across, tw / 2), fit(down, th / 2)), F.least(fit(F.lit(float(ox)), tw / 2), fit(down, th / 2))
    elif shape == "hexagonal":
        cols, rows = fit(across, tw), F.when(across >= tw / 2, fit(down, th * HEX_STEP)).otherwise(F.least(F.lit(1), fit(down, th * HEX_STEP)))
    else:
        cols, rows = fit(across, tw), fit(down, th)
    return F.when(first, cols).otherwise(0).cast("long"), F.when(first, rows).otherwise(0).cast("long")


def pixel_to_cell(shape: str, x: Column, y: Column, tw: int, th: int, ox: int = 0, oy: int = 0) -> tuple[Column, Column]:
    """Cell of a pixel; for hexagons the nearest middle of nine, the first in scan order among equals."""
    if shape == "isometric":
        u, v = (x - ox - tw / 2) / (tw / 2), (y - oy - th / 2) / (th / 2)
        return half_up((u + v) / 2), half_up((v - u) / 2)
    if shape == "hexagonal":
        near = half_up((y - oy - th / 2) / (th * HEX_STEP))
        best = []
        for dr in (-1, 0, 1):
            row = near + dr
            middle = half_up((x - ox - F.pmod(row, F.lit(2)) * (tw / 2) - tw / 2) / tw)
            for dc in (-1, 0, 1):
                px, py = cell_origin(shape, middle + dc, row, tw, th, ox, oy)
                d = (x - px - tw / 2) * (x - px - tw / 2) + (y - py - th / 2) * (y - py - th / 2)
                best.append(F.struct(d.alias("d"), F.lit(len(best)).alias("k"), (middle + dc).alias("col"), row.alias("row")))
        nearest = F.least(*best)
        return nearest["col"], nearest["row"]
    return F.floor((x - ox) / tw), F.floor((y - oy) / th)


def rect_union(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """x, y, width, height; an empty rectangle adds nothing."""
    x, y = F.least(a[0], b[0]), F.least(a[1], b[1])
    both = (x, y, F.greatest(a[0] + a[2], b[0] + b[2]) - x, F.greatest(a[1] + a[3], b[1] + b[3]) - y)
    none = lambda r: (r[2] <= 0) | (r[3] <= 0)
    return tuple(F.when(none(a), q).when(none(b), p).otherwise(u) for p, q, u in zip(a, b, both, strict=True))


def rect_intersect(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    x, y = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    w, h = F.least(a[0] + a[2], b[0] + b[2]) - x, F.least(a[1] + a[3], b[1] + b[3]) - y
    return tuple(F.when((w <= 0) | (h <= 0), 0).otherwise(c) for c in (x, y, w, h))


def clamp_range(lo: Column, hi: Column, frames: Column) -> tuple[Column, Column]:
    last = F.greatest(F.lit(0), frames - 1)
    return tuple(F.least(F.greatest(c, F.lit(0)), last) for c in (F.least(lo, hi), F.greatest(lo, hi)))


def range_after_insert(lo: Column, hi: Column, at: Column) -> tuple[Column, Column]:
    return lo + (at <= lo).cast("int"), hi + (at <= hi + 1).cast("int")


def range_after_remove(lo: Column, hi: Column, at: Column, frames_after: Column) -> tuple[Column, Column]:
    last = F.greatest(F.lit(0), frames_after - 1)
    lo, hi = (F.least(F.greatest(c, F.lit(0)), last) for c in (lo - (at < lo).cast("int"), hi - (at <= hi).cast("int")))
    return F.least(lo, hi), hi


def target_size(side: Column, pixel: Column) -> Column:
    return F.greatest(F.lit(1), half_up(side / pixel))


def fit_rect(w: Column, h: Column, box_w: int, box_h: int) -> tuple[Column, ...]:
    """Largest placement of w x h inside the box, centred: x, y, width, height (doubles)."""
    scale = F.least(F.lit(float(box_w)) / w, F.lit(float(box_h)) / h)
    return (box_w - w * scale) / 2, (box_h - h * scale) / 2, w * scale, h * scale


def default_grid_offset(shape: Column, tile_width: Column, canvas_width: Column) -> tuple[Column, Column]:
    """Where a new grid starts: an isometric one in the middle of the top edge, as it grows both ways."""
    return F.when(shape == "isometric", F.floor(canvas_width / 2 - tile_width / 2 + 0.5)).otherwise(0).cast("int"), F.lit(0)


#: Colours of new tags, in turn.
TAG_COLORS = ("#4d9de0", "#e15554", "#3bb273", "#e1b12c", "#7768ae", "#e67e22")


def next_tag_color(existing: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TAG_COLORS)), (F.pmod(existing, F.lit(len(TAG_COLORS))) + 1).cast("int"))


def without_corners(points: Column) -> Column:
    """Points of a stroke (x, y) in order, without a point that only turns a corner between two diagonal neighbours.

    A removed point no longer counts for the next ones, so this is a fold; a point equal to the last is left out.
    """
    step = lambda p, q: F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"])

    def add(kept: Column, c: Column) -> Column:
        a, b = F.try_element_at(kept, F.lit(-2)), F.try_element_at(kept, F.lit(-1))
        diagonal = (F.abs(a["x"] - c["x"]) == 1) & (F.abs(a["y"] - c["y"]) == 1)
        corner = F.coalesce((F.size(kept) >= 2) & diagonal & (step(a, b) == 1) & (step(c, b) == 1), F.lit(False))
        same = F.coalesce((b["x"] == c["x"]) & (b["y"] == c["y"]), F.lit(False))
        return F.when(same, kept).when(corner, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), c)).otherwise(F.array_append(kept, c))

    return F.aggregate(points, F.array().cast("array<struct<x:int,y:int>>"), add)
