"""Operators on pixel relations: resampling, quantising, measuring, masks, outlines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import TO_LAB, TO_LMS, coarse_key, from_linear, half_up, to_linear, with_oklab
from rasterloom.operators import candidates

#: A candidate must be nearer than the best so far by more than this.
EPSILON = 1e-9
TRANSPARENT = 65535


def _cells(dst: int | Column, src: int | Column, name: str) -> Column:
    """All target cells that a source coordinate falls into (more than one only when dst > src); both sizes may differ by row."""
    last = dst - 1 if isinstance(dst, Column) else F.lit(dst - 1)
    start = lambda d: F.floor(d * src / dst)
    end = lambda d: F.greatest(start(d) + 1, F.floor((d + 1) * src / dst))
    # where dst <= src cells partition the source: the last cell whose start is not beyond
    guess = F.floor(F.col(name) * dst / src)
    one = F.array(F.when(start(guess + 1) <= F.col(name), guess + 1).otherwise(guess).cast("int"))
    many = F.filter(F.sequence(F.lit(0), last.cast("int")), lambda d: (start(d) <= F.col(name)) & (F.col(name) < end(d)))
    if isinstance(src, Column) or isinstance(dst, Column):
        return F.when(F.lit(src) >= F.lit(dst), one).otherwise(many)
    return one if dst <= src else many


Size = int | Column


def _dealt(px: DataFrame, w: Size, h: Size, dst_w: Size, dst_h: Size) -> DataFrame:
    return px.withColumn("cx", F.explode(_cells(dst_w, w, "x"))).withColumn("cy", F.explode(_cells(dst_h, h, "y")))


def box_downscale(px: DataFrame, w: Size, h: Size, dst_w: Size, dst_h: Size) -> DataFrame:
    """Mean in linear light weighted by alpha; alpha is the plain mean. Sums are of scaled integers, so order does not matter."""
    scaled = lambda c: (half_up(to_linear(F.col(c) / 255.0) * float(1 << 40)) * F.col("a")).cast("long")
    g = _dealt(px, w, h, dst_w, dst_h).groupBy("image_id", F.col("cy").alias("y"), F.col("cx").alias("x"))
    g = g.agg(*(F.sum(scaled(c)).alias(c) for c in "rgb"), F.sum("a").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = lambda c: F.when(F.col("s") > 0, half_up(from_linear(F.try_divide(F.col(c).cast("double"), F.col("s") * float(1 << 40))) * 255)).otherwise(0).cast("int").alias(c)
    return g.select("image_id", "y", "x", *map(mean, "rgb"), half_up(F.col("s") / F.col("n")).cast("int").alias("a"))


#: Fixed value: longest edge of a preview's stand-in.
PROXY_EDGE = 1024


def proxy_size(w: int, h: int, most: int = PROXY_EDGE) -> tuple[int, int]:
    """An image's size within the longest edge, its ratio kept; a smaller one stays."""
    if max(w, h) <= most:
        return w, h
    return max(1, int(w * (most / max(w, h)) + 0.5)), max(1, int(h * (most / max(w, h)) + 0.5))


def preview_proxy(px: DataFrame, w: int, h: int, most: int = PROXY_EDGE) -> DataFrame:
    """The images a preview works on: box means if an edge is too long, else the images themselves."""
    size = proxy_size(w, h, most)
    return px.select("image_id", "y", "x", "r", "g", "b", "a") if size == (w, h) else box_downscale(px, w, h, *size)


def _middles(dst: Size, src: Size, name: str) -> Column:
    """All target cells whose middle lies in a source coordinate: none, one, or more when dst > src."""
    at = F.col(name)
    some = F.sequence(F.greatest(F.lit(0), F.floor(at * dst / src) - 1).cast("int"), F.least(F.lit(dst) - 1, F.floor((at + 1) * dst / src) + 1).cast("int"))
    return F.filter(some, lambda c: F.floor((2 * c + 1) * src / (2 * dst)) == at)


def nearest_downscale(px: DataFrame, w: Size, h: Size, dst_w: Size, dst_h: Size) -> DataFrame:
    """The source pixel at the middle of each cell."""
    out = px.withColumn("_cx", F.explode(_middles(dst_w, w, "x"))).withColumn("_cy", F.explode(_middles(dst_h, h, "y")))
    return out.select("image_id", F.col("_cy").alias("y"), F.col("_cx").alias("x"), "r", "g", "b", "a")


def dominant_downscale(px: DataFrame, w: Size, h: Size, dst_w: Size, dst_h: Size) -> DataFrame:
    """The first pixel of each cell's commonest coarse colour (ties: lowest key); alpha is the mean of all."""
    cells = _dealt(px, w, h, dst_w, dst_h).select("image_id", "cy", "cx", F.struct((F.col("y") * w + F.col("x")).alias("p"), "r", "g", "b").alias("first"), coarse_key(F.col("r"), F.col("g"), F.col("b")).alias("key"), "a")
    buckets = cells.groupBy("image_id", "cy", "cx", F.when(F.col("a") > 0, F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("s"), F.min("first").alias("first"))
    rank = F.when(F.col("key").isNotNull(), F.struct(F.col("n"), (-F.col("key")).alias("k")))
    best = buckets.groupBy("image_id", F.col("cy").alias("y"), F.col("cx").alias("x")).agg(F.max_by("first", rank).alias("c"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return best.select("image_id", "y", "x", *(F.coalesce(F.col(f"c.{k}"), F.lit(0)).alias(k) for k in "rgb"), half_up(F.col("s") / F.col("n")).cast("int").alias("a"))


def resolve_alpha(a: Column, threshold: int = 128, preserve: bool = False) -> Column:
    return F.when(a < threshold, 0).otherwise(a if preserve else 255)


def lab_of(color: tuple[int, int, int]) -> tuple[float, float, float]:
    """Oklab of an 8-bit colour, on the driver (for palettes)."""
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in color]
    lms = [sum(m * x for m, x in zip(row, lin, strict=True)) for row in TO_LMS]
    return tuple(sum(m * (x ** (1 / 3)) for m, x in zip(row, lms, strict=True)) for row in TO_LAB)


def _index_of(palette: list[tuple[int, int, int]], space: str):
    """Arrow function (tone, shift) -> index of the nearest entry; each distinct pair of a batch is compared once, with the entries that can be nearest."""
    to_lms, to_lab = np.array(TO_LMS).T, np.array(TO_LAB).T
    entries = np.array([lab_of(c) for c in palette] if space == "oklab" else palette, np.float64)
    epsilon = EPSILON if space == "oklab" else 0.0
    lists = candidates.of(entries) if space == "oklab" and len(entries) >= candidates.WORTH else None

    def f(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tone, shift in batches:
            key = np.stack([tone.to_numpy(np.float64), shift.to_numpy(np.float64)])
            order = np.lexsort(key[::-1])
            new = np.ones(len(order), bool)
            new[1:] = (key[:, order[1:]] != key[:, order[:-1]]).any(0)
            t, s = key[0, order[new]].astype(np.int64), key[1, order[new]]
            c = np.stack([t >> 16, t >> 8 & 255, t & 255], 1).astype(np.float64)
            if space == "oklab":
                c = c / 255.0
                c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
                c = np.cbrt(c @ to_lms) @ to_lab
                c[:, 0] += s
            if lists is not None:
                best = lists.nearest(c)
            else:
                best, d = np.zeros(len(c), np.int32), np.full(len(c), np.inf)
                for i, e in enumerate(entries):
                    x = ((c - e) ** 2).sum(1)
                    nearer = x < d - epsilon
                    best[nearer], d[nearer] = i, x[nearer]
            out = np.empty(len(order), np.int32)
            out[order] = best[np.cumsum(new) - 1]
            yield pd.Series(out)

    return F.pandas_udf(f, "int")


def quantize(px: DataFrame, palette: list[tuple[int, int, int]], shift: Column | None = None, threshold: int = 128, preserve: bool = False, space: str = "oklab") -> DataFrame:
    """px with idx (65535 where transparent) and a resolved: one projection, nothing is shuffled.

    Distances are in Oklab, or with space "srgb" in 8-bit channels, where shifts do not count.
    """
    a = resolve_alpha(F.col("a"), threshold, preserve)
    tone = (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int")
    index = _index_of(palette, space)(tone, F.lit(0.0) if shift is None else shift.cast("double"))
    return px.withColumns({"idx": F.when(a == 0, TRANSPARENT).otherwise(index).cast("int"), "a": a.cast("int")})


def quantize_own(px: DataFrame, palettes: DataFrame, n: int = 0, strength: float = 1.0, threshold: int = 128, preserve: bool = False, space: str = "oklab") -> DataFrame:
    """As quantize(), or for n > 0 as quantize_ordered(), with a palette of each image's own (image_id, i, r, g, b).

    A palette is an array in its image's row; only distinct colours of an image meet it.
    """
    axes = tuple(f"lab_{k}" for k in "lab") if space == "oklab" else ("r", "g", "b")
    entry = F.struct("i", *(F.col(c).cast("double").alias(k) for c, k in zip(axes, "lab", strict=True)))
    pal = with_oklab(palettes).groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("_pal"))
    apart = lambda p, q: sum(((p[k] - q[k]) * (p[k] - q[k]) for k in "lab"), F.lit(0.0))
    nearest_other = F.transform("_pal", lambda p: F.sqrt(F.array_min(F.transform(F.filter("_pal", lambda q: q["i"] != p["i"]), lambda q: apart(p, q)))))
    spread = F.when(F.size("_pal") < 2, 0.0).otherwise(F.aggregate(nearest_other, F.lit(0.0), lambda x, y: x + y) / F.size("_pal"))
    pal = pal.withColumn("_spread", spread if n else F.lit(0.0))
    shift = ((bayer(F.col("x"), F.col("y"), n) + 0.5) / float(n * n) - 0.5) * strength if n else F.lit(0.0)
    rows = px.withColumns({"_a": resolve_alpha(F.col("a"), threshold, preserve), "_shift": shift, "_c": F.col("r") * 65536 + F.col("g") * 256 + F.col("b")})
    tones = rows.where("_a > 0").select("image_id", "_c", "_shift", "r", "g", "b").distinct().join(pal, "image_id")
    tones = with_oklab(tones).withColumn("lab_l", F.col("lab_l") + F.col("_shift") * F.col("_spread"))

    def step(best: Column, e: Column) -> Column:
        d = reduce(lambda x, y: x + y, ((F.col(c) - e[k]) * (F.col(c) - e[k]) for c, k in zip(axes, "lab", strict=True)))
        return F.when(d < best["d"] - (EPSILON if space == "oklab" else 0.0), F.struct(d.alias("d"), e["i"].alias("i"))).otherwise(best)

    index = F.aggregate("_pal", F.struct(F.lit(float("inf")).alias("d"), F.lit(0).alias("i")), step, lambda best: best["i"])
    out = rows.join(tones.select("image_id", "_c", "_shift", index.alias("_i")), ["image_id", "_c", "_shift"], "left")
    return out.withColumn("idx", F.when(F.col("_a") == 0, TRANSPARENT).otherwise(F.col("_i")).cast("int")).withColumn("a", F.col("_a").cast("int")).drop("_a", "_shift", "_c", "_i")


def bayer(x: Column, y: Column, n: int) -> Column:
    """Entry of the n x n Bayer matrix: the bits of x xor y and y, interleaved from the lowest up."""
    out, bits = F.lit(0), n.bit_length() - 1
    for k in range(bits):
        bx, by = F.shiftright(x, k).bitwiseAND(F.lit(1)), F.shiftright(y, k).bitwiseAND(F.lit(1))
        out = out + (bx.bitwiseXOR(by) * 2 + by) * (4 ** (bits - 1 - k))
    return out


def palette_spread(palette: list[tuple[int, int, int]]) -> float:
    """Mean distance of each colour to its nearest other."""
    labs = [lab_of(c) for c in palette]
    if len(labs) < 2:
        return 0.0
    near = [min(sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) for j, b in enumerate(labs) if j != i) for i, a in enumerate(labs)]
    return sum(d**0.5 for d in near) / len(near)


def quantize_ordered(px: DataFrame, palette: list[tuple[int, int, int]], n: int, strength: float = 1.0, **alpha: int | bool) -> DataFrame:
    threshold = (bayer(F.col("x"), F.col("y"), n) + 0.5) / float(n * n) - 0.5
    return quantize(px, palette, threshold * (strength * palette_spread(palette)), **alpha)


def row_window(r: int) -> Window:
    return Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-r, r)


def column_window(r: int) -> Window:
    return Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-r, r)


def dilate(px: DataFrame, c: str = "a") -> DataFrame:
    return px.withColumn(c, F.greatest(F.max(c).over(row_window(1)), F.max(c).over(column_window(1))))


def erode(px: DataFrame, c: str = "a") -> DataFrame:
    return px.withColumn(c, F.least(F.min(c).over(row_window(1)), F.min(c).over(column_window(1))))


def _diamond(px: DataFrame, radius: int, c: str, most: bool) -> DataFrame:
    """The largest (or smallest) value within so many steps to a side: that of each row's reach, which shrinks by a pixel a row, over the rows around.

    Two shuffles, whatever the radius: the reaches of all lengths are windows over the same sorted rows.
    """
    best = F.max if most else F.min
    px = px.withColumns({f"_r{k}": best(c).over(row_window(k)) for k in range(radius + 1)})
    column = Window.partitionBy("image_id", "x").orderBy("y")
    far = [F.col(f"_r{radius}"), *(side(f"_r{radius - d}", d).over(column) for d in range(1, radius + 1) for side in (F.lag, F.lead))]
    return px.withColumn(c, (F.greatest if most else F.least)(*far) if radius else F.col("_r0")).drop(*(f"_r{k}" for k in range(radius + 1)))


def close(px: DataFrame, radius: int, c: str = "a") -> DataFrame:
    """So many dilations, then as many erosions; outside the image there is nothing to grow from or to eat in from."""
    return _diamond(_diamond(px, radius, c, True), radius, c, False) if radius > 0 else px


def post_process(px: DataFrame, threshold: int | None, close_by: int, feather_by: int) -> DataFrame:
    """A mask's alpha made all or nothing, its holes closed, its edge softened: each step only if asked for."""
    if threshold is not None:
        px = px.withColumn("a", F.when(F.col("a") < threshold, 0).otherwise(255).cast("int"))
    px = close(px, close_by)
    return feather(px, feather_by) if feather_by > 0 else px


def feather(px: DataFrame, radius: int, c: str = "a") -> DataFrame:
    px = px.withColumn(c, half_up(F.avg(c).over(row_window(radius))).cast("int"))
    return px.withColumn(c, half_up(F.avg(c).over(column_window(radius))).cast("int"))


def nearest_of(color: tuple[int, int, int], palette: list[tuple[int, int, int]]) -> int:
    """Index of the entry nearest to a colour in Oklab, on the driver."""
    lab, best = lab_of(color), (float("inf"), 0)
    for i, c in enumerate(palette):
        d = sum((p - q) ** 2 for p, q in zip(lab, lab_of(c), strict=True))
        best = (d, i) if d < best[0] - EPSILON else best
    return best[1]


def nearest_entry(palettes: DataFrame, color: tuple[int, int, int]) -> DataFrame:
    """image_id, i of the entry nearest to one colour in each image's palette (image_id, i, r, g, b)."""
    pal = with_oklab(palettes)
    d = reduce(lambda x, y: x + y, ((F.col(f"lab_{k}") - v) * (F.col(f"lab_{k}") - v) for k, v in zip("lab", lab_of(color), strict=True)))
    entries = pal.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", d.alias("d")))).alias("e"))
    best = F.aggregate("e", F.struct(F.lit(float("inf")).alias("d"), F.lit(0).alias("i")), lambda b, e: F.when(e["d"] < b["d"] - EPSILON, F.struct(e["d"].alias("d"), e["i"].alias("i"))).otherwise(b), lambda b: b["i"])
    return entries.select("image_id", best.alias("i"))


def outlined(idx: DataFrame, color: Column, alpha: int, thickness: int = 1, corners: bool = False) -> DataFrame:
    """(image_id, y, x, idx, a) with so many rings of a palette index in transparent space, at the given alpha."""
    out = idx.withColumns({"_was": F.col("idx"), "_color": color})
    for _ in range(max(0, thickness)):
        out = outline(out, F.col("_color"), corners)
    new = (F.col("_was") == TRANSPARENT) & (F.col("idx") != TRANSPARENT)
    return out.withColumn("a", F.when(new, alpha).otherwise(F.col("a")).cast("int")).drop("_was", "_color")


def outline(idx: DataFrame, color: int | Column, corners: bool = False) -> DataFrame:
    """One ring of color around what is not transparent."""
    full = (F.col("idx") != TRANSPARENT).cast("int")
    rows, cols = F.max(full).over(row_window(1)), F.max(full).over(column_window(1))
    near = idx.withColumns({"_row": rows, "_col": cols})
    touched = F.greatest("_row", "_col")
    if corners:
        touched = F.max("_row").over(column_window(1))
    return near.withColumn("idx", F.when((F.col("idx") == TRANSPARENT) & (touched == 1), color).otherwise(F.col("idx"))).drop("_row", "_col")


def opaque_bounds(px: DataFrame, threshold: int = 128) -> DataFrame:
    b = px.where(F.col("a") >= threshold).groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return b.select("image_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"))


#: Fixed values of grid detection: fewest edges of a period, least confidence, share of the best that is as good.
EDGES, CONFIDENT, AS_GOOD = 6, 3.0, 0.75


def axis_period(px: DataFrame, axis: str, least: int = 2, most: int = 64) -> DataFrame:
    """image_id, period, confidence along x or y: the smallest period whose edges stand out nearly as much as the best's.

    The signal of a place is the sum of the differences of all four channels to the place before.
    """
    across = {"x": "y", "y": "x"}[axis]
    w = Window.partitionBy("image_id", across).orderBy(axis)
    diff = reduce(lambda p, q: p + q, (F.abs(F.col(c) - F.lag(c).over(w)) for c in "rgba"))
    s = px.withColumn("_d", diff).groupBy("image_id", F.col(axis).alias("at")).agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("diff"))
    one = Window.partitionBy("image_id")
    s = s.withColumns({"size": F.max("at").over(one) + 1, "mean": F.avg(F.when(F.col("at") > 0, F.col("diff"))).over(one)}).where("at > 0 AND mean > 0")
    longest = F.least(F.lit(most), F.floor((F.col("size") - 1) / 2)).cast("int")
    p = s.where(longest >= least).withColumn("period", F.explode(F.sequence(F.lit(least), longest))).where(F.col("at") % F.col("period") == 0)
    p = p.groupBy("image_id", "period").agg((F.avg("diff") / F.first("mean")).alias("confidence"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= EDGES)
    p = p.withColumn("best", F.max("confidence").over(one)).where((F.col("best") >= CONFIDENT) & (F.col("confidence") >= AS_GOOD * F.col("best")))
    return p.groupBy("image_id").agg(F.min("period").alias("period"), F.min_by("confidence", "period").alias("confidence"))


def detect_grid(px: DataFrame, least: int = 2, most: int = 64) -> DataFrame:
    """image_id, period, agreement: both axes' period if they agree, else the more confident one's (columns if equal), or the only one's."""
    x, y = (axis_period(px, a, least, most).select("image_id", F.col("period").alias(f"p{a}"), F.col("confidence").alias(f"c{a}")) for a in "xy")
    both = x.join(y, "image_id", "full_outer")
    period = F.when(F.col("py").isNull() | (F.col("cx") >= F.col("cy")), F.col("px")).otherwise(F.col("py"))
    return both.select("image_id", period.alias("period"), F.coalesce(F.col("px") == F.col("py"), F.lit(False)).alias("agreement"))
