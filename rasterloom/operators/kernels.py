"""Sequential operators, one image at a time: flood fill, despeckling, error diffusion, automatic palettes.

An image is a group of bounded size (64 x 64 here); images are spread over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import FROM_LAB, FROM_LMS, TO_LAB, TO_LMS
from rasterloom.operators import candidates
from rasterloom.operators.raster import EPSILON, TRANSPARENT, lab_of


def oklab(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255.0
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    return np.cbrt(c @ np.array(TO_LMS).T) @ np.array(TO_LAB).T


def _grid(pdf: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the pixels, their values as an image, and where there is a pixel."""
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    out = np.zeros((y.max() + 1, x.max() + 1, len(columns)), pdf[columns].to_numpy().dtype)
    has = np.zeros(out.shape[:2], bool)
    out[y, x], has[y, x] = pdf[columns].to_numpy(), True
    return y, x, out, has


def reach(allowed: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """Pixels reachable from seed through allowed ones, by four neighbours."""
    label = components(allowed, allowed)
    return label == label[seed] if allowed[seed] else np.zeros_like(allowed)


def without_background(img: np.ndarray, has: np.ndarray, tolerance: float) -> np.ndarray:
    """What is reached from the four corners through colours within tolerance of the corner's."""
    lab = oklab(img)
    gone = np.zeros(has.shape, bool)
    h, w = has.shape
    for seed in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)):
        if gone[seed] or not has[seed]:
            continue
        near = ((lab - lab[seed]) ** 2).sum(2) <= tolerance * tolerance + EPSILON
        gone |= reach(near & has & ~gone, seed)
    return gone


def remove_background(px: DataFrame, tolerance: float) -> DataFrame:
    """Alpha 0 for the background within tolerance of the corners' colours."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, img, has = _grid(pdf, ["r", "g", "b"])
        return pdf.assign(a=np.where(without_background(img, has, tolerance)[y, x], 0, pdf["a"]))

    return px.groupBy("image_id").applyInPandas(f, px.schema)


def _shifted(a: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = a[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def processed_mask(a: np.ndarray, threshold: int | None, close_by: int, feather_by: int) -> np.ndarray:
    """As raster.post_process(), for one image's alpha as an array."""
    if threshold is not None:
        a = np.where(a < threshold, 0, 255)
    for best, outside in ((np.maximum, 0), (np.minimum, 255)):
        for _ in range(close_by):
            a = best.reduce([a, *(_shifted(a, dy, dx, outside) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)))])
    for axis in (1, 0):
        if feather_by > 0:
            n = a.shape[axis]
            sums = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis)], axis)
            lo, hi = np.maximum(np.arange(n) - feather_by, 0), np.minimum(np.arange(n) + feather_by, n - 1) + 1
            size = (hi - lo).reshape((1, -1) if axis else (-1, 1))
            a = np.floor((sums.take(hi, axis) - sums.take(lo, axis)) / size + 0.5).astype(a.dtype)
    return a


def cut_out(px: DataFrame, tolerance: str, threshold: str, close_by: str, feather_by: str) -> DataFrame:
    """Backgrounds removed and masks processed, by columns that are the same over an image."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, img, has = _grid(pdf, ["r", "g", "b", "a"])
        one = pdf.iloc[0]
        a = np.where(without_background(img[..., :3], has, float(one[tolerance])), 0, img[..., 3])
        a = processed_mask(a, None if pd.isna(one[threshold]) else int(one[threshold]), int(one[close_by]), int(one[feather_by]))
        return pdf.assign(a=a[y, x].astype(pdf["a"].dtype))

    return px.groupBy("image_id").applyInPandas(f, px.schema)


def components(value: np.ndarray, has: np.ndarray) -> np.ndarray:
    """A label for each pixel: the smallest place of its four-connected component of equal values; -1 where there is none."""
    h, w = value.shape
    place = np.arange(h * w).reshape(h, w)
    across = has[:, 1:] & has[:, :-1] & (value[:, 1:] == value[:, :-1])
    down = has[1:] & has[:-1] & (value[1:] == value[:-1])
    a = np.concatenate([place[:, 1:][across], place[1:][down]])
    b = np.concatenate([place[:, :-1][across], place[:-1][down]])
    label = np.arange(h * w)
    while True:  # roots hook to smaller roots, then paths are halved: few rounds whatever the shapes
        p, q = label[a], label[b]
        open_ = p != q
        if not open_.any():
            break
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    return np.where(has, label.reshape(h, w), -1)


def despeckle(idx: DataFrame, area: int | str) -> DataFrame:
    """Components of equal idx with at most area pixels take the commonest idx around them (ties: lowest) of the original; area may be a column that is the same over an image."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, img, has = _grid(pdf, ["idx"])
        img = img[..., 0]
        label = components(img, has)
        size = np.bincount(label[has], minlength=label.size)
        small = has & (size[label] <= (pdf[area].iloc[0] if isinstance(area, str) else area))
        # pairs (component, idx of a neighbour outside it), one for each pixel side
        of, value = [], []
        for p, q in (((slice(None), slice(1, None)), (slice(None), slice(None, -1))), ((slice(1, None),), (slice(None, -1),))):
            for s, t in ((p, q), (q, p)):
                met = small[s] & has[t] & (img[s] != img[t])
                of.append(label[s][met]), value.append(img[t][met])
        of, value = np.concatenate(of), np.concatenate(value)
        if len(of):
            pair, times = np.unique(np.stack([of, value], 1), axis=0, return_counts=True)
            order = np.lexsort((pair[:, 1], -times, pair[:, 0]))
            first = np.concatenate([[True], np.diff(pair[order, 0]) > 0])
            new = np.full(label.size, -1, np.int64)
            new[pair[order, 0][first]] = pair[order, 1][first]
            img = np.where(small & (new[label] >= 0), new[label], img)
        return pdf.assign(idx=img[y, x].astype(pdf["idx"].dtype))

    return idx.groupBy("image_id").applyInPandas(f, idx.schema)


#: (right, down, share of the error) and whether odd rows run backwards.
DIFFUSION = {
    "floyd-steinberg": ([(1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16)], True),
    "atkinson": ([(1, 0, 1 / 8), (2, 0, 1 / 8), (-1, 1, 1 / 8), (0, 1, 1 / 8), (1, 1, 1 / 8), (0, 2, 1 / 8)], False),
}


#: Comparisons of an image from which on it pays to make a palette's lists.
LISTS_FROM = 200_000


def diffused(pdf: pd.DataFrame, labs: np.ndarray, kernel: str, strength: float, threshold: int) -> pd.DataFrame:
    """A pixel's colour hangs on all before it, so the pass is one of plain numbers, row by row; margins take what leaves the image."""
    terms, turns = DIFFUSION[kernel]
    y, x, img, has = _grid(pdf, ["r", "g", "b", "a"])
    h, w = has.shape
    pad = max(abs(dx) for dx, _, _ in terms)
    depth = max(dy for _, dy, _ in terms)
    lab = np.zeros((3, h + depth, w + 2 * pad))
    lab[:, :h, pad : pad + w] = np.moveaxis(oklab(img[..., :3]), 2, 0)
    ahead = [[channel[i].tolist() for channel in lab] for i in range(depth + 1)]
    shown = has & (img[..., 3] >= threshold)
    entries, out = [(k, *map(float, e)) for k, e in enumerate(labs)], np.full((h, w + 2 * pad), TRANSPARENT)
    lists = candidates.of(labs) if len(labs) >= candidates.WORTH and len(labs) * h * w >= LISTS_FROM else None
    held: dict[int, list] = {}
    side, (low0, low1, low2), (step0, step1, step2) = candidates.SIDE, candidates.LOW.tolist(), candidates.STEP.tolist()
    for i in range(h):
        step = -1 if turns and i % 2 else 1
        l, p, q = ahead[0]
        spread = [(*ahead[dy], dx * step, share) for dx, dy, share in terms]
        row = out[i].tolist()
        for j in (np.flatnonzero(shown[i]) + pad).tolist()[::step]:
            l0, p0, q0, best, least = l[j], p[j], q[j], None, math.inf
            among = entries
            if lists:
                x0, x1, x2 = (l0 - low0) / step0, (p0 - low1) / step1, (q0 - low2) / step2
                if 0 <= x0 < side and 0 <= x1 < side and 0 <= x2 < side:
                    cell = (int(x0) * side + int(x1)) * side + int(x2)
                    among = held.get(cell)
                    if among is None:
                        among = held[cell] = [entries[k] for k in lists.members[lists.first[cell] : lists.first[cell + 1]]]
            for e in among:
                d = e[1] - l0
                d *= d
                if d < least:
                    u, v = e[2] - p0, e[3] - q0
                    d += u * u
                    d += v * v
                    if d < least - EPSILON:
                        best, least = e, d
            k, u, v, d = best
            row[j] = k
            u, v, d = (l0 - u) * strength, (p0 - v) * strength, (q0 - d) * strength
            for ls, ps, qs, dx, share in spread:
                ls[j + dx] += u * share
                ps[j + dx] += v * share
                qs[j + dx] += d * share
        out[i] = row
        ahead = [*ahead[1:], [channel[i + depth + 1].tolist() for channel in lab] if i + 1 < h else []]
    return pdf[["image_id", "y", "x"]].assign(idx=out[y, x + pad].astype("int32"))


#: Images that are diffused together, at most so many and so many pixels; fewer than FEW go one by one.
TOGETHER, PIXELS_TOGETHER, FEW = 64, 1 << 21, 12


def diffused_together(pdf: pd.DataFrame, labs: np.ndarray, kernel: str, strength: float, threshold: int) -> pd.DataFrame:
    """As diffused(), for the images of a frame at once: each place is one step of arrays along the images.

    Smaller images are filled up with places that show nothing and pass nothing on, so they change nothing.
    """
    ids, of = np.unique(pdf["image_id"].to_numpy(), return_inverse=True)
    if len(ids) < FEW:
        return pd.concat([diffused(own, labs, kernel, strength, threshold) for _, own in pdf.groupby("image_id")])
    terms, turns = DIFFUSION[kernel]
    pad, depth = max(abs(dx) for dx, _, _ in terms), max(dy for _, dy, _ in terms)
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy() + pad
    h, w = int(y.max()) + 1, int(x.max()) + 1 + pad
    lab, shown, out = np.zeros((h + depth, w, 3, len(ids))), np.zeros((h, w, len(ids)), bool), np.full((h, w, len(ids)), TRANSPARENT, np.int32)
    lab[y, x, :, of] = oklab(pdf[["r", "g", "b"]].to_numpy())
    shown[y, x, of] = pdf["a"].to_numpy() >= threshold
    entries, each = labs.T[:, :, None], np.arange(len(ids))
    for i in range(h):
        step = -1 if turns and i % 2 else 1
        for j in np.flatnonzero(shown[i].any(1))[::step]:
            here, on = lab[i, j], shown[i, j]
            d = (entries[0] - here[0]) ** 2
            d += (entries[1] - here[1]) ** 2
            d += (entries[2] - here[2]) ** 2
            best = d.argmin(0)
            equal = np.flatnonzero((d <= d[best, each] + 2 * EPSILON).sum(0) > 1)
            if len(equal):  # as good as equally near: entry by entry
                best[equal] = candidates.plain_nearest(here[:, equal].T, labs)
            out[i, j, on] = best[on]
            error = (here - labs.T[:, best]) * strength * on
            for dx, dy, share in terms:
                lab[i + dy, j + dx * step] += error * share
    return pdf[["image_id", "y", "x"]].assign(idx=out[y, x, of])


def diffuse(px: DataFrame, palette: list[tuple[int, int, int]], kernel: str, strength: float = 1.0, threshold: int = 128) -> DataFrame:
    """Quantise with error diffusion in Oklab; transparent pixels pass nothing on.

    A pixel hangs on all before it in its image, so images go together: as many as PIXELS_TOGETHER allow.
    """
    labs = np.array([lab_of(c) for c in palette])
    fit = F.greatest(F.lit(1.0), F.least(F.lit(float(TOGETHER)), PIXELS_TOGETHER / F.count(F.lit(1))))
    sizes = px.groupBy("image_id").agg(F.pow(F.lit(2.0), F.floor(F.log2(fit))).cast("int").alias("_fit"))
    many = {r["_fit"]: r["n"] for r in sizes.groupBy("_fit").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per power of two
    groups = F.coalesce(*(F.when(F.col("_fit") == fit, -(-n // fit)) for fit, n in many.items()), F.lit(1))
    spark = px.sparkSession
    # a set number of tasks: by their few bytes Spark would put many groups, which are slow, into one
    tasks = max(1, min(sum(-(-n // fit) for fit, n in many.items()), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    dealt = px.join(sizes, "image_id").withColumn("_group", F.pmod(F.xxhash64("image_id"), groups)).repartition(tasks, "_fit", "_group")
    return dealt.groupBy("_fit", "_group").applyInPandas(lambda pdf: diffused_together(pdf, labs, kernel, strength, threshold), "image_id long, y int, x int, idx int")


def diffuse_own(px: DataFrame, palettes: DataFrame, kernel: str, strength: float = 1.0, threshold: int = 128) -> DataFrame:
    """As diffuse(), with a palette of each image's own (image_id, i, r, g, b)."""

    def f(pdf: pd.DataFrame, pal: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("image_id", "y", "x", "idx")})
        labs = np.array([lab_of(c) for c in pal.sort_values("i")[["r", "g", "b"]].itertuples(index=False)]).reshape(-1, 3)
        return diffused(pdf, labs if len(labs) else np.zeros((1, 3)), kernel, strength, threshold)

    return px.groupBy("image_id").cogroup(palettes.groupBy("image_id")).applyInPandas(f, "image_id long, y int, x int, idx int")


def _boxes(rgb: np.ndarray, n: np.ndarray, most: int) -> list[np.ndarray]:
    """Mean colours (rounded) of at most `most` boxes of the 5-bit colour cube.

    The box of the largest weighted variance is cut in two where the halves' means hold most
    of its squares; one that cannot be cut is left as it is. Ties go to the earlier box, axis
    and place. A box is the set of its occupied cells, a row each of weight, sums and squares.
    """
    cell, of = np.unique((rgb >> 3) @ np.array([1024, 32, 1]), return_inverse=True)
    sums = np.stack([np.bincount(of, n * v, len(cell)) for v in (np.ones(len(rgb)), *rgb.T, (rgb**2).sum(1))], 1)
    place = np.stack([cell >> 10, cell >> 5 & 31, cell & 31])

    def variance(own: np.ndarray) -> float:
        w, r, g, b, squares = sums[own].sum(0)
        return squares - (r * r + g * g + b * b) / w

    def held(t: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (t[:, 1] * t[:, 1] + t[:, 2] * t[:, 2] + t[:, 3] * t[:, 3]) / t[:, 0]

    boxes = [np.arange(len(cell))]
    spread = [variance(boxes[0])]
    while len(boxes) < most and max(spread) > 0:
        k = int(np.argmax(spread))
        own, best = boxes[k], (0.0, None)
        for axis in place:
            below = np.cumsum(np.stack([np.bincount(axis[own], sums[own, c], 32) for c in range(4)], 1), 0)[:-1]
            above = sums[own, :4].sum(0) - below
            gain = np.where((below[:, 0] > 0) & (above[:, 0] > 0), held(below) + held(above), 0.0)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], axis[own] <= at)
        if best[1] is None:
            spread[k] = 0.0
            continue
        boxes[k], new = own[best[1]], own[~best[1]]
        boxes.append(new)
        spread[k] = variance(boxes[k])
        spread.append(variance(new))
    return [np.floor(sums[own, 1:4].sum(0) / sums[own, 0].sum() + 0.5) for own in boxes]


def _nearest(lab: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of each colour's nearest entry; a later one must be nearer by more than EPSILON."""
    best, d = np.zeros(len(lab), np.int64), ((lab - entries[0]) ** 2).sum(1)
    for k in range(1, len(entries)):
        e = ((lab - entries[k]) ** 2).sum(1)
        nearer = e < d - EPSILON
        best[nearer], d[nearer] = k, e[nearer]
    return best


def srgb(lab: np.ndarray) -> np.ndarray:
    """8-bit colours of Oklab, clamped in linear light."""
    lin = np.clip(((lab @ np.array(FROM_LAB).T) ** 3) @ np.array(FROM_LMS).T, 0, 1)
    out = np.where(lin <= 0.0031308, lin * 12.92, 1.055 * lin ** (1 / 2.4) - 0.055)
    return np.floor(out * 255 + 0.5).astype(np.int64)


def palette_of(rgb: np.ndarray, n: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """At most size colours for distinct colours (sorted) with counts: these if they are few enough, else boxes refined by k-means in Oklab."""
    if not len(rgb):
        return np.zeros((1, 3), np.int64)
    if len(rgb) <= size:
        return rgb
    lab, middle = oklab(rgb), oklab(np.array(_boxes(rgb, n, size)))
    for _ in range(rounds):
        own = _nearest(lab, middle)
        w = np.bincount(own, n, len(middle))
        new = np.stack([np.bincount(own, n * lab[:, c], len(middle)) for c in range(3)], 1)
        new = np.where(w[:, None] > 0, new / np.maximum(w, 1)[:, None], middle)
        if (new == middle).all():
            break
        middle = new
    return np.unique(srgb(middle), axis=0)


def auto_palette(px: DataFrame, size: int | str, rounds: int = 8, threshold: int | Column = 128) -> DataFrame:
    """At most size colours (image_id, i, r, g, b) per image, sorted, from its distinct opaque colours and their counts; black where none is opaque.

    size may be a column that is the same over an image.
    """
    if not isinstance(size, str) and size < 1:
        raise ValueError(f"a palette has at least one colour, not {size}")
    tone = F.when(F.col("a") >= threshold, F.col("r") * 65536 + F.col("g") * 256 + F.col("b"))
    most = F.col(size) if isinstance(size, str) else F.lit(size)
    tones = px.groupBy("image_id", tone.cast("int").alias("tone")).agg(F.count(F.lit(1)).alias("n"), F.first(most).alias("most"))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset="tone").sort_values("tone")
        t = own["tone"].to_numpy(np.int64)
        c = palette_of(np.stack([t >> 16, t >> 8 & 255, t & 255], 1), own["n"].to_numpy(np.float64), int(pdf["most"].iloc[0]), rounds).astype(np.int32)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "i": np.arange(len(c), dtype=np.int32), "r": c[:, 0], "g": c[:, 1], "b": c[:, 2]})

    return tones.groupBy("image_id").applyInPandas(f, "image_id long, i int, r int, g int, b int")


def wand(px: DataFrame, seed_x: int, seed_y: int) -> DataFrame:
    """image_id, y, x of the pixels that are reached from the seed through pixels of exactly its colour."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, image, has = _grid(pdf, ["r", "g", "b", "a"])
        if not (0 <= seed_y < has.shape[0] and 0 <= seed_x < has.shape[1] and has[seed_y, seed_x]):
            return pdf.iloc[:0][["image_id", "y", "x"]]
        y, x = np.nonzero(reach(has & (image == image[seed_y, seed_x]).all(-1), (seed_y, seed_x)))
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y, "x": x})

    return px.groupBy("image_id").applyInPandas(f, "image_id long, y int, x int")


def fill(px: DataFrame, seed_x: int, seed_y: int, color: tuple[int, int, int, int]) -> DataFrame:
    """px with the wand's pixels in the colour."""
    them = wand(px, seed_x, seed_y).withColumn("_in", F.lit(True))
    new = {n: F.when(F.col("_in"), F.lit(v)).otherwise(F.col(n)).cast("int") for n, v in zip("rgba", color, strict=True)}
    return px.join(them, ["image_id", "y", "x"], "left").withColumns(new).drop("_in")


#: Fixed value: largest difference of a channel between similar pixels.
SIMILAR = 0.392157 * 255


def clean_edge(px: DataFrame, width: int, height: int, angle: float, scale: float) -> DataFrame:
    """Rotation and scaling about the middle that keeps the source's colours; the canvas keeps its size.

    A target place reads the source pixel nearest to its point in the source. If the two
    neighbours toward that point are alike, the one on the longer side replaces it, unless
    the pixel itself goes on in the diagonal one, or both sides are equal. Outside is empty.
    """
    cos, sin, names = math.cos(angle), math.sin(angle), ["r", "g", "b", "a"]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width, 4), np.int64)
        image[pdf["y"], pdf["x"]] = pdf[names].to_numpy()
        y, x = (c.ravel() for c in np.mgrid[:height, :width])
        dx, dy = x - width / 2, y - height / 2
        sx, sy = width / 2 + (dx * cos - dy * sin) / scale, height / 2 + (dx * sin + dy * cos) / scale
        nx, ny = np.floor(sx + 0.5).astype(np.int64), np.floor(sy + 0.5).astype(np.int64)
        lx, ly = sx - nx, sy - ny
        qx, qy = nx + np.where(lx >= 0, 1, -1), ny + np.where(ly >= 0, 1, -1)

        def at(v: np.ndarray, u: np.ndarray) -> np.ndarray:
            inside = (v >= 0) & (v < height) & (u >= 0) & (u < width)
            return image[np.clip(v, 0, height - 1), np.clip(u, 0, width - 1)] * inside[:, None]

        def alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (np.abs(p - q) <= SIMILAR).all(1) | ((p[:, 3] == 0) & (q[:, 3] == 0))

        own, along, across, corner = at(ny, nx), at(ny, qx), at(qy, nx), at(qy, qx)
        diagonal = ~alike(own, along) & ~alike(own, across) & alike(own, corner)
        sliced = alike(along, across) & ~diagonal & (np.abs(lx) != np.abs(ly))
        out = np.where(sliced[:, None], np.where((np.abs(lx) > np.abs(ly))[:, None], along, across), own)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y, "x": x} | dict(zip(names, out.T, strict=True)))

    return px.groupBy("image_id").applyInPandas(f, "image_id long, y int, x int, r int, g int, b int, a int")
