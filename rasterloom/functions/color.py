"""Colour functions on columns; channels are 0 to 255, colours in between are doubles."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]

# The published matrices between linear sRGB, cone responses and Oklab.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
# Simulation matrices of three kinds of colour vision.
VISION = {
    "protanopia": ((0.567, 0.433, 0.0), (0.558, 0.442, 0.0), (0.0, 0.242, 0.758)),
    "deuteranopia": ((0.625, 0.375, 0.0), (0.7, 0.3, 0.0), (0.0, 0.3, 0.7)),
    "tritanopia": ((0.95, 0.05, 0.0), (0.0, 0.433, 0.567), (0.0, 0.475, 0.525)),
}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def product(m: tuple, v: RGB) -> RGB:
    return tuple(F.lit(r[0]) * v[0] + F.lit(r[1]) * v[1] + F.lit(r[2]) * v[2] for r in m)


def to_linear(c: Column) -> Column:
    """0..1 sRGB -> linear."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def from_linear(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.lit(1.055) * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def with_oklab(rows: DataFrame) -> DataFrame:
    """rows (r, g, b) with lab_l, lab_a, lab_b.

    Each step is a projection of its own, so that every value is computed once: written
    as one expression, a channel's linear value would be repeated for each use of it.
    """
    rows = rows.withColumns({f"_l{c}": to_linear(F.col(c) / 255.0) for c in "rgb"})
    rows = rows.withColumns({f"_c{i}": F.cbrt(e) for i, e in enumerate(product(TO_LMS, tuple(F.col(f"_l{c}") for c in "rgb")))})
    lab = product(TO_LAB, tuple(F.col(f"_c{i}") for i in range(3)))
    return rows.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), lab, strict=True))).drop(*(f"_l{c}" for c in "rgb"), *(f"_c{i}" for i in range(3)))


def with_srgb(rows: DataFrame) -> DataFrame:
    """rows (lab_l, lab_a, lab_b) with 8-bit r, g, b; clamped in linear light, before encoding."""
    rows = rows.withColumns({f"_c{i}": e for i, e in enumerate(product(FROM_LAB, tuple(F.col(f"lab_{k}") for k in "lab")))})
    rows = rows.withColumns({f"_c{i}": F.col(f"_c{i}") * F.col(f"_c{i}") * F.col(f"_c{i}") for i in range(3)})
    rows = rows.withColumns({f"_l{c}": clamp(e, 0.0, 1.0) for c, e in zip("rgb", product(FROM_LMS, tuple(F.col(f"_c{i}") for i in range(3))), strict=True)})
    rows = rows.withColumns({c: half_up(from_linear(F.col(f"_l{c}")) * 255).cast("int") for c in "rgb"})
    return rows.drop(*(f"_l{c}" for c in "rgb"), *(f"_c{i}" for i in range(3)))


def adjust(lab: RGB, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0, hue: float = 0.0) -> RGB:
    """Brightness, contrast, saturation, then hue in degrees."""
    import math

    l, a, b = lab
    l = (l * (1 + brightness) - 0.5) * (1 + contrast) + 0.5
    a, b = a * (1 + saturation), b * (1 + saturation)
    if hue:
        c, s = math.cos(math.radians(hue)), math.sin(math.radians(hue))
        a, b = a * c - b * s, a * s + b * c
    return l, a, b


def adjust_image(px: DataFrame, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0, hue: float = 0.0) -> DataFrame:
    """Adjusted pixels; with nothing to adjust px itself, without a round trip."""
    if not (brightness or contrast or saturation or hue):
        return px
    lab = with_oklab(px)
    done = adjust(tuple(F.col(f"lab_{k}") for k in "lab"), brightness, contrast, saturation, hue)
    return with_srgb(lab.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), done, strict=True)))).select(px.columns)


def _dodge(d: Column, s: Column) -> Column:
    return F.when(d == 0, 0.0).when(s == 1, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(d, 1 - s)))


def _burn(d: Column, s: Column) -> Column:
    return F.when(d == 1, 1.0).when(s == 0, 0.0).otherwise(1 - F.least(F.lit(1.0), F.try_divide(1 - d, s)))


def _hard(d: Column, s: Column) -> Column:
    t = 2 * s - 1
    return F.when(s <= 0.5, d * (2 * s)).otherwise(d + t - d * t)


def _soft(d: Column, s: Column) -> Column:
    curve = F.when(d <= 0.25, (16 * d - 12) * d * d + 4 * d).otherwise(F.sqrt(d))
    return F.when(s <= 0.5, d - (1 - 2 * s) * d * (1 - d)).otherwise(d + (2 * s - 1) * (curve - d))


#: Blend of a backdrop d and a source s, channel by channel, both 0..1.
SEPARABLE = {
    "multiply": lambda d, s: d * s, "screen": lambda d, s: d + s - d * s, "overlay": lambda d, s: _hard(s, d), "darken": F.least, "lighten": F.greatest,
    "color-dodge": _dodge, "color-burn": _burn, "hard-light": _hard, "soft-light": _soft, "difference": lambda d, s: F.abs(d - s), "exclusion": lambda d, s: d + s - 2 * d * s,
}


def _lum(c: RGB) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


#: Mode -> whose colour, whose saturation it takes on (if any), whose lightness: d the backdrop, s the source.
NON_SEPARABLE = {"hue": ("s", "d", "d"), "saturation": ("d", "s", "d"), "color": ("s", None, "d"), "luminosity": ("d", None, "s")}


def _clipped(rows: DataFrame) -> DataFrame:
    """Colours _ur, _ug, _ub brought into 0..1 toward their own lightness, first from below, then from above."""
    rgb = tuple(F.col(f"_u{c}") for c in "rgb")
    for low in (True, False):
        rows = rows.withColumns({"_l": _lum(rgb), "_k": F.least(*rgb) if low else F.greatest(*rgb)})
        l, k = F.col("_l"), F.col("_k")
        rows = rows.withColumns({f"_u{c}": F.when(k < 0, l + F.try_divide((v - l) * l, l - k)).otherwise(v) if low else F.when(k > 1, l + F.try_divide((v - l) * (1 - l), k - l)).otherwise(v) for c, v in zip("rgb", rgb, strict=True)})
    return rows


def over_modes(rows: DataFrame, src: tuple[Column, ...], opacity: Column, dst: tuple[Column, ...], modes: Iterable[str]) -> DataFrame:
    """rows with mode and out_r to out_a, a row for each of these modes, composited as over() does.

    The mode is a column, so a blend is a branch of one expression and the compositing around
    it is there once: the generated code stays small however many modes there are. What is
    used more than once is a projection of its own.
    """
    modes = list(modes)
    number, named = {m: i for i, m in enumerate(modes)}, F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(i).alias("_m")) for i, m in enumerate(modes)))
    kept = rows.columns
    rgb = lambda k: tuple(F.col(f"_{k}{c}") for c in "rgb")
    known = lambda v: F.coalesce(v, F.lit(0.0))  # noqa: E731  columns that are never null need no checks in the generated code
    rows = rows.withColumns({f"_{k}{c}": known(v / 255.0) for k, vs in (("s", src), ("d", dst)) for c, v in zip("rgb", vs[:3], strict=True)} | {"_sa": known(src[3] / 255.0 * opacity), "_da": known(dst[3] / 255.0)})
    rows = rows.withColumn("_o", F.col("_sa") + F.col("_da") * (1 - F.col("_sa"))).select("*", F.inline(named))
    among = lambda ms: F.col("_m").isin([number[m] for m in ms if m in number])
    apart = [m for m in modes if m in NON_SEPARABLE]
    if apart:
        pick = lambda part: tuple(F.when(among(m for m in apart if NON_SEPARABLE[m][part] == "s"), s).otherwise(d) for s, d in zip(rgb("s"), rgb("d"), strict=True))
        rows = rows.withColumns({f"_{n}{c}": v for n, part in (("b", 0), ("t", 1), ("w", 2)) for c, v in zip("rgb", pick(part), strict=True)})
        rows = rows.withColumns({"_lo": F.least(*rgb("b")), "_hi": F.greatest(*rgb("b")), "_sat": F.greatest(*rgb("t")) - F.least(*rgb("t"))})
        spread = lambda v: F.when(F.col("_hi") > F.col("_lo"), F.try_divide((v - F.col("_lo")) * F.col("_sat"), F.col("_hi") - F.col("_lo"))).otherwise(0.0)
        rows = rows.withColumns({f"_u{c}": F.when(among(m for m in apart if NON_SEPARABLE[m][1]), spread(v)).otherwise(v) for c, v in zip("rgb", rgb("b"), strict=True)})
        rows = rows.withColumn("_e", _lum(rgb("w")) - _lum(rgb("u")))
        rows = _clipped(rows.withColumns({f"_u{c}": F.col(f"_u{c}") + F.col("_e") for c in "rgb"}))
    blended = {}
    for c in "rgb":
        d, s = F.col(f"_d{c}"), F.col(f"_s{c}")
        e = F.when(F.lit(False), s)
        for m in modes:
            if m in SEPARABLE:
                e = e.when(F.col("_m") == number[m], SEPARABLE[m](d, s))
        blended[f"_v{c}"] = e.otherwise(F.col(f"_u{c}") if apart else s)
    rows = rows.withColumns(blended)
    sa, da = F.col("_sa"), F.col("_da")
    mixed = {c: F.when(da > 0, ((1 - da) * s + da * v) * 255).otherwise(s * 255) for c, s, v in zip("rgb", rgb("s"), rgb("v"), strict=True)}
    out = {f"out_{c}": half_up(F.try_divide(mixed[c] * sa + F.col(f"_d{c}") * 255 * da * (1 - sa), F.col("_o"))) for c in "rgb"} | {"out_a": half_up(F.col("_o") * 255)}
    return rows.withColumns({n: F.when(F.col("_o") <= 0, 0).otherwise(v).cast("int") for n, v in out.items()}).select(*kept, "mode", *out)


MODES = ("normal", *SEPARABLE, *NON_SEPARABLE)


def blend(mode: str, d: RGB, s: RGB) -> RGB:
    return s if mode == "normal" else tuple(SEPARABLE[mode](x, y) for x, y in zip(d, s, strict=True))


def over(src: tuple[Column, ...], opacity: Column, dst: tuple[Column, ...], mode: str = "normal") -> tuple[Column, ...]:
    """Source over destination on straight alpha, rounded to 8 bits."""
    sa, da = src[3] / 255.0 * opacity, dst[3] / 255.0
    out = sa + da * (1 - sa)
    back, front = tuple(c / 255.0 for c in dst[:3]), tuple(c / 255.0 for c in src[:3])
    b = blend(mode, back, front)
    mixed = src[:3] if mode == "normal" else tuple(F.when(da > 0, ((1 - da) * f + da * x) * 255).otherwise(s.cast("double")) for f, x, s in zip(front, b, src[:3], strict=True))
    rgb = tuple(half_up(F.try_divide(m * sa + d * da * (1 - sa), out)) for m, d in zip(mixed, dst[:3], strict=True))
    return tuple(F.when(out <= 0, 0).otherwise(c).cast("int") for c in (*rgb, half_up(out * 255)))


def simulate_vision(mode: str, r: Column, g: Column, b: Column) -> RGB:
    return tuple(half_up(c).cast("int") for c in product(VISION[mode], (r, g, b)))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)))


def coarse_key(r: Column, g: Column, b: Column) -> Column:
    return reduce(lambda x, c: F.shiftleft(x, 5).bitwiseOR(F.shiftright(c, 3)), (g, b), F.shiftright(r, 3))


def to_hsv(r: Column, g: Column, b: Column) -> RGB:
    """Hue in degrees, saturation and value 0..1, from channels 0..1."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, 60 * F.pmod(F.try_divide(g - b, d), F.lit(6.0))).when(hi == g, 60 * (F.try_divide(b - r, d) + 2)).otherwise(60 * (F.try_divide(r - g, d) + 4))
    return h, F.when(hi == 0, 0.0).otherwise(F.try_divide(d, hi)), hi


def from_hsv(h: Column, s: Column, v: Column) -> RGB:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 60.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return channel(5), channel(3), channel(1)


def hsv_shift(rows: DataFrame, h: float, s: float, v: float) -> DataFrame:
    """Opaque and half-opaque rows (r, g, b, a) with the hue turned by h degrees and saturation and value moved by s and v percent."""
    out = rows.withColumns(dict(zip(("_h", "_s", "_v"), to_hsv(*(F.col(c) / 255.0 for c in "rgb")), strict=True)))
    out = out.withColumns({"_h": F.pmod(F.col("_h") + h, F.lit(360.0)), "_s": clamp(F.col("_s") + s / 100, 0.0, 1.0), "_v": clamp(F.col("_v") + v / 100, 0.0, 1.0)})
    new = from_hsv(F.col("_h"), F.col("_s"), F.col("_v"))
    return out.withColumns({c: F.when(F.col("a") > 0, half_up(n * 255)).otherwise(F.col(c)).cast("int") for c, n in zip("rgb", new, strict=True)}).drop("_h", "_s", "_v")


def from_hex(text: Column) -> RGB:
    """Channels of a colour written in six hexadecimal digits, with or without #; anything else is black."""
    digits = F.regexp_extract(F.trim(text), "^#?([0-9a-fA-F]{6})$", 1)
    return tuple(F.when(digits == "", 0).otherwise(F.conv(F.substring(digits, 1 + 2 * k, 2), 16, 10).cast("int")) for k in range(3))


def to_css(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.concat(F.lit("rgba("), F.concat_ws(",", r.cast("string"), g.cast("string"), b.cast("string"), (a / 255.0).cast("string")), F.lit(")"))


def same_rgb(p: Column, q: Column) -> Column:
    return (p["r"] == q["r"]) & (p["g"] == q["g"]) & (p["b"] == q["b"])


def similar(p: Column, q: Column, tolerance: float = 0.392157 * 255) -> Column:
    """Whether two pixels differ by no more than the tolerance in each channel, or are both transparent."""
    near = reduce(lambda x, y: x & y, (F.abs(p[c] - q[c]) <= tolerance for c in "rgba"))
    return near | ((p["a"] == 0) & (q["a"] == 0))
