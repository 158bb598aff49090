"""PNG files of every colour type, depth, filter and interlacing, written by plain loops."""

import itertools
import struct
import zlib

import numpy as np
import pytest

from rasterloom.sources import images as I


def packed(px, depth):
    """Rows of samples (h, w, bands) as bytes."""
    out = []
    for row in px.reshape(px.shape[0], -1).tolist():
        bits = "".join(format(v, f"0{depth}b") for v in row)
        bits += "0" * (-len(bits) % 8)
        out.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
    return out


def filtered(rows, step, kinds):
    out, up = b"", [0] * (len(rows[0]) if rows else 0)
    for kind, row in zip(kinds, rows):
        line = [kind]
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out, up = out + bytes(line), row
    return out


def png(px, depth, color, lace=0, palette=None, clear=None, kinds=itertools.cycle(range(5))):
    h, w, bands = px.shape
    step, chunk = max(1, depth * bands // 8), lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    parts = [px[y0::dy, x0::dx] for x0, y0, dx, dy in I.PASSES] if lace else [px]
    data = zlib.compress(b"".join(filtered(packed(p, depth), step, kinds) for p in parts if p.size))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, lace))
    out += (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + (chunk(b"tRNS", clear) if clear else b"")
    return out + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("color,depth,lace", [(c, d, lace) for c, ds in I.DEPTHS.items() for d in ds for lace in (0, 1)])
@pytest.mark.parametrize("size", [(1, 1), (3, 2), (17, 11), (9, 16)])
def test_every_kind_of_file(color, depth, lace, size):
    w, h = size
    r = np.random.default_rng(depth * 7 + color)
    bands = I.BANDS[color]
    palette = r.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8) if color == 3 else None
    px = r.integers(0, 1 << depth, (h, w, bands))
    clear = bytes([9, 200]) if color == 3 else struct.pack(f">{bands}H", *px[0, 0].tolist()) if color in (0, 2) else None
    got = I.png_pixels(png(px, depth, color, lace, palette, clear, itertools.cycle(r.permutation(5).tolist())))
    for y, x in np.ndindex(h, w):
        s = px[y, x].tolist()
        to8 = [v if depth == 8 else (v + 128) // 257 if depth == 16 else v * 255 // ((1 << depth) - 1) for v in s]
        if color == 3:
            want = [*palette[s[0]].tolist(), [9, 200][s[0]] if s[0] < 2 else 255]
        elif color in (0, 2):
            want = [*(to8 * 3)[:3], 0 if s == px[0, 0].tolist() else 255]
        else:
            want = [*([to8[0]] * 3 if color == 4 else to8[:3]), to8[-1]]
        assert got[y, x].tolist() == want


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("step", [1, 2, 3, 4, 8])
def test_filters_alone(kind, step):
    r = np.random.default_rng(kind)
    rows = r.integers(0, 256, (6, 5 * step)).tolist()
    raw = np.frombuffer(filtered(rows, step, [kind] * 6), np.uint8).reshape(6, -1)
    assert I.unfiltered(raw[:, 0], raw[:, 1:], step).tolist() == rows


def test_what_is_no_png():
    good = png(np.zeros((2, 2, 1), int), 8, 0)
    for bad in (b"", b"GIF89a", good[:20], good.replace(b"IDAT", b"JDAT"), png(np.full((2, 2, 1), 3), 2, 3, palette=np.zeros((2, 3), np.uint8)), png(np.zeros((2, 2, 1), int), 8, 0, kinds=[0, 0])[:33]):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            I.png_pixels(bad)
    with pytest.raises(ValueError):
        I.png_pixels(good.replace(struct.pack(">IIBB", 2, 2, 8, 0), struct.pack(">IIBB", 2, 2, 3, 0)))
