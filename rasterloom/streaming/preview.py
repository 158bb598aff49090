"""The preview as a stateful stream: buffers held by handle, conversions of held buffers, expiry, errors as rows.

A session is a key; its buffers are a map state, so a message reads or writes its own
buffer only. A buffer that is not used for `ttl` of event time is dropped by a timer, which
says so in a row. A message that cannot be served gives a row with what is wrong, and the
session goes on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rasterloom.operators import candidates, kernels
from rasterloom.operators.raster import TRANSPARENT, lab_of

#: Messages (kind is put, get, take, release or convert; settings is JSON) and replies. put and release have no reply unless they fail.
MESSAGE = "session long, seq long, at timestamp, kind string, handle long, width int, height int, data binary, settings string"
REPLY = "session long, seq long, kind string, handle long, width int, height int, data binary, indices binary, colors_used int, message string"
_FIELDS = [f.split()[0] for f in REPLY.split(", ")]
_MODES = ("box", "nearest")


def _edges(src: int, dst: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(dst + 1)
    start = at[:-1] * src // dst
    return start, np.maximum(start + 1, at[1:] * src // dst)


def box(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Means in linear light weighted by alpha, of an image (h, w, 4); alpha is the plain mean."""
    (y0, y1), (x0, x1) = _edges(image.shape[0], h), _edges(image.shape[1], w)
    c = image[..., :3] / 255.0
    lin = np.floor(np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4) * float(1 << 30) + 0.5).astype(np.int64)
    a = image[..., 3:].astype(np.int64)
    sums = np.pad(np.concatenate([lin * a, a], -1).cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    s = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    n = ((y1 - y0)[:, None] * (x1 - x0)[None])[..., None]
    mean = s[..., :3] / np.maximum(s[..., 3:], 1) / float(1 << 30)
    rgb = np.floor(np.where(mean <= 0.0031308, mean * 12.92, 1.055 * np.maximum(mean, 1e-30) ** (1 / 2.4) - 0.055) * 255 + 0.5)
    return np.concatenate([np.where(s[..., 3:] > 0, rgb, 0), np.floor(s[..., 3:] / n + 0.5)], -1).astype(np.int64)


def nearest(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """The source pixels at the middles of the cells."""
    at = lambda src, dst: np.minimum((2 * np.arange(dst) + 1) * src // (2 * dst), src - 1)
    return image[at(image.shape[0], h)][:, at(image.shape[1], w)]


def converted(image: np.ndarray, settings: dict) -> tuple[np.ndarray, np.ndarray]:
    """One held image by settings (width, height, mode, palette or max_colors, dither, strength, alpha_threshold) -> its pixels and indices."""
    w, h, mode, threshold = int(settings["width"]), int(settings["height"]), settings.get("mode", "box"), int(settings.get("alpha_threshold", 128))
    if w < 1 or h < 1 or mode not in _MODES:
        raise ValueError(f"cannot convert to {w} x {h} by {mode}")
    small = image if (h, w) == image.shape[:2] else (box if mode == "box" else nearest)(image, w, h)
    seen = small[..., 3] >= threshold
    colors = [tuple(c) for c in settings.get("palette") or []]
    if not colors:
        own, times = np.unique(small[seen][:, :3].astype(np.int64), axis=0, return_counts=True)
        colors = [tuple(map(int, c)) for c in kernels.palette_of(own, times.astype(np.float64), int(settings.get("max_colors", 16)))]
    labs, dither = np.array([lab_of(c) for c in colors]), settings.get("dither", "none")
    if dither in kernels.DIFFUSION:
        y, x = (c.ravel() for c in np.mgrid[:h, :w])
        pdf = pd.DataFrame({"image_id": 0, "y": y, "x": x} | {c: small[..., k].ravel() for k, c in enumerate("rgba")})
        idx = kernels.diffused(pdf, labs, dither, float(settings.get("strength", 1.0)), threshold)["idx"].to_numpy().reshape(h, w)
    elif dither == "none":
        idx = np.where(seen, candidates.of(labs).nearest(kernels.oklab(small[..., :3].reshape(-1, 3))).reshape(h, w), TRANSPARENT)
    else:
        raise ValueError(f"no dither {dither} in previews")
    out = np.zeros((h, w, 4), np.uint8)
    out[idx != TRANSPARENT] = [(*colors[k], 255) for k in idx[idx != TRANSPARENT]]
    return out, idx.astype("<u2")


class PreviewCore(StatefulProcessor):
    """Serves the messages of one session in the order of seq."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffers = handle.getMapState("buffers", "handle long", "width int, height int, data binary, until long")

    def _keep(self, key: int, w: int, h: int, data: bytes, now: int) -> None:
        self.buffers.updateValue((key,), (w, h, data, now + self.ttl_ms))
        self.handle.registerTimer(now + self.ttl_ms)

    def _serve(self, m, now: int) -> dict | None:
        if m.kind == "put":
            data = bytes(m.data) if m.data is not None else b""
            if not (m.width > 0 and m.height > 0) or len(data) != 4 * int(m.width) * int(m.height):
                raise ValueError(f"{len(data)} bytes are not {m.width} x {m.height} pixels")
            self._keep(int(m.handle), int(m.width), int(m.height), data, now)
            return None
        if m.kind not in ("get", "take", "release", "convert"):
            raise ValueError(f"no message {m.kind}")
        key = (int(m.handle),)
        if not self.buffers.containsKey(key):
            if m.kind == "release":
                return None
            raise ValueError(f"no buffer {m.handle} is held")
        w, h, data, _ = self.buffers.getValue(key)
        if m.kind in ("take", "release"):
            self.buffers.removeKey(key)
        else:
            self._keep(int(m.handle), w, h, bytes(data), now)
        if m.kind == "release":
            return None
        if m.kind != "convert":
            return {"width": w, "height": h, "data": bytes(data)}
        out, idx = converted(np.frombuffer(bytes(data), np.uint8).reshape(h, w, 4).astype(np.int64), json.loads(m.settings))
        return {"width": out.shape[1], "height": out.shape[0], "data": out.tobytes(), "indices": idx.tobytes(), "colors_used": len(np.unique(idx[idx != TRANSPARENT]))}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for m in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            try:
                reply = self._serve(m, int(m.at.value // 1_000_000))
            except (ValueError, KeyError, TypeError) as e:
                reply = {"message": str(e) or type(e).__name__}
            if reply is not None:
                out.append({"session": key[0], "seq": m.seq, "kind": "error" if "message" in reply else m.kind, "handle": m.handle} | reply)
        yield _replies(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [k[0] for k, v in list(self.buffers.iterator()) if v[3] <= now]
        for k in gone:
            self.buffers.removeKey((k,))
        yield _replies([{"session": key[0], "kind": "expired", "handle": k} for k in sorted(gone)])

    def close(self) -> None:
        pass


def _replies(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in _FIELDS] for r in rows], columns=_FIELDS, dtype=object)


def preview_replies(messages: DataFrame, ttl_seconds: int = 600, late_seconds: int = 0) -> DataFrame:
    """A stream of messages -> replies; the state store must be RocksDB, as for every map state."""
    m = messages.withWatermark("at", f"{late_seconds} seconds").groupBy("session")
    return m.transformWithStateInPandas(PreviewCore(ttl_seconds * 1000), REPLY, "Append", "EventTime")
