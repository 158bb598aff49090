"""Exact nearest palette entries by short lists: a grid over Oklab whose cells hold the entries that can win in them.

Space between LOW and HIGH is cut into SIDE x SIDE x SIDE cells. An entry is in a cell's
list unless it is, from every place of the cell, farther than some entry is from every
place. Lists keep the palette's order, so a scan of one finds what a scan of all entries
finds, ties included. The lists hang on the palette alone: they are made once and shared by
plain, ordered and diffused quantising; a colour outside the grid meets all entries.
"""

from __future__ import annotations

import numpy as np

SIDE = 32
LOW, HIGH = np.array([-0.25, -0.45, -0.45]), np.array([1.25, 0.45, 0.45])
STEP = (HIGH - LOW) / SIDE
#: A later entry wins if it is nearer by more than this; entries within a hundred times as much stay in a list.
EPSILON, SLACK = 1e-9, 1e-7
#: Entries from which on lists pay.
WORTH = 9


class Candidates:
    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.float64).reshape(-1, 3)
        near, far = [], []
        for k in range(3):
            lo = LOW[k] + STEP[k] * np.arange(SIDE)[:, None]
            e = self.entries[:, k][None]
            near.append(np.maximum(0, np.maximum(lo - e, e - lo - STEP[k])) ** 2)
            far.append(np.maximum(np.abs(e - lo), np.abs(e - lo - STEP[k])) ** 2)
        counts, members = [], []
        for i in range(SIDE):  # a slab at a time
            least = near[0][i] + near[1][:, None] + near[2][None]
            most = far[0][i] + far[1][:, None] + far[2][None]
            kept = least <= most.min(-1, keepdims=True) + SLACK
            counts.append(kept.sum(-1).ravel())
            members.append(np.nonzero(kept)[2])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.members = np.concatenate(members).astype(np.int32)

    def cells(self, lab: np.ndarray) -> np.ndarray:
        """Number of each colour's cell, or -1 outside the grid."""
        at = np.floor((lab - LOW) / STEP)
        inside = ((at >= 0) & (at < SIDE)).all(1)
        at = np.where(inside[:, None], at, 0).astype(np.int64)
        return np.where(inside, (at[:, 0] * SIDE + at[:, 1]) * SIDE + at[:, 2], -1)

    def nearest(self, lab: np.ndarray) -> np.ndarray:
        """Index of each colour's nearest entry, entry by entry of its list."""
        cell = self.cells(lab)
        out = np.zeros(len(lab), np.int32)
        off = np.flatnonzero(cell < 0)
        if len(off):
            out[off] = plain_nearest(lab[off], self.entries)
        on = np.flatnonzero(cell >= 0)
        size = self.first[cell[on] + 1] - self.first[cell[on]]
        order = np.argsort(-size, kind="stable")
        on, size = on[order], size[order]
        start, c = self.first[cell[on]], lab[on]
        best, d = np.zeros(len(on), np.int32), np.full(len(on), np.inf)
        for k in range(int(size[0]) if len(size) else 0):
            n = np.searchsorted(-size, -k, "left")  # those with more than k entries come first
            e = self.members[start[:n] + k]
            x = ((c[:n] - self.entries[e]) ** 2).sum(1)
            nearer = x < d[:n] - EPSILON
            best[:n][nearer], d[:n][nearer] = e[nearer], x[nearer]
        out[on] = best
        return out

    def compared(self, lab: np.ndarray) -> int:
        """How many comparisons nearest() makes."""
        cell = self.cells(lab)
        return int((cell < 0).sum()) * len(self.entries) + int((self.first[cell[cell >= 0] + 1] - self.first[cell[cell >= 0]]).sum())


def plain_nearest(lab: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of each colour's nearest entry, over all entries."""
    best, d = np.zeros(len(lab), np.int32), np.full(len(lab), np.inf)
    for k, e in enumerate(entries):
        x = ((lab - e) ** 2).sum(1)
        nearer = x < d - EPSILON
        best[nearer], d[nearer] = k, x[nearer]
    return best


class _Made(dict):
    """Lists that a process has made, by palette; they stay behind when functions that use them are sent to workers."""

    def __reduce__(self) -> tuple:
        return _Made, ()


_MADE = _Made()
#: Lists kept; the oldest goes when there are more.
KEPT = 64


def of(entries: np.ndarray) -> Candidates:
    key = np.asarray(entries, np.float64).tobytes()
    if key not in _MADE:
        while len(_MADE) >= KEPT:
            del _MADE[next(iter(_MADE))]
        _MADE[key] = Candidates(entries)
    return _MADE[key]
