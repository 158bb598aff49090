"""Gestures as a table function against plain loops."""

import random
from collections import deque

import numpy as np
import pytest

from rasterloom.operators import gestures as G
from rasterloom.operators import shapes as W
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sql(spark):
    G.register(spark)
    return spark


def plain(image, events):
    """Image, picks and errors after the events, a pixel at a time."""
    img = {(x, y): tuple(image[y, x]) for y in range(image.shape[0]) for x in range(image.shape[1])}
    tool = start = last = None
    picks, errors = [], []

    def dab(x, y, size, color):
        for j in range(size):
            for i in range(size):
                p = x - (size - 1) // 2 + i, y - (size - 1) // 2 + j
                if p in img:
                    img[p] = color

    for seq, phase, what, x, y, size, color in events:
        if (phase == "down" and what not in G.TOOLS) or (phase != "down" and tool is None):
            errors.append(seq)
            continue
        if phase == "down":
            tool, start, last = what, (x, y), None
        if tool in ("pencil", "eraser"):
            for p in [(x, y)] if last is None else G.between(*last, x, y)[1:]:
                dab(*p, size, color if tool == "pencil" else (0, 0, 0, 0))
        elif tool == "bucket" and phase == "down" and (x, y) in img:
            old, todo, seen = img[x, y], deque([(x, y)]), {(x, y)}
            while todo:
                p = todo.popleft()
                for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
                    if q in img and q not in seen and img[q] == old:
                        seen.add(q), todo.append(q)
            for p in seen:
                img[p] = color
        elif tool == "picker" and (x, y) in img:
            picks.append((seq, *img[x, y]))
        elif tool == "line" and phase == "up":
            for p in G.between(*start, x, y):
                dab(*p, size, color)
        elif tool == "rect" and phase == "up":
            for i in range(min(start[0], x), max(start[0], x) + 1):
                dab(i, start[1], size, color), dab(i, y, size, color)
            for j in range(min(start[1], y), max(start[1], y) + 1):
                dab(start[0], j, size, color), dab(x, j, size, color)
        last = x, y
        if phase == "up":
            tool = None
    return img, picks, errors


def test_gestures_equal_plain_loops(sql):
    rng, rows, want = random.Random(4), [], {}
    for owner in ("a", "b", "c", "d"):
        h, w = rng.randint(4, 9), rng.randint(4, 9)
        image = np.array([[[rng.choice([0, 255])] * 3 + [255] for _ in range(w)] for _ in range(h)], np.uint8)
        rows.append((owner, 0, "canvas", None, 0, 0, 0, 0, 0, 0, 0, w, h, bytearray(image.tobytes())))
        events = []
        for seq in range(1, 60):
            phase = rng.choice(["down", "move", "move", "up"])
            color = (rng.choice([0, 90, 255]), 7, rng.choice([1, 2]), rng.choice([0, 255]))
            events.append((seq, phase, rng.choice([*G.TOOLS, "broom"]) if phase == "down" else None, rng.randint(-2, w + 1), rng.randint(-2, h + 1), rng.randint(1, 3), color))
        rows += [(owner, s, p, t, x, y, n, *c, None, None, None) for s, p, t, x, y, n, c in events]
        after, picks, errors = plain(image, events)
        want[owner] = {p: c for p, c in after.items() if c != tuple(image[p[1], p[0]])}, picks, errors
    rng.shuffle(rows)
    sql.createDataFrame(rows, f"sprite string, {G.EVENT}").createOrReplaceTempView("events")
    out = sql.sql("SELECT * FROM gesture(TABLE(SELECT * FROM events), key => 'sprite')")
    assert out.columns == ["sprite", "kind", "seq", "y", "x", "r", "g", "b", "a", "message"]
    got = out.collect()
    for owner, (pixels, picks, errors) in want.items():
        own = [r for r in got if r.sprite == owner]
        assert {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in own if r.kind == "pixel"} == pixels
        assert [(r.seq, r.r, r.g, r.b, r.a) for r in sorted(own, key=lambda r: r.seq) if r.kind == "pick"] == picks
        assert sorted(r.seq for r in own if r.kind == "error") == errors


def test_the_key_may_be_of_any_name_and_type(sql):
    rows = [(7, 0, "canvas", None, 0, 0, 0, 0, 0, 0, 0, 1, 1, bytearray(4)), (7, 1, "down", "pencil", 0, 0, 1, 1, 2, 3, 4, None, None, None), (8, 1, "down", "pencil", 0, 0, 1, 1, 2, 3, 4, None, None, None), (9, 0, "canvas", None, 0, 0, 0, 0, 0, 0, 0, 2, 2, bytearray(3))]
    sql.createDataFrame(rows, f"id long, {G.EVENT}").createOrReplaceTempView("few")
    got = sorted((r.id, r.kind, r.seq, r.r) for r in sql.sql("SELECT * FROM gesture(TABLE(SELECT * FROM few), key => 'id')").collect())
    assert got == [(7, "pixel", 1, 1), (8, "error", 1, None), (9, "error", 0, None)]
    with pytest.raises(Exception):
        sql.sql("SELECT * FROM gesture(TABLE(SELECT * FROM few), key => 'nothing')").collect()


def test_lines_are_those_of_the_columns(spark):
    ends = [(0, 0, 7, 3), (5, 5, 5, 5), (3, 9, -2, 4), (0, 0, -6, -6), (2, 1, 4, 8)]
    df = spark.createDataFrame(ends, "a int, b int, c int, d int").select("a", "b", "c", "d", W.line(*map(F.col, "abcd")).alias("p"))
    for r in df.collect():
        assert [(p.x, p.y) for p in r.p] == G.between(r.a, r.b, r.c, r.d)
