"""Conversation repair, importance resampling and exact top-k against brute force, SQL, and on awkward tables."""

import functools
import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from rasterloom.llm import conversations, importance, queries, topk

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_importance_resampling", "op13_exact_top_k"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


# conversations


def brute_repair(messages):
    """Cost, audit and lines of (initial, role, text, fault) messages: all edits tried, memoised by place and the initials so far."""
    legal = re.compile(r"(s?(ua)+)?")

    @functools.cache
    def best(i, state):  # state: "", "s", "u" or "a", the last initial
        out = []
        if i == len(messages):
            if state in ("", "a"):
                out.append((0, "", ()))
        else:
            first, role, text, fault = messages[i]
            c, a, lines = best(i + 1, state)
            out.append((c + 2, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                for letter, to, name in [("K", first, role), ("R", "u", "user"), ("R", "a", "assistant")]:
                    if (state, to) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        c, a, lines = best(i + 1, to)
                        out.append((c + (letter == "R") + 5 * (fault == "truncated"), letter + a, (f"{name}:{text}", *lines)))
        return min(out + inserted(i, state, 2), default=(10**9, "", ()))

    def inserted(i, state, left):
        if not left:
            return []
        to = "a" if state == "u" else "u"
        c, a, lines = after(i, to, left - 1)
        return [(c + 5, "I" + a, ("user:" if to == "u" else "assistant:", *lines))]

    @functools.cache
    def after(i, state, left):
        out = inserted(i, state, left)
        if i == len(messages):
            if state in ("", "a"):
                out.append((0, "", ()))
        else:
            first, role, text, fault = messages[i]
            c, a, lines = best(i + 1, state)
            out.append((c + 2, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                for letter, to, name in [("K", first, role), ("R", "u", "user"), ("R", "a", "assistant")]:
                    if (state, to) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        c, a, lines = best(i + 1, to)
                        out.append((c + (letter == "R") + 5 * (fault == "truncated"), letter + a, (f"{name}:{text}", *lines)))
        return min(out, default=(10**9, "", ()))

    cost, audit, lines = best(0, "")
    assert legal.fullmatch("".join(x[0] for x in lines))
    return cost, audit, lines


def brute_report(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, got in groups.items():
        got.sort(key=lambda m: (m[0] is not None, m[0] or 0, hashlib.md5(f"{len(m[1].encode())}:{m[1]}{m[2]}".encode()).digest()))
        seen, messages = set(), []
        for _, role, text in got:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            messages.append((role[:1], role, text, fault))
        turns = [t for t, _, _ in got if t is not None]
        n = Counter(m[3] for m in messages)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(messages))
        cost, audit, lines = brute_repair(tuple(messages))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversation_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Fine.", "Fine.", "cut", "", " \n", None, "What? ", "Yes!\t", "é中.", "no end é"]
    rows = []
    for conv in [None, *range(n)]:
        for t in range(rng.randint(0, 12)):
            rows.append((conv, rng.choice([None, t, t, t, t + 3, -t]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts)))
        if rng.random() < 0.3 and rows:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_repairs_equal_brute_force(spark, monkeypatch, block):
    """With blocks of three messages nearly every conversation crosses borders."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = conversation_rows(block, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in conversations.repair_report(spark, df).collect()), key=str)
    assert got == brute_report(rows)


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 64)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"Message {t}.", f"cut {t}", "same."])) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = [tuple(r[c] for c in COLUMNS) for r in conversations.repair_report(spark, df).collect()]
    import sys

    sys.setrecursionlimit(20_000)
    assert got == brute_report(rows)


def test_distances_are_shortest():
    """Dial's distances against Bellman-Ford over the same arcs."""
    rng = random.Random(1)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(8)))
        goal = tuple(rng.choice([0, 3, 11, conversations.FAR]) for _ in range(4))
        n = len(codes)
        want = [conversations.FAR] * (4 * n) + list(goal)
        for _ in range(4 * n + 4):
            for i, s in itertools.product(range(n - 1, -1, -1), range(4)):
                ways = [want[4 * i + 4 + t] + c for _, t, c in conversations.OUT[codes[i]][s]] + [want[4 * i + conversations.FORCED[s]] + 5]
                want[4 * i + s] = min(want[4 * i + s], *ways)
        got = conversations.distances(codes, goal)
        assert [min(d, conversations.FAR) for d in got] == [min(d, conversations.FAR) for d in want]


def test_repaired_messages(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Bye."), (2, 0, "user", "Alone."), (3, 0, "system", "Be kind."), (3, 1, "user", "Ask?"), (3, 2, "assistant", "Told.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in conversations.repair_conversations(spark, df.withColumn("code", df.turn).withColumn("number", df.turn)).collect())
    assert got == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Bye.", "K"), (3, 0, "system", "Be kind.", "K"), (3, 1, "user", "Ask?", "K"), (3, 2, "assistant", "Told.", "K")]


def test_conversations_empty_long_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair_report(spark, spark.createDataFrame([], schema)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 > 4)
    rows = [(5, gone, "user", "Gone."), (6, kept, "user", "x" * 3_000_000 + ".")]
    got = {r.conv_id: r for r in conversations.repair_report(spark, spark.createDataFrame(rows, schema)).collect()}
    assert tuple(got[5][c] for c in COLUMNS[1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[6].audit, got[6].cost) == ("D", 2)


# importance resampling


def test_crc_algebra():
    rng = np.random.default_rng(3)
    for size in [0, 1, 2, 63, 64, 65, 127, 128, 1000, 70_000]:
        a, b = rng.bytes(17), rng.bytes(size)
        got = importance.shift(np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0] ^ np.uint32(zlib.crc32(b))
        assert got == zlib.crc32(a + b)
    words = [rng.bytes(int(n)) for n in [*rng.integers(1, 30, 200), 255, 256, 257, 5000]]
    ends = np.cumsum([len(w) for w in words])
    crcs = importance.word_crcs(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert crcs.tolist() == [zlib.crc32(w) for w in words]
    for n, run in enumerate(importance.run_crcs(crcs, np.array([len(w) for w in words]), 4), 1):
        assert run.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


def features(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def brute_resample(docs, target, n=2, buckets=10_000, least=20, percent=25, seed=7):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            counts.update(zlib.crc32(f.encode()) % buckets for f in features(x, n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, fs = features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((words, doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r[2]))
    drawn = percent * len(order) // 100
    ranked = [(*r[1:], k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r[1:], None) for r in rows if r[0] < least]
    return sorted(ranked, key=str)


RANKED = ["doc_id", "n_features", "weight", "score", "rank"]


def awkward_documents():
    rng = random.Random(9)
    vocabulary = ["Alpha", "beta", "GAMMA", "δέλτα", "e1", "中文", "x" * 300, "y" * 70]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)]
    return docs + [(100, None), (None, "null id " * 20), (101, ""), (102, " . ! "), (7, docs[7][1]), (7, docs[7][1]), (103, "long Text, " * 60_000), (104, "\x1c\x85odd" * 30)]


def test_resampling_equals_brute_force(spark):
    docs, target = awkward_documents(), ["alpha beta gamma", None, "中文 e1 " * 30, "δέλτα"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r[c] for c in RANKED) for r in importance.resampling_report(spark, df, t).collect()), key=str)
    assert got == brute_resample(docs, target)


def test_resample_keeps_columns_and_takes_parameters(spark):
    docs, target = awkward_documents(), ["alpha beta gamma delta", "中文"]
    df = spark.createDataFrame([(i, x, "s", 1) for i, x in docs], "doc_id long, text string, weights string, rank int")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(spark, df, t, n=3, buckets=257, least_words=5, percent=50, seed=8)
    assert got.columns == ["doc_id", "text", "weights", "n_features", "weight", "score", "rank"]
    want = [r for r in brute_resample(docs, target, 3, 257, 5, 50, 8) if r[4] is not None]
    assert sorted((tuple(r[c] for c in RANKED) for r in got.collect()), key=str) == sorted(want, key=str)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 40)], "doc_id long, text string")
    assert importance.resampling_report(spark, none, some).collect() == []
    assert importance.resampling_report(spark, some, none).first().n_features == 159


# exact top-k


def brute_top(rows, k=10, every=100):
    fit = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in fit]
    out = []
    for a, (i, v) in enumerate(whole):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(whole) if a != b and len(v) == len(w))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def top_of(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    return sorted(tuple(r) for r in topk.top_inner_products(spark, df, **how).select("query_id", "rank", "vec_id", "score").collect())


def f32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_top_k_equals_brute_force(spark, monkeypatch):
    """Small tiles, slices, blocks and groups, so that every level of the tree has several lists."""
    for name, value in {"TILE_BITS": 3, "TILE_ROWS": 8, "BLOCK_BYTES": 256, "SLICE_BYTES": 128, "GROUP": 2, "FAN": 2}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    rows = [(int(i), f32(rng.normal(size=4))) for i in range(-60, 140)] + [(i, f32([0.5, 0.5, 0.5, 0.5])) for i in range(300, 340)]
    assert top_of(spark, rows, every=20) == brute_top(rows, every=20)


def test_top_k_on_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.0, 0.0]), (100, [1.0, -1.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (6, [3.0, 2.0, 1.0]), (7, []), (300, []), (-100, [-0.1, 0.3]),
        (100, [1.0, -1.0]), (100, [5.0, 5.0]), (8, [1.0, 2.0]), (9, [0.25, 0.125]),
    ]
    rows = [(i, f32(v)) for i, v in rows]
    assert top_of(spark, rows) == brute_top(rows)
    assert top_of(spark, rows, k=2) == brute_top(rows, 2)
    assert top_of(spark, []) == []
    assert top_of(spark, [(0, [1.0])]) == []


def test_top_k_of_large_numbers(spark):
    """Products above 2**53 stay exact; those beyond a long are ordered by their exact value."""
    rng = np.random.default_rng(8)
    rows = [(i, f32(rng.normal(size=3) * 3e5)) for i in range(0, 60)]
    assert top_of(spark, rows, every=7) == brute_top(rows, every=7)
    huge = [(i, f32(rng.normal(size=3) * 1e12)) for i in range(0, 30)]
    got, want = top_of(spark, huge, every=7), brute_top(huge, every=7)
    top = np.iinfo(np.int64).max
    ranked = [(q, r, v, max(1 - top, min(top, s))) for q, r, v, s in want]
    assert [g for g in got if abs(g[3]) < top - 1] == [w for w in ranked if abs(w[3]) < top - 1]
