"""Undo histories and edited documents against plain loops."""

import random

import pytest

from rasterloom.operators import commands as E


def stands(log, most):
    """What stands, by keeping whole lists."""
    past, future, fate = [], [], {}
    old = []
    for seq, command, key in log:
        if command == "do":
            fate |= {s: "dropped" for step in future for s in step[1]}
            future = []
            if past and key is not None and past[-1][0] == key:
                past[-1][1].append(seq)
            else:
                past.append((key, [seq]))
            if len(past) > most:
                old.append(past.pop(0))
            fate[seq] = "done"
        elif command == "undo" and past:
            future.insert(0, past.pop())
        elif command == "redo" and future:
            past.append(future.pop(0))
    return fate | {s: "undone" for step in future for s in step[1]}


@pytest.mark.parametrize("most", [1, 3, 200])
def test_history(spark, most):
    r = random.Random(most)
    logs = {o: [(i, r.choice(["do", "do", "do", "undo", "redo", "nothing"]), r.choice(["a", "b", None])) for i in range(r.randint(1, 60))] for o in range(20)}
    rows = [(o, *e) for o, log in logs.items() for e in log]
    r.shuffle(rows)
    got = E.history(spark.createDataFrame(rows, "owner long, seq long, command string, key string"), most).collect()
    for o, log in logs.items():
        assert {g["seq"]: g["fate"] for g in got if g["owner"] == o} == stands(log, most)


def test_steps_join_across_an_undone_one(spark):
    log = [(1, 1, "do", "k"), (1, 2, "do", "j"), (1, 3, "undo", None), (1, 4, "do", "k"), (1, 5, "do", None), (1, 6, "undo", None)]
    got = E.history(spark.createDataFrame(log, "owner long, seq long, command string, key string")).orderBy("seq").collect()
    assert [(g["seq"], g["step"], g["fate"]) for g in got] == [(1, 0, "done"), (2, None, "dropped"), (4, 0, "done"), (5, 2, "undone")]


def after(frames, tags, log):
    frames, tags = [list(f) for f in frames], [list(t) for t in tags]
    for _, c, i, other, at, to, ms in log:
        ids = [f[0] for f in frames]
        if c == "add frame":
            k = max(0, min(len(frames) if at is None else at, len(frames)))
            frames.insert(k, [i, ms])
            for t in tags:
                t[1:] = [t[1] + (k <= t[1]), t[2] + (k <= t[2] + 1)]
        elif c == "delete frame" and i in ids:
            k = ids.index(i)
            frames = [f for f in frames if f[0] != i]
            last = max(0, len(frames) - 1)
            for t in tags:
                lo, hi = (min(max(v, 0), last) for v in (t[1] - (k < t[1]), t[2] - (k <= t[2])))
                t[1:] = [min(lo, hi), hi]
        elif c == "swap frames" and i in ids and other in ids:
            a, b = ids.index(i), ids.index(other)
            frames[a], frames[b] = frames[b], frames[a]
        elif c == "set duration":
            for f in frames:
                f[1] = ms if f[0] == i else f[1]
        elif c == "add tag":
            tags.append([i, at, to])
        elif c == "delete tag":
            tags = [t for t in tags if t[0] != i]
        elif c == "update tag":
            for t in tags:
                if t[0] == i:
                    t[1:] = [t[1] if at is None else at, t[2] if to is None else to]
    return frames, tags


def test_edited_documents(spark):
    r = random.Random(4)
    names = ["add frame", "delete frame", "swap frames", "set duration", "add tag", "delete tag", "update tag", "unknown"]
    docs, rows = {}, []
    for o in range(25):
        docs[o] = ([(i, 100) for i in range(r.randint(0, 4))], [(7, 0, 1)] if o % 2 else [])
        free = iter(range(100, 200))
        for s in range(r.randint(0, 25)):
            c = r.choice(names)
            whole = c == "add tag"
            rows.append((o, s, c, next(free) if c.startswith("add") else r.choice([0, 1, 2, 7, 100, 101, 102]), r.choice([0, 1, 2, 100, 101]), r.choice([0, 1, 2, 9] if whole else [0, 1, 9, -1, None]), r.choice([2, 3] if whole else [2, 5, None]), r.randint(1, 99)))
    base = spark.createDataFrame([(o, *d) for o, d in docs.items()], f"owner long, frames array<{E.FRAME}>, tags array<{E.TAG}>")
    edits = spark.createDataFrame(rows, "owner long, seq long, command string, id long, other long, at int, to int, ms int")
    got = {g["owner"]: ([list(f) for f in g["frames"]], [list(t) for t in g["tags"]]) for g in E.edited(base, edits).collect()}
    assert got == {o: after(*d, [e[1:] for e in rows if e[0] == o]) for o, d in docs.items()}


def test_the_stream_counts_like_the_log(spark, tmp_path):
    from rasterloom.streaming.logs import history_stream

    r = random.Random(9)
    rows = [(o, i, r.choice(["do", "do", "undo", "redo"]), r.choice(["a", "b", None])) for o in range(8) for i in range(40)]
    kind = "owner long, seq long, command string, key string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "log"))
    run = history_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "log")), 5).writeStream.format("memory").queryName("depths").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {g["owner"]: g["undone"] for g in spark.table("depths").collect()}
    steps = E.history(spark.createDataFrame(rows, kind), 5).where("fate = 'undone'").groupBy("owner").agg({"step": "count"})
    distinct = {g["owner"]: 0 for g in spark.table("depths").collect()}
    for g in E.history(spark.createDataFrame(rows, kind), 5).where("fate = 'undone'").select("owner", "step").distinct().collect():
        distinct[g["owner"]] += 1
    assert got == distinct and steps.count() > 0
