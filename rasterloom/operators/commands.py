"""Commands on documents as logs: which steps stand after undo and redo, and the document they leave.

A document is its base and the commands that stand, applied in order; undoing one is leaving it out. So
nothing is inverted, and both parts are one pass over an owner's log.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.geometry import range_after_insert, range_after_remove
from rasterloom.tables import dealt

#: Fixed value: steps that can be undone.
STEPS = 200
#: Entries that a task takes, and rows of a batch that leaves it.
ENTRIES, BATCH = 500_000, 20_000


def history(log: DataFrame, most: int = STEPS) -> DataFrame:
    """(owner, seq, command, key) -> of each `do` the step it belongs to, from 0, and whether it is done, undone or dropped.

    `do` opens a step, or joins the newest if both have the same key, and drops the undone
    ones; `undo` and `redo` move a step. Steps beyond `most` stay done for good. A null key joins nothing;
    other commands, and an undo or redo of nothing, have no effect.
    """

    def fates(entries: Iterator[tuple]) -> tuple[dict, dict]:
        past, future, fate, count, fixed = [], [], {}, 0, 0
        for _, seq, command, key in entries:
            if command == "do":
                for _, _, seqs in future:
                    fate.update({s: "dropped" for s in seqs})
                future.clear()
                if len(past) > fixed and key is not None and past[-1][1] == key:
                    past[-1][2].append(seq)
                else:
                    past.append((count, key, [seq]))
                    count += 1
                fate[seq] = "done"
                fixed = max(fixed, len(past) - most)
            elif command == "undo" and len(past) > fixed:
                future.append(past.pop())
            elif command == "redo" and future:
                past.append(future.pop())
        for _, _, seqs in future:
            fate.update({s: "undone" for s in seqs})
        return fate, {s: n for n, _, seqs in past + future for s in seqs}

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All owners of a task after each other: a log may go on in the next batch."""
        entries = (e for b in batches for e in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for owner, own in groupby(entries, key=lambda e: e[0]):
            fate, steps = fates(own)
            out += [(owner, s, steps.get(s), what) for s, what in fate.items()]
            if len(out) >= BATCH:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["owner", "seq", "step", "fate"])

    rows = log.select(F.col("owner").cast("long").alias("owner"), F.col("seq").cast("long").alias("seq"), "command", "key")
    return dealt(rows, "owner", ENTRIES).sortWithinPartitions("owner", F.asc_nulls_last("seq")).mapInArrow(f, "owner long, seq long, step long, fate string")


FRAME = "struct<id:long,ms:int>"
TAG = "struct<id:long,lo:int,hi:int>"
STATE = f"struct<frames:array<{FRAME}>,tags:array<{TAG}>>"


def _place(items: Column, key: Column) -> Column:
    """Place of the item with a key, from 0, or -1."""
    return (F.array_position(F.transform(items, lambda i: i["id"]), key) - 1).cast("int")


def _within(at: Column, items: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce(at, F.size(items)), F.size(items)))


def _retagged(tags: Column, of) -> Column:
    def one(t: Column) -> Column:
        lo, hi = of(t["lo"], t["hi"])
        return F.struct(t["id"].alias("id"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    return F.transform(tags, one)


def _step(s: Column, e: Column) -> Column:
    """The document after one command."""
    frames, tags, frame = s["frames"], s["tags"], F.struct(e["id"].alias("id"), e["ms"].alias("ms"))
    at, here, there = _within(e["at"], frames), _place(frames, e["id"]), _place(frames, e["other"])
    fewer = F.filter(frames, lambda f: f["id"] != e["id"])
    swap = lambda f, i: F.when(i == here, F.get(frames, there)).when(i == there, F.get(frames, here)).otherwise(f)
    tag = F.struct(e["id"].alias("id"), e["at"].alias("lo"), e["to"].alias("hi"))
    changed = lambda t: F.when(t["id"] == e["id"], F.struct(t["id"].alias("id"), F.coalesce(e["at"], t["lo"]).alias("lo"), F.coalesce(e["to"], t["hi"]).alias("hi"))).otherwise(t)
    rules = {
        "add frame": (F.array_insert(frames, at + 1, frame), _retagged(tags, lambda lo, hi: range_after_insert(lo, hi, at))),
        "delete frame": (fewer, F.when(here >= 0, _retagged(tags, lambda lo, hi: range_after_remove(lo, hi, here, F.size(fewer)))).otherwise(tags)),
        "swap frames": (F.when((here >= 0) & (there >= 0), F.transform(frames, swap)).otherwise(frames), tags),
        "set duration": (F.transform(frames, lambda f: F.when(f["id"] == e["id"], F.struct(f["id"].alias("id"), e["ms"].alias("ms"))).otherwise(f)), tags),
        "add tag": (frames, F.array_append(tags, tag)),
        "delete tag": (frames, F.filter(tags, lambda t: t["id"] != e["id"])),
        "update tag": (frames, F.transform(tags, changed)),
    }
    out = s
    for name, (f, t) in rules.items():
        out = F.when(e["command"] == name, F.struct(f.alias("frames"), t.alias("tags")).cast(STATE)).otherwise(out)
    return out


def edited(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """owner, frames, tags of documents (owner, frames, tags) after edits (owner, seq, command, id, other, at, to, ms) in order.

    Commands: add frame (id at a place, the end if null), delete frame, swap frames (id, other), set
    duration, add tag (id from at to to), delete tag, update tag (at, to, where not null). Tags follow
    the frames they span. Commands on what is not there, and unknown ones, change nothing.
    """
    each = F.struct("seq", F.col("command"), F.col("id").cast("long").alias("id"), F.col("other").cast("long").alias("other"), F.col("at").cast("int").alias("at"), F.col("to").cast("int").alias("to"), F.col("ms").cast("int").alias("ms"))
    logs = dealt(edits, "owner", ENTRIES // 5).groupBy("owner").agg(F.array_sort(F.collect_list(each)).alias("_log"))
    both = documents.select("owner", F.struct(F.col("frames").cast(f"array<{FRAME}>").alias("frames"), F.col("tags").cast(f"array<{TAG}>").alias("tags")).cast(STATE).alias("_s")).join(logs, "owner", "left")
    done = both.select("owner", F.when(F.col("_log").isNull(), F.col("_s")).otherwise(F.aggregate("_log", F.col("_s"), _step)).alias("s"))
    return done.select("owner", "s.frames", "s.tags")
