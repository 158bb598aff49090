"""Conversation structure repair: cheapest edits to alternating turns, by Dial's bucket queue.

A conversation is a row of messages, and its structure the states of a small automaton:
START, after the system message, after a user's, after an assistant's; it may end at START
(nothing left) or after an assistant. Edits are arcs between nodes (messages read, state):
Keep, Rerole, Delete and Insert, with costs of at most LARGEST. Distances to the end are
computed by Dial's algorithm from the end backwards, over a ring of LARGEST + 1 buckets;
then the audit is walked forwards over tight arcs, the least letter first. From a node each
letter leads to one node, so the walk gives the least string of all cheapest repairs.

No conversation needs to fit a task. Narrow rows (no text) are sorted by range and numbered
across the whole table (sharding.numbered), and cut into blocks of BLOCK numbers. A block
solves the conversations that lie inside it. Of one that crosses a border it gives the
costs between its four entry and four exit states; these 4 x 4 tables are chained from the
end to give the distances at every border, each block then walks from all four entry states,
and the walks are chained from the start. Only these tables, a row per BLOCK messages, meet
per conversation. What was said before is found by grouped minima of digests, summed before
they are shuffled, and a join that Spark may split.

Only the digest of the repaired text needs the texts. They are shuffled once, by
conversation, behind a header row with the audit, and go through SHA-256 one by one; that
hash is sequential by definition, so the texts of one conversation stream through one task,
in the memory of one batch.

Defined results: nulls count as one space (in the damage's key, roles and texts), so a null
text is blank and a null role must change; null turns come first and do not count for gaps;
rows of equal turn are ordered by a digest of role and text, and a repeated row is a message
of its own; a null conv_id is a conversation; a very long text is one message; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch
from rasterloom.llm.sharding import numbered

#: Messages of a block.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED, DAMAGE = 0, 1, 2, 5, 5, 20
LARGEST = max(KEEP, REROLE) + TRUNCATED
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a message of the role whose initial is at this place of "sua", by the state before; none where it may not stand.
ROLES = "sua"
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: The message that may be inserted, or made by a new role, in each state, and the state after it.
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Cost of what is inserted after the last message in each state, and how many messages that is.
TAIL_COST, TAIL = (0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0)
FAR = 1 << 60
BLANK_SIGNS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A message's code is its initial's place in "sua" (3: another) plus 4 times its fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def _arcs() -> tuple[list, list]:
    """For each code, the arcs into each state from the node before: (state, cost), and out of each: (letter, state, cost)."""
    into = [[[] for _ in range(4)] for _ in range(16)]
    out = [[[] for _ in range(4)] for _ in range(16)]
    for code in range(16):
        initial, fault = (ROLES + "?")[code & 3], code >> 2
        extra = TRUNCATED * (fault == CUT)
        for s in range(4):
            ways = [("D", s, DELETE)]
            if fault in (SOUND, CUT):
                if (initial, s) in NEXT:
                    ways.append(("K", NEXT[initial, s], KEEP + extra))
                ways.append(("R", FORCED[s], REROLE + extra))
            for letter, t, cost in ways:
                out[code][s].append((letter, t, cost))
                into[code][t].append((s, cost))
    return into, out


INTO, OUT = _arcs()
#: States from which an insertion leads into each.
INSERTED = [[s for s, t in FORCED.items() if t == to] for to in range(4)]


def distances(codes: bytes, goal: tuple[int, ...]) -> list[int]:
    """Distance from node 4 * i + state to the end, where the states after the last message are goal away; Dial's algorithm."""
    n = len(codes)
    dist = [FAR] * (4 * n + 4)
    ends = sorted((d, 4 * n + s) for s, d in enumerate(goal) if d < FAR)
    if not ends:
        return dist
    ring: list[list[int]] = [[] for _ in range(LARGEST + 1)]
    for d, v in ends:
        dist[v] = d
    now, k, waiting = ends[0][0], 0, 0
    while waiting or k < len(ends):
        while k < len(ends) and ends[k][0] == now:
            ring[now % (LARGEST + 1)].append(ends[k][1])
            k, waiting = k + 1, waiting + 1
        bucket = ring[now % (LARGEST + 1)]
        while bucket:
            v = bucket.pop()
            waiting -= 1
            if dist[v] != now:  # a shorter way was found meanwhile
                continue
            i, s = v >> 2, v & 3
            if i < n:
                d = now + INSERT
                for t in INSERTED[s]:
                    u = 4 * i + t
                    if d < dist[u]:
                        dist[u] = d
                        ring[d % (LARGEST + 1)].append(u)
                        waiting += 1
            if i:
                for t, cost in INTO[codes[i - 1]][s]:
                    u, d = v - 4 - s + t, now + cost
                    if d < dist[u]:
                        dist[u] = d
                        ring[d % (LARGEST + 1)].append(u)
                        waiting += 1
        now += 1
    return dist


def walk(codes: bytes, dist: list[int], state: int) -> tuple[str, int]:
    """The least letters over tight arcs from the first message in this state, and the state after the last."""
    out, i, n = [], 0, len(codes)
    while i < n:
        d, best = dist[4 * i + state], None
        for letter, t, cost in OUT[codes[i]][state]:  # D, K, R
            if cost + dist[4 * i + 4 + t] == d and (best is None or letter < best[0]):
                best = letter, t, i + 1
        t = FORCED[state]
        if INSERT + dist[4 * i + t] == d and (best is None or best[0] > "I"):
            best = "I", t, i
        letter, state, i = best
        out.append(letter)
    return "".join(out), state


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    dist = distances(codes, TAIL_COST)
    audit, state = walk(codes, dist, START)
    return dist[START], audit + "I" * TAIL[state]


_PIECE = "conv_id long, number long, n int, whole boolean, codes binary, way array<long>, illegal long, first int, last int, cost long, audit string"
_PIECE_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("number", pa.int64()), ("n", pa.int32()), ("whole", pa.bool_()), ("codes", pa.binary()), ("way", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]
)
#: Repairs kept by a task for conversations of equal codes.
REMEMBERED = 50_000
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _illegal(codes: bytes) -> int:
    r = ROLES + "?"
    return sum((r[a & 3], r[b & 3]) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their numbers -> a row per conversation and block."""
    known: dict[bytes, tuple[int, str]] = {}

    def piece(conv: int | None, number: int, codes: bytes) -> dict:
        n = len(codes)
        whole = number % BLOCK != 0 and (number + n) % BLOCK != 0  # else the conversation may go on in the next block
        row = {"conv_id": conv, "number": number, "n": n, "whole": whole, "illegal": _illegal(codes), "first": codes[0] & 3, "last": codes[-1] & 3}
        if not whole:
            by_exit = [distances(codes, tuple(0 if s == e else FAR for s in range(4))) for e in range(4)]
            return row | {"codes": codes, "way": [by_exit[e][s] for s in range(4) for e in range(4)]}
        if codes not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[codes] = repair(codes)
        cost, audit = known[codes]
        return row | {"cost": cost, "audit": audit}

    held: tuple[int | None, int, bytearray] | None = None
    for b in batches:
        out = []
        for conv, number, code in zip(b.column("conv_id").to_pylist(), b.column("number").to_pylist(), b.column("code").to_pylist(), strict=True):
            if held and (held[0] != conv or number % BLOCK == 0 or number != held[1] + len(held[2])):
                out.append(piece(held[0], held[1], bytes(held[2])))
                held = None
            if held is None:
                held = (conv, number, bytearray())
            held[2].append(code)
        yield pa.RecordBatch.from_pylist(out, _PIECE_ARROW)
    if held:
        yield pa.RecordBatch.from_pylist([piece(held[0], held[1], bytes(held[2]))], _PIECE_ARROW)


def _goals(t: pa.Table) -> pa.Table:
    """Pieces of a conversation -> the distances at each one's end."""
    rows = t.select(["number", "way"]).sort_by([("number", "descending")]).to_pylist()
    goal, out = list(TAIL_COST), []
    for r in rows:
        out.append(goal)
        goal = [min(FAR, *(r["way"][4 * s + e] + goal[e] for e in range(4))) for s in range(4)]
    return pa.table({"number": pa.array([r["number"] for r in rows], pa.int64()), "goal": pa.array(out, pa.list_(pa.int64()))})


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with goals -> the walk and the exit state from each entry state, and the distances there."""
    schema = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("exits", pa.list_(pa.int32())), ("from_here", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
    for b in batches:
        out = []
        for r in b.to_pylist():
            dist = distances(r["codes"], tuple(r["goal"]))
            walks = [walk(r["codes"], dist, s) for s in range(4)]
            out.append({c: r[c] for c in ("conv_id", "number", "illegal", "first", "last")} | {"exits": [s for _, s in walks], "from_here": dist[:4], "audits": [a for a, _ in walks]})
        yield pa.RecordBatch.from_pylist(out, schema)


def _entries(t: pa.Table) -> pa.Table:
    """Exit states of a conversation's pieces -> each one's entry state; at the last, what is inserted behind it; and at the first the cost."""
    rows = t.sort_by([("number", "ascending")]).to_pylist()
    state, before, out, r = START, None, [], ROLES + "?"
    for k, row in enumerate(rows):
        border = before is not None and (r[before], r[row["first"]]) not in LEGAL
        after = row["exits"][state]
        out.append({"at": row["number"], "entry": state, "tail": TAIL[after] if k == len(rows) - 1 else 0, "crossed": int(border), "price": row["from_here"][START] if k == 0 else 0})
        state, before = after, row["last"]
    return pa.Table.from_pylist(out, pa.schema([("at", pa.int64()), ("entry", pa.int32()), ("tail", pa.int32()), ("crossed", pa.int64()), ("price", pa.int64())]))


def _solved(spark: SparkSession, coded: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, illegal, cost and audit of each conversation of rows (conv_id, number, code)."""
    by_block = coded.withColumn("block", F.floor(F.col("number") / F.lit(BLOCK))).repartition("block").sortWithinPartitions("number")
    pieces = scratch.save(by_block.select("conv_id", "number", "code").mapInArrow(_pieces, _PIECE), "pieces")
    parts = pieces.where("not whole")
    goals = parts.groupBy("conv_id").applyInArrow(_goals, "number long, goal array<long>").withColumnRenamed("number", "of")
    walks = parts.join(goals, F.col("number") == F.col("of")).drop("of").mapInArrow(
        _walks, "conv_id long, number long, illegal long, first int, last int, exits array<int>, from_here array<long>, audits array<string>"
    )
    walks = scratch.save(walks, "walks")
    entries = walks.select("conv_id", "number", "first", "last", "exits", "from_here").groupBy("conv_id").applyInArrow(_entries, "at long, entry int, tail int, crossed long, price long")
    chosen = walks.join(entries, F.col("number") == F.col("at")).select(
        "conv_id", (F.col("illegal") + F.col("crossed")).alias("illegal"), F.col("price").alias("cost"), "number", F.concat(F.element_at("audits", F.col("entry") + 1), F.repeat(F.lit("I"), F.col("tail"))).alias("piece")
    )
    joined = chosen.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "piece"))), lambda x: x["piece"]), "").alias("audit"))
    return pieces.where("whole").select("conv_id", "illegal", "cost", "audit").union(joined)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy of the rows of a table after the damage that the CRC-32 of `conv_id:turn` deals."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % DAMAGE
    text, role = or_space("text"), or_space("role")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(role)
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copy"))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def _coded(spark: SparkSession, messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, number, turn, code of messages (conv_id, turn, role, text), numbered in the order of conversations and turns."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANK_SIGNS)), -1, 1)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = messages.select(
        "conv_id", "turn", _digest(F.col("role"), F.col("text")).alias("said"), place.cast("int").alias("place"),
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT).cast("int").alias("fault"),
    )
    rows, number, _ = numbered(spark, narrow, ["conv_id", "turn", "said"], scratch)
    rows = rows.select("conv_id", "turn", "said", "place", "fault", F.col(number).alias("number"))
    firsts = rows.groupBy(F.col("conv_id").alias("f_conv"), F.col("said").alias("f_said")).agg(F.min("number").alias("f_number"), F.count(F.lit(1)).alias("times")).where("times > 1")
    same = (F.col("said") == F.col("f_said")) & F.col("conv_id").eqNullSafe(F.col("f_conv"))
    fault = F.when((F.col("fault") != BLANK) & (F.col("number") > F.col("f_number")), DUPLICATE).otherwise(F.col("fault"))
    return scratch.save(rows.join(firsts, same, "left").select("conv_id", "turn", "number", (F.col("place") + 4 * fault).cast("int").alias("code")), "coded")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Headers and messages by conversation and turn -> per batch (conv_id, place, role, text, edit) of what remains; a header has place -1."""
    names = {USER: "user", ASSISTANT: "assistant"}
    audit, at, state, place, conv = "", 0, START, 0, None
    for b in batches:
        out = []
        for header, c, role, text, edits in zip(*(b.column(n).to_pylist() for n in ("header", "conv_id", "role", "text", "audit")), strict=True):
            if header:
                audit, at, state, place, conv = edits, 0, START, 0, c
                out.append((conv, -1, None, None, None))
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    state = NEXT[role[0], state] if edit == "K" else FORCED[state]
                    out.append((conv, place, role if edit == "K" else names[state], text, edit))
                    place += 1
            while audit[at : at + 1] == "I":
                state = FORCED[state]
                out.append((conv, place, names[state], "", "I"))
                at, place = at + 1, place + 1
        yield out


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    for rows in _edited(batches):
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows if r[1] >= 0], schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's `role:text` lines."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, state = None, None
    for rows in _edited(batches):
        out = []
        for c, place, role, text, _ in rows:
            if place < 0:
                if state is not None:
                    out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                conv, state = c, hashlib.sha256()
            else:
                state.update(("\n" * (place > 0) + f"{role}:{text}").encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema)


def _with_texts(messages: DataFrame, solved: DataFrame) -> DataFrame:
    """The messages of each conversation in order, behind a header with its audit."""
    texts = messages.select(F.lit(False).alias("header"), "conv_id", "turn", _digest(F.col("role"), F.col("text")).alias("said"), "role", "text", F.lit(None).cast("string").alias("audit"))
    none = lambda kind: F.lit(None).cast(kind)
    headers = solved.select(F.lit(True), "conv_id", none("long"), none("binary"), none("string"), none("string"), "audit")
    return texts.union(headers).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("header"), "turn", "said").select("header", "conv_id", "role", "text", "audit")


def repair_conversations(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text and edit of the messages that repaired conversations consist of."""
    scratch = Scratch(spark, "conversations")
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    messages = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role"), or_space("text"))
    solved = _solved(spark, _coded(spark, messages, scratch), scratch)
    return _with_texts(messages, solved).mapInArrow(_messages, "conv_id long, place long, role string, text string, edit string")


def repair_report(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and the repaired text's digest of every conversation, after the rows were damaged."""
    scratch = Scratch(spark, "conversations")
    messages = damaged(rows)
    coded = _coded(spark, messages, scratch)
    solved = scratch.save(_solved(spark, coded, scratch), "solved")
    times = lambda fault: F.sum((F.shiftright("code", 2) == fault).cast("long"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = coded.groupBy("conv_id").agg(gaps.alias("gaps"), times(BLANK).alias("blank"), times(DUPLICATE).alias("duplicate"), times(CUT).alias("truncated"))
    digests = _with_texts(messages, solved).mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    everything = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (counts, solved, digests):
        everything = everything.unionByName(part, allowMissingColumns=True)
    longs, texts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return everything.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs), *(F.coalesce(F.max(c), F.lit(v)).alias(c) for c, v in texts.items()))


def _step_sql() -> str:
    """One message back in the recursion: the best (cost, audit) from each state before it."""
    cut, may = f"(case when fault = {CUT} then {TRUNCATED} else 0 end)", f"fault in ({SOUND}, {CUT})"
    lines = []
    for s in range(4):
        ways = [f"{{c: s{s}.c + {DELETE}, a: 'D' || s{s}.a}}"]
        ways += [f"case when {may} and place = '{r}' then {{c: s{t}.c + {cut} + {KEEP}, a: 'K' || s{t}.a}} end" for (r, before), t in NEXT.items() if before == s]
        ways.append(f"case when {may} then {{c: s{FORCED[s]}.c + {cut} + {REROLE}, a: 'R' || s{FORCED[s]}.a}} end")
        lines.append(f"least({', '.join(ways)}) as e{s}")
    return ", ".join(lines)


def oracle() -> str:
    from rasterloom.llm.importance import CRC_TABLE, crc_sql

    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    more = lambda v: f"{{c: {v}.c + {INSERT}, a: 'I' || {v}.a}}"
    return rf"""
with recursive crc as ({CRC_TABLE}),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql(key)} % {DAMAGE} as kind from conversations, crc),
hurt as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
        unnest(case when kind = 3 then [0, 1] else [0] end) as copy
    from keyed where kind <> 0
),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(octet_length(encode(role)) || ':' || role || text), copy) as i from hurt),
judged as (
    select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as seen, row_number() over (partition by conv_id, role, text order by i) as nth, left(role, 1) as place, lag(left(role, 1)) over (partition by conv_id order by i) as before from ordered
),
coded as (select *, case when seen = '' then {BLANK} when nth > 1 then {DUPLICATE} when right(seen, 1) in ('.', '!', '?') then {SOUND} else {CUT} end as fault from judged),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = {BLANK}) as blank, count(*) filter (fault = {DUPLICATE}) as duplicate, count(*) filter (fault = {CUT}) as truncated,
        count(*) filter (i > 1 and before || place not in ('su', 'ua', 'au')) as illegal, count(*) as n
    from coded group by conv_id
),
back as (
    select conv_id, n as i, {", ".join(f"{{c: {TAIL_COST[s]}::bigint, a: '{'I' * TAIL[s]}'}} as s{s}" for s in range(4))} from counts
    union all
    select conv_id, i - 1, least(e0, {more("d2")}), least(e1, {more("d2")}), d2, d3
    from (
        select *, least(e2, {more("e3")}) as d2, least(e3, {more("e2")}) as d3
        from (select b.conv_id, b.i, {_step_sql()} from back b join coded m on m.conv_id is not distinct from b.conv_id and m.i = b.i)
    )
),
solved as (select conv_id, s0.c as cost, s0.a as audit from back where i = 0),
letters as (select conv_id, audit, unnest(range(1, length(audit) + 1)) as p from solved),
placed as (select conv_id, p, audit[p] as e, length(replace(audit[:p], 'I', '')) as i, length(replace(audit[:p], 'D', '')) as o, length(replace(audit, 'D', '')) % 2 as odd from letters),
lines as (
    select l.conv_id, l.p, case when e = 'K' then role when o % 2 = odd then 'assistant' else 'user' end || ':' || case when e = 'I' then '' else text end as line
    from placed l left join coded m on m.conv_id is not distinct from l.conv_id and m.i = l.i
    where e <> 'D'
),
texts as (select conv_id, sha256(string_agg(line, chr(10) order by p)) as repaired_sha256 from lines group by conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
    coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join counts c on c.conv_id is not distinct from a.conv_id
left join solved s on s.conv_id is not distinct from a.conv_id
left join texts t on t.conv_id is not distinct from a.conv_id
"""


ORACLE = oracle()
