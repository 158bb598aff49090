"""Edit logs and preview requests as streams, with state per owner."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def history_stream(log: DataFrame, most: int = 200) -> DataFrame:
    """A stream of (owner, seq, command, key) -> the undo depth after each batch: owner, done, undone.

    `do` pushes (joined with the newest step when its key is the same and not null, after an undo too) and
    clears what was undone; `undo` and `redo` move one step; the oldest beyond `most` go.
    Within a batch an owner's commands are taken in the order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, future = map(json.loads, state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            if r.command == "do":
                own = r.key if isinstance(r.key, str) else None
                if not past or own is None or past[-1] != own:
                    past = [*past, own][-most:]
                future = []
            elif r.command == "undo" and past:
                future.append(past.pop())
            elif r.command == "redo" and future:
                past.append(future.pop())
        state.update((json.dumps(past), json.dumps(future)))
        yield pd.DataFrame({"owner": [key[0]], "done": [len(past)], "undone": [len(future)]})

    return log.groupBy("owner").applyInPandasWithState(step, "owner long, done int, undone int", "past string, future string", "update", GroupStateTimeout.NoTimeout)


def preview_stream(requests: DataFrame, busy: int) -> DataFrame:
    """A stream of (owner, seq) -> requests that start: one at a time, each for `busy` numbers, the newest of those that waited next."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, waits = state.get if state.exists else (-(1 << 40), None)
        started = []
        for e in sorted(pd.concat(list(batches))["seq"].tolist()):
            if waits is not None and free <= e:
                started.append(waits)
                free, waits = free + busy, None
            if free <= e:
                started.append(e)
                free = e + busy
            else:
                waits = e
        state.update((free, waits))
        yield pd.DataFrame({"owner": [key[0]] * len(started), "seq": started})

    return requests.groupBy("owner").applyInPandasWithState(step, "owner long, seq long", "free long, waits long", "append", GroupStateTimeout.NoTimeout)
