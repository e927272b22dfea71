"""State that a streaming query keeps itself: keys seen before, the last messages of a conversation. State lies in Spark's state store,
by key, holds a bounded number of entries for each, and comes back from the checkpoint after a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unseen(rows: DataFrame, by: str, key: str, pos: str, keep: int = 200) -> DataFrame:
    """The rows whose key is not among the newest ``keep`` of their group's earlier batches, each key once a batch, the least ``pos``
    of it. Only (by, key, pos) are handed on. As ``operators.tables.unseen_rows``, with the state in the query."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        newest: dict[str, int] = {}
        for part in parts:
            for k, p in zip(part[key], part[pos], strict=True):
                newest[k] = min(p, newest.get(k, p))
        order = sorted(newest, key=lambda k: (newest[k], k))
        known = set(seen)
        new = [k for k in order if k not in known]
        state.update((list(dict.fromkeys([*order, *seen]))[:keep],))
        if new:
            yield pd.DataFrame({by: [group[0]] * len(new), key: new, pos: [newest[k] for k in new]})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, key, pos)}
    flat = rows.select(by, key, pos)
    return flat.groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {key} {kinds[key]}, {pos} {kinds[pos]}", f"seen array<{kinds[key]}>", "append", GroupStateTimeout.NoTimeout)


def conversations(messages: DataFrame, last: int = 10) -> DataFrame:
    """(session, history): after each batch the last messages (session, turn, role, text) of the sessions that it touched."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*state.get, strict=True)) if state.exists else []
        for part in parts:
            # no more than the newest of a part can be among the newest of all
            rows = sorted([*rows, *zip(part["turn"], part["role"], part["text"], strict=True)])[-last:]
        turns, roles, texts = ([r[k] for r in rows] for k in range(3))
        state.update(([int(t) for t in turns], roles, texts))
        yield pd.DataFrame({"session": [group[0]], "history": ["\n".join(f"{r}: {t}" for r, t in zip(roles, texts, strict=True))]})

    kind = messages.schema["session"].dataType.simpleString()
    flat = messages.select("session", F.col("turn").cast("long").alias("turn"), "role", "text")
    return flat.groupBy("session").applyInPandasWithState(step, f"session {kind}, history string", "turns array<long>, roles array<string>, texts array<string>", "update", GroupStateTimeout.NoTimeout)
