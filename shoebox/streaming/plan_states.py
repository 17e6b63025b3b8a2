"""Transitions of plan items checked against the orders they may come in, in a batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The states of an item in the order they come, on one drive and between drives, and the state of an error.
SAME_DRIVE = ("pending", "renamed", "done")
CROSS_DRIVE = ("pending", "copied", "verified", "source_trashed", "done")
FAILED = "failed"

OK, REPEATED, ILLEGAL, LATE, STALLED = "ok", "repeated", "illegal", "late", "stalled"
VERDICTS = "plan_id string, media_id string, seq long, before string, state string, verdict string"


def next_states() -> dict[tuple[bool, str | None], tuple[str, ...]]:
    """For an item on one drive or not, and its state (none at first): the states that may follow."""
    out: dict[tuple[bool, str | None], tuple[str, ...]] = {}
    for same, order in ((True, SAME_DRIVE), (False, CROSS_DRIVE)):
        out[same, None] = (order[0],)
        for a, b in zip(order[:-1], order[1:], strict=True):
            out[same, a] = (b, FAILED)
    return out


def verdict(same_drive: Column, before: Column, state: Column) -> Column:
    """ok, repeated (the same state again) or illegal."""
    allowed = F.lit(False)
    for (same, was), then in next_states().items():
        allowed = allowed | ((same_drive == F.lit(same)) & (before.isNull() if was is None else before == was) & state.isin(*then))
    return F.when(F.coalesce(allowed, F.lit(False)), OK).when(before == state, REPEATED).otherwise(ILLEGAL)


def check_transitions(transitions: DataFrame) -> DataFrame:
    """Each transition (``plan_id``, ``media_id``, ``same_drive``, ``state``, ``seq``) with the state ``before`` it and its ``verdict``."""
    order = W.partitionBy("plan_id", "media_id").orderBy("seq")
    t = transitions.withColumn("before", F.lag("state").over(order))
    return t.select("plan_id", "media_id", "seq", "before", "state", verdict(F.col("same_drive"), F.col("before"), F.col("state")).alias("verdict"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in VERDICTS.split(", ")]
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


class ItemStates(StatefulProcessor):
    """Keeps each item's last state and place; emits a verdict for every transition, and ``stalled`` for an item that stays unfinished.

    A transition whose ``seq`` is not above the last one's comes again or late, and changes nothing.  An item is reported
    stalled once, until it moves again.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms, self.allowed = patience_ms, next_states()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, seq long, timer long")

    def _wait(self, now: int, state: str, timer: int | None) -> int | None:
        """Moves the item's timer; an item at its end has none."""
        if timer is not None:
            self.handle.deleteTimer(timer)
        if state in ("done", FAILED):
            return None
        self.handle.registerTimer(now + self.patience_ms)
        return now + self.patience_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, seq, timer = self.last.get() if self.last.exists() else (None, None, None)
        out = []
        moves = [x for pdf in rows for x in zip(pdf["same_drive"], pdf["state"], pdf["seq"], strict=True)]
        for same, to, at in sorted(moves, key=lambda m: m[2]):
            if seq is not None and at <= seq:
                out.append((*key, int(at), state, to, REPEATED if to == state and at == seq else LATE))
                continue
            fits = to in self.allowed.get((bool(same), state), ())
            out.append((*key, int(at), state, to, OK if fits else REPEATED if to == state else ILLEGAL))
            state, seq = to, int(at)
        self.last.update((state, seq, self._wait(timerValues.getCurrentProcessingTimeInMs(), state, timer)))
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, seq, _ = self.last.get()
        self.last.update((state, seq, None))
        yield _frame([(*key, seq, state, state, STALLED)])

    def close(self) -> None:
        pass


def watch_transitions(transitions: DataFrame, patience_ms: int = 3_600_000) -> DataFrame:
    """The verdicts of ``check_transitions`` over a stream of transitions, and ``stalled`` for items unfinished for ``patience_ms``.

    The session names the RocksDB state store, which keeps an item's state and its timer.  As timers need batches without
    data, the query is to run on a time trigger: one that ends when its input is read never does.
    """
    t = transitions.select(F.col("plan_id").cast("string").alias("plan_id"), F.col("media_id").cast("string").alias("media_id"), "same_drive", "state", F.col("seq").cast("long").alias("seq"))
    return t.groupBy("plan_id", "media_id").transformWithStateInPandas(ItemStates(patience_ms), VERDICTS, "Append", "ProcessingTime")
