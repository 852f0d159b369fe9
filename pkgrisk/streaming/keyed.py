"""State that streams keep by key: the fold of state events and the earliest row of a key.

State lives in the session's key-value state store (RocksDB), so a micro-batch reads the state of its own keys only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pkgrisk.operators.history import MIN_RATIONALE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT_SCHEMA = "ts bigint, seq bigint, action string, state string, rationale string"
#: last valid add of each state with its reason, last promotion, last move, and the newest time seen
FOLD_SCHEMA = (
    "b_ts bigint, b_seq bigint, b_reason string, q_ts bigint, q_seq bigint, q_reason string, a_ts bigint, a_seq bigint, a_reason string, "
    "p_ts bigint, p_seq bigint, move string, move_reason string, top bigint"
)
CHANGE_SCHEMA = "key string, state string, reason string, added bigint, ts bigint, seq bigint, action string, rationale string, problem string"
Change = Row(*(field.split()[0] for field in CHANGE_SCHEMA.split(", ")))
FIRST = -(1 << 62)  # events without a time come first


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """A query started inside keeps its state in RocksDB; the session's own setting stays as it is."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Fold:
    """The policy state of one key after events in order of time; of constant size but for its reasons."""

    def __init__(self, row: tuple | None = None):
        (*self.b, b), (*self.q, q), (*self.a, a) = (row[0:3], row[3:6], row[6:9]) if row else ((None,) * 3,) * 3
        self.reasons = [b, q, a]
        self.p = list(row[9:11]) if row else [None, None]
        self.move, self.move_reason = row[11:13] if row else (None, None)

    def row(self, top: int) -> tuple:
        b, q, a = self.reasons
        return (*self.b, b, *self.q, q, *self.a, a, *self.p, self.move, self.move_reason, top)

    def step(self, event: tuple) -> None:
        """The rules of ``history.checked_events`` and ``history.fold_state`` for the next event."""
        ts, seq, action, state, rationale = event
        at = [ts, seq]
        text = (rationale or "").strip(" ")
        reason = None if rationale is None else text.split("\n")[0]
        if action == "promote":
            if self.move == "add":
                self.a, self.reasons[2], self.p = at, self.move_reason, at
            self.move, self.move_reason = "promote", reason
        elif action == "add" and state in ("blocked", "quarantined", "allowlist") and len(text) >= MIN_RATIONALE:
            if state == "blocked":
                self.b, self.reasons[0] = at, reason
            elif state == "quarantined":
                self.q, self.reasons[1] = at, reason
                self.move, self.move_reason = "add", reason
            else:
                self.a, self.reasons[2] = at, reason

    def states(self) -> list[tuple[str, str | None, int]]:
        """state, reason, time added of the states that hold."""
        out = []
        if self.b[1] is not None:
            out.append(("blocked", self.reasons[0], self.b[0]))
        if self.q[1] is not None and (self.p[1] is None or self.q > self.p):
            out.append(("quarantined", self.reasons[1], self.q[0]))
        if self.a[1] is not None:
            out.append(("allowlist", self.reasons[2], self.a[0]))
        return out


class StateFold(StatefulProcessor):
    """Folds the events of a key in order of time although they arrive in any order.

    Kept for a key: the fold of all events older than its newest one by more than the lateness, and the events within
    it. Events that are older than that when they arrive are handed on with a problem and have no effect.
    """

    def __init__(self, lateness: int):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", FOLD_SCHEMA)
        self.pending = handle.getListState("pending", EVENT_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = tuple(self.fold.get()) if self.fold.exists() else None
        top = known[-1] if known else FIRST
        edge = top - self.lateness
        events = [tuple(e) for e in self.pending.get()] if known else []
        name = key[0]
        for r in rows:
            ts = FIRST if r["ts"] is None else r["ts"]
            if known and ts < edge:
                yield Change(name, None, None, None, r["ts"], r["seq"], r["action"], r["rationale"], "too_late")
            else:
                events.append((ts, r["seq"], r["action"], r["state"], r["rationale"]))
                top = max(top, ts)
        events.sort(key=lambda e: (e[0], e[1] is not None, e[1] or 0))
        fold = Fold(known)
        edge = top - self.lateness
        old = 0
        while old < len(events) and events[old][0] < edge:
            fold.step(events[old])
            old += 1
        self.fold.update(fold.row(top))
        if events[old:]:
            self.pending.put(events[old:])
        elif known:
            self.pending.clear()
        for e in events[old:]:
            fold.step(e)
        found = fold.states()
        for state, reason, added in found or [(None, None, None)]:
            yield Change(name, state, reason, None if added == FIRST else added, None, None, None, None, None)

    def close(self) -> None:
        pass


class Earliest(StatefulProcessor):
    """Hands on a row of a key whenever it is earlier than all rows of that key so far; keeps its order only."""

    def __init__(self, order_schema: StructType, columns: list[str]):
        self.order_schema, self.columns, self.order = order_schema, columns, order_schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", self.order_schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        least = place(self.first.get()) if self.first.exists() else None
        best = None
        for r in rows:
            own = place(r[c] for c in self.order)
            if least is None or own < least:
                best, least = r, own
        if best is not None:
            self.first.update(tuple(best[c] for c in self.order))
            yield Row(*self.columns)(*(best[c] for c in self.columns))

    def close(self) -> None:
        pass


def place(order: Iterable[Any]) -> tuple:
    """Values of the order columns as a key that sorts as in SQL, nulls first."""
    return tuple((v is not None, v if v is not None else 0) for v in order)
