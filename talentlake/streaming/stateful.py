"""Keyed state with timers: collector states and the retry queue as streams.

State lies in the state store, a few values a key, so it survives a restart from the checkpoint.  Events of a key are held until
the watermark has passed them and are then taken in order of (at, event_id), so that the result doesn't depend on the order or the
batches in which they came, as long as none is later than the watermark allows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talentlake.operators.runs import TRANSITIONS

#: Keyed state with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(at: dt.datetime) -> int:
    return int(at.replace(tzinfo=dt.UTC).timestamp() * 1000)


class _Ordered(StatefulProcessor):
    """Holds events of a key and hands them to ``take`` in order, once the watermark has passed them; ``take`` gives the state after an event and rows."""

    fields: str
    state_fields: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.fields)
        self.timer = handle.getValueState("timer", "ms long")
        self.state = handle.getValueState("state", self.state_fields)

    def _wake(self, ms: int) -> None:
        """One timer a key, for the first event that is held or the next attempt."""
        now = self.timer.get()
        if now is not None:
            if now[0] <= ms:
                return
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(_ms(r["at"]) * 1000 + r["at"].microsecond % 1000, *self.of(r)) for r in rows]
        if new:
            self.held.appendList(new)
            self._wake(min(x[0] for x in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(x) for x in self.held.get()), key=lambda x: x[:2])
        due = [x for x in held if x[0] // 1000 < mark]
        rest = held[len(due) :]
        if due:
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        # each access to the store is a message to another process, so a key's state is read and written once, not for every event
        found = self.state.get()
        state = found = None if found is None else tuple(found)
        for x in due:
            state, rows = self.take(key, x, state)
            yield from rows
        state, rows, then = self.settle(key, mark, state)
        yield from rows
        if state != found:
            if state is None:
                self.state.clear()
            else:
                self.state.update(state)
        wakes = [*([] if then is None else [then]), *([rest[0][0] // 1000 + 1] if rest else [])]
        if wakes:
            self.handle.registerTimer(min(wakes))
            self.timer.update((min(wakes),))
        else:
            self.timer.clear()

    def settle(self, key, mark: int, state: tuple | None) -> tuple[tuple | None, list[Row], int | None]:
        """What follows when all events before ``mark`` are taken: the state, rows, and when to look again."""
        return state, [], None

    def close(self) -> None:
        pass


class _States(_Ordered):
    """What each event finds as the state before it, and whether the step is legal; ``refuse`` leaves the state where a step isn't."""

    fields, state_fields = "at long, event_id long, state string", "state string"

    def __init__(self, initial: str, refuse: bool):
        self.initial, self.refuse = initial, refuse

    def of(self, r: Row) -> tuple:
        return r["event_id"], r["state"]

    def take(self, key, x: tuple, state: tuple | None) -> tuple[tuple | None, list[Row]]:
        _, event_id, to = x
        before = (state[0] if state else None) or self.initial
        legal = to is not None and (to == before or to in TRANSITIONS.get(before, ()))
        row = Row(collector=key[0], event_id=event_id, before=before, state=to, legal=legal)
        return (to,) if legal or not self.refuse else state, [row]


def state_stream(events: DataFrame, late: str = "0 seconds", initial: str = "idle", refuse: bool = False) -> DataFrame:
    """(collector, event_id, before, state, legal) of a stream of (event_id, collector, at, state), as ``runs.transitions`` gives for a table.

    With ``refuse`` a step that isn't legal leaves the state as it was.
    """
    rows = events.select("collector", "event_id", "at", "state").withWatermark("at", late)
    out = f"collector {dict(events.dtypes)['collector']}, event_id long, before string, state string, legal boolean"
    return rows.groupBy("collector").transformWithState(statefulProcessor=_States(initial, refuse), outputStructType=out, outputMode="Append", timeMode="EventTime")


class _Retries(_Ordered):
    """Failures raise the attempts of a task and set its next one; a timer tells when it is due; too many exhaust it; done ends it."""

    fields, state_fields = "at long, event_id long, kind string", "attempts int, next_ms long"

    def __init__(self, base: float, most: float, max_attempts: int):
        self.base, self.most, self.max_attempts = base, most, max_attempts

    def of(self, r: Row) -> tuple:
        return r["event_id"], r["kind"]

    def _row(self, key, event_id, status: str, attempts: int, wait: float, next_ms: int | None) -> Row:
        at = None if next_ms is None else dt.datetime.fromtimestamp(next_ms / 1000, dt.UTC).replace(tzinfo=None)
        return Row(task_id=key[0], event_id=event_id, status=status, attempts=attempts, backoff_seconds=wait, next_attempt_at=at)

    def _due(self, key, mark: int, state: tuple | None) -> tuple[tuple | None, list[Row]]:
        if state is not None and state[1] is not None and state[1] < mark:
            return (state[0], None), [self._row(key, None, "due", state[0], 0.0, state[1])]
        return state, []

    def take(self, key, x: tuple, state: tuple | None) -> tuple[tuple | None, list[Row]]:
        at, event_id, kind = x
        state, rows = self._due(key, at // 1000, state)
        attempts = state[0] if state else 0
        if kind == "done":
            return None, [*rows, self._row(key, event_id, "done", attempts, 0.0, None)]
        if attempts + 1 > self.max_attempts:
            return (attempts + 1, None), [*rows, self._row(key, event_id, "exhausted", attempts + 1, 0.0, None)]
        wait = min(self.most, self.base * 2**attempts)
        next_ms = at // 1000 + int(wait * 1000)
        return (attempts + 1, next_ms), [*rows, self._row(key, event_id, "pending", attempts + 1, wait, next_ms)]

    def settle(self, key, mark: int, state: tuple | None) -> tuple[tuple | None, list[Row], int | None]:
        state, rows = self._due(key, mark, state)
        return state, rows, state[1] + 1 if state and state[1] is not None else None


def retry_stream(events: DataFrame, late: str = "0 seconds", base: float = 30.0, most: float = 3600.0, max_attempts: int = 5) -> DataFrame:
    """What becomes of tasks in a stream of (event_id, task_id, at, kind), kind being failure or done.

    (task_id, event_id, status, attempts, backoff_seconds, next_attempt_at): pending or exhausted for each failure, due when the backoff has
    passed without another event, done at the end.
    """
    rows = events.select("task_id", "event_id", "at", "kind").withWatermark("at", late)
    out = f"task_id {dict(events.dtypes)['task_id']}, event_id long, status string, attempts int, backoff_seconds double, next_attempt_at timestamp"
    return rows.groupBy("task_id").transformWithState(statefulProcessor=_Retries(base, most, max_attempts), outputStructType=out, outputMode="Append", timeMode="EventTime")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs what a stream has now, from where the checkpoint in ``folder`` ended, and gives all rows so far.

    Each batch writes a folder of its own number, so that a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        write = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        write.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
