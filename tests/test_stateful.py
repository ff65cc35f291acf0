"""Streams with keyed state and timers: equal to the batch rules, in whatever batches the events come, across restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from talentlake.operators import runs
from talentlake.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
END = dt.datetime(2025, 1, 1)


def feed(spark, folder, rows, schema, number):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/n={number}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(f"{folder}/in/*")


@pytest.fixture
def small(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_states(small, tmp_path):
    spark, rng, schema, folder = small, random.Random(4), "event_id long, collector string, at timestamp, state string", str(tmp_path)
    rows = [(k, rng.choice("abc"), T0 + dt.timedelta(seconds=rng.randrange(400), microseconds=rng.choice([0, 0, 700])), rng.choice([*runs.TRANSITIONS, "odd", None])) for k in range(120)]
    rows.sort(key=lambda r: r[2])
    feed(spark, folder, rng.sample(rows[:70], 70), schema, 0)
    made = lambda: stateful.state_stream(stream(spark, folder, schema))
    first = stateful.drain(made(), folder).count()
    feed(spark, folder, rng.sample(rows[70:], 50), schema, 1)
    feed(spark, folder, [(999, "end", END, "idle")], schema, 2)
    got = stateful.drain(made(), folder).collect()  # from the checkpoint
    table = spark.createDataFrame(rows, schema)
    want = runs.transitions(table).collect()
    assert 0 < first < 120 and {(r["event_id"], r["before"], r["legal"]) for r in got} == {(r["event_id"], r["before"], r["legal"]) for r in want}
    assert len(got) == 120


def test_refused_states(small, tmp_path):
    spark, schema, folder = small, "event_id long, collector string, at timestamp, state string", str(tmp_path)
    said = ["failed", "syncing", "failed", "rate_limited", "backoff", "idle"]
    feed(spark, folder, [(k, "a", T0 + dt.timedelta(seconds=k), s) for k, s in enumerate(said)] + [(99, "end", END, "idle")], schema, 0)
    got = stateful.drain(stateful.state_stream(stream(spark, folder, schema), refuse=True), folder).where("collector = 'a'").orderBy("event_id").collect()
    assert [(r["before"], r["legal"]) for r in got] == [("idle", False), ("idle", True), ("syncing", True), ("failed", False), ("failed", True), ("backoff", True)]


def test_retries(small, tmp_path):
    spark, schema, folder = small, "event_id long, task_id string, at timestamp, kind string", str(tmp_path)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    feed(spark, folder, [(1, "t", at(0), "failure"), (2, "t", at(40), "failure"), (3, "u", at(5), "failure"), (4, "u", at(10), "done")], schema, 0)
    made = lambda: stateful.retry_stream(stream(spark, folder, schema), max_attempts=3)
    stateful.drain(made(), folder)
    feed(spark, folder, [(5, "t", at(41), "failure"), (6, "t", at(42), "failure"), (7, "v", at(1000), "failure")], schema, 1)
    feed(spark, folder, [(99, "end", END, "done")], schema, 2)
    got = stateful.drain(made(), folder).where("task_id <> 'end'").collect()
    of = lambda t: sorted((r["event_id"] or 0, r["status"], r["attempts"], r["backoff_seconds"], r["next_attempt_at"]) for r in got if r["task_id"] == t)
    assert of("t") == [(0, "due", 1, 0.0, at(30)), (1, "pending", 1, 30.0, at(30)), (2, "pending", 2, 60.0, at(100)), (5, "pending", 3, 120.0, at(161)), (6, "exhausted", 4, 0.0, None)]
    assert of("u") == [(3, "pending", 1, 30.0, at(35)), (4, "done", 1, 0.0, None)]
    assert of("v") == [(0, "due", 1, 0.0, at(1030)), (7, "pending", 1, 30.0, at(1030))]
    table = spark.createDataFrame([(1, 0, at(0)), (2, 1, at(40)), (5, 2, at(41))], "event_id long, attempts int, failed_at timestamp")
    same = {r["event_id"]: (r["backoff_seconds"], r["next_attempt_at"]) for r in runs.retry_tasks(table).withColumn("next_attempt_at", F.col("next_attempt_at")).collect()}
    assert all(same[e] == (wait, due) for e, status, _, wait, due in of("t") if status == "pending")


class Store:
    """A state store of one key that counts the messages that a processor sends it."""

    def __init__(self):
        self.sent, self.values, self.timers = 0, {}, set()

    def _state(self, name):
        store = self

        class State:
            def exists(self):
                store.sent += 1
                return name in store.values

            def get(self):
                store.sent += 1
                return store.values.get(name)

            def put(self, x):
                store.sent += 1
                store.values[name] = x

            def appendList(self, x):
                store.sent += 1
                store.values[name] = [*store.values.get(name, []), *x]

            def clear(self):
                store.sent += 1
                store.values.pop(name, None)

            update = put

        return State()

    def getValueState(self, name, fields):
        return self._state(name)

    getListState = getValueState

    def registerTimer(self, ms):
        self.sent += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.sent += 1
        self.timers.discard(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("of", [lambda: stateful._States("idle", True), lambda: stateful._Retries(30.0, 3600.0, 5)])
def test_messages_do_not_grow_with_events(of):
    """A key's events all at once: as many messages to the state store for a thousand of them as for sixteen."""
    sent = []
    for n in (16, 1000):
        store, one = Store(), of()
        one.init(store)
        at = [T0 + dt.timedelta(seconds=40 * k) for k in range(n)]
        one.handleInputRows(("a",), iter([{"event_id": k, "at": t, "state": "syncing", "kind": "done" if k % 8 == 7 else "failure"} for k, t in enumerate(at)]), None)
        rows = list(one.handleExpiredTimer(("a",), Clock(stateful._ms(END)), None))
        assert sum(r["event_id"] is not None for r in rows) == n
        sent.append(store.sent)
    assert sent[0] == sent[1]
