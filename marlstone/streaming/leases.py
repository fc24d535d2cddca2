"""Workflows as a stream with state: moves by compare-and-set under leases that event time ends.

Events come in any order within the watermark. Each waits in the state, under its instant,
until the watermark has passed it; a timer at that instant then applies it, so that what is
emitted doesn't depend on the order or the batches in which the events came. A second timer
stands at the end of a lease. A workflow's waiting events lie in the state store and are
read an instant at a time. Events behind the watermark are dropped, as Spark does.

A finished table needs no waiting: in_order() sorts each workflow's events and applies the
same rules in one pass, holding a workflow's state only.

The stream needs RocksDB as state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marlstone.operators.relational import WORKFLOW_STATES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "workflow_id string, event_id long, at timestamp, kind string, owner string, outcome string, state string, revision long, fence long"
#: The same, with instants as milliseconds.
RAW = OUTPUT.replace("at timestamp", "at long")
FIRST = next(iter(WORKFLOW_STATES))
#: Rows of a batch from Python.
BATCH_ROWS = 8192


def whole(events: DataFrame) -> DataFrame:
    """The events that have a workflow, an id and a time, with it in milliseconds (ms)."""
    e = events.where("workflow_id is not null and event_id is not null and ts is not null").withColumn("ms", F.unix_millis("ts"))
    return e.select(F.col("workflow_id").cast("string").alias("workflow_id"), F.col("event_id").cast("long").alias("event_id"), "ts", "ms", "kind", "owner", F.col("lease_ms").cast("long").alias("lease_ms"), F.col("expected_revision").cast("long").alias("expected_revision"), "to")


def at_instant(now: tuple, ms: int, events: list, states: dict[str, tuple[str, ...]]) -> tuple[tuple, list[tuple]]:
    """What a workflow is after an instant, and its rows (event_id, at, kind, owner, outcome, state, revision, fence).

    now: its state, revision, the lease's owner and end (null: free), and the fence, which
    rises with each new owner. events: event_id, kind, owner, lease_ms, expected_revision, to.
    """
    state, revision, owner, until, fence = now
    rows = []
    if until is not None and until <= ms:
        rows.append((None, until, "lease", owner, "expired", state, revision, fence))
        owner = until = None
    for event_id, kind, who, lease_ms, expected, to in sorted(events, key=lambda e: (e[0], json.dumps(e[1:]))) if len(events) > 1 else events:
        held = owner is not None and owner != who
        if kind == "claim":
            outcome = "busy" if held or not who or not lease_ms or lease_ms < 0 else "renewed" if owner == who else "acquired"
            if outcome != "busy":
                fence += outcome == "acquired"
                owner, until = who, ms + lease_ms
        elif kind == "release":
            outcome = "released" if owner is not None and owner == who else "busy"
            if outcome == "released":
                owner = until = None
        else:
            outcome = "locked" if owner is None or held else "stale" if expected != revision else "applied" if to in states.get(state, ()) else "denied"
            if outcome == "applied":
                state, revision = to, revision + 1
        rows.append((event_id, ms, kind, who, outcome, state, revision, fence))
    return (state, revision, owner, until, fence), rows


class LeasedWorkflows(StatefulProcessor):
    """The state of a workflow as at_instant() has it, and the events that wait for their instant."""

    def __init__(self, states: dict[str, tuple[str, ...]], first: str) -> None:
        self.states, self.first = states, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, revision long, owner string, until long, fence long")
        self.waiting = handle.getMapState("waiting", "ms long", "events string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            ms = r["ms"]
            before = json.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            if not before:
                self.handle.registerTimer(ms)
            before.append([r["event_id"], r["kind"], r["owner"], r["lease_ms"], r["expected_revision"], r["to"]])
            self.waiting.updateValue((ms,), (json.dumps(before),))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        before = tuple(self.now.get()) if self.now.exists() else (self.first, 0, None, None, 0)
        events = json.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
        now, rows = at_instant(before, ms, events, self.states)
        if now[3] is not None and now[3] != before[3]:
            self.handle.registerTimer(now[3])
        for event_id, at, kind, who, outcome, state, revision, fence in rows:
            yield Row(workflow_id=key[0], event_id=event_id, at=at, kind=kind, owner=who, outcome=outcome, state=state, revision=revision, fence=fence)
        if events:
            self.waiting.removeKey((ms,))
        self.now.update(now)

    def close(self) -> None:
        pass


def leased_workflows(events: DataFrame, late: str = "1 hour", states: dict[str, tuple[str, ...]] = WORKFLOW_STATES, first: str = FIRST) -> DataFrame:
    """A stream of what each event did, and of each lease that ended by time (no event_id).

    events: workflow_id, event_id, ts, kind, owner, lease_ms, expected_revision, to. A claim
    takes a free or ended lease (acquired), lengthens the owner's own (renewed), else is busy,
    as is one without an owner or a length; a release by the owner frees it. A move, of any
    other kind, needs the lease (locked), the current revision (stale) and an allowed next
    state (denied); it is then applied. Events of one instant go by their id; a lease that ends
    then has ended before them. Events without a workflow, an id or a time are left out.
    """
    out = whole(events).withWatermark("ts", late).groupBy("workflow_id").transformWithState(LeasedWorkflows(dict(states), first), RAW, "append", "eventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


def in_order(events: DataFrame, states: dict[str, tuple[str, ...]] = WORKFLOW_STATES, first: str = FIRST) -> DataFrame:
    """What leased_workflows() gives once all time has passed, over a finished table: a workflow's events lie sorted in one task, which goes through them once."""
    states = dict(states)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    def applied(events: Iterator[tuple]) -> Iterator[tuple]:
        for workflow, own in groupby(events, key=lambda e: e[0]):
            now = (first, 0, None, None, 0)
            for (ms, _), same in groupby(own, key=lambda e: (e[1], e[2])):
                now, rows = at_instant(now, ms, [e[2:] for e in same], states)
                yield from ((workflow, *r) for r in rows)
            if now[3] is not None:
                yield from ((workflow, *r) for r in at_instant(now, now[3], [], states)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for r in applied(each(batches)):
            rows.append(r)
            if len(rows) >= BATCH_ROWS:
                yield batched(rows)
                rows = []
        if rows:
            yield batched(rows)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [x.split()[0] for x in RAW.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RAW.split(", ")]
    key = ["workflow_id", "ms", "event_id"]
    e = whole(events).select(*key, "kind", "owner", "lease_ms", "expected_revision", "to")
    out = e.repartition("workflow_id").sortWithinPartitions(*key).mapInArrow(run, RAW)
    return out.withColumn("at", F.timestamp_millis("at"))


def replayed(events: DataFrame, folder: str, late: str = "0 seconds", states: dict[str, tuple[str, ...]] = WORKFLOW_STATES, first: str = FIRST) -> DataFrame:
    """leased_workflows() over a finished table, through files in a folder that driver and executors share.

    The table is one batch, so that nothing in it is late. A row of a later day lets time
    pass all of it, and another one the leases that the first pass opened; they have no
    workflow of the table and leave nothing behind.
    """
    spark, name = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    last = events.agg(F.max(F.col("ts") + F.make_interval(secs=F.coalesce("lease_ms", F.lit(0)) / 1000)).alias("ts")).first().ts
    columns = events.select("workflow_id", "event_id", "ts", "kind", "owner", "lease_ms", "expected_revision", "to")
    columns = columns.withColumn("workflow_id", F.concat(F.lit("w"), F.col("workflow_id").cast("string")))
    columns.write.parquet(f"{folder}/in")
    try:
        spark.conf.set(name, ROCKSDB)
        for day in (1, 2) if last is not None else ():
            mark = spark.range(1).select(F.lit("").alias("workflow_id"), F.lit(day).cast(columns.schema["event_id"].dataType).alias("event_id"), (F.lit(last) + F.make_interval(days=F.lit(day))).alias("ts"))
            mark = mark.select("*", *[F.lit(None).cast(columns.schema[c].dataType).alias(c) for c in columns.columns[3:]])
            mark.select(columns.columns).write.mode("append").parquet(f"{folder}/in")
            stream = leased_workflows(spark.readStream.schema(columns.schema).parquet(f"{folder}/in"), late, states, first)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set(name, before)
    out = spark.read.schema(OUTPUT).parquet(f"{folder}/out") if last is not None else spark.createDataFrame([], OUTPUT)
    return out.where("workflow_id <> ''").withColumn("workflow_id", F.expr("substring(workflow_id, 2)"))
