"""The stream of leased workflows against a plain replay, with events out of order and a restart."""

import datetime as dt
import random

import pytest

from marlstone.operators.relational import WORKFLOW_STATES
from marlstone.streaming import leases

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "workflow_id string, event_id long, ts timestamp, kind string, owner string, lease_ms long, expected_revision long, to string"


def plain(events):
    out, flows = [], {}
    for e in events:
        flows.setdefault(e[0], []).append(e)
    for w, es in flows.items():
        state, revision, owner, until, fence = "planned", 0, None, None, 0
        for _, event_id, ts, kind, who, lease, expected, to in sorted(es, key=lambda e: (e[2], e[1])):
            if until and until <= ts:
                out.append((w, None, until, "lease", owner, "expired", state, revision, fence))
                owner = until = None
            if kind == "claim":
                if owner in (None, who):
                    result = "renewed" if owner else "acquired"
                    fence += owner is None
                    owner, until = who, ts + dt.timedelta(milliseconds=lease)
                else:
                    result = "busy"
            elif kind == "release":
                result = "released" if owner == who else "busy"
                if owner == who:
                    owner = until = None
            elif owner != who:
                result = "locked"
            elif revision != expected:
                result = "stale"
            elif to not in WORKFLOW_STATES[state]:
                result = "denied"
            else:
                result, state, revision = "applied", to, revision + 1
            out.append((w, event_id, ts, kind, who, result, state, revision, fence))
        if until:
            out.append((w, None, until, "lease", owner, "expired", state, revision, fence))
    return sorted(out, key=repr)


def made(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.choice(("claim", "move", "move", "move", "release"))
        out.append((f"w{r.randrange(4)}", i, T0 + dt.timedelta(seconds=r.randrange(4000)), kind, r.choice("ab"), r.choice((60_000, 600_000)), r.choice((0, 0, 1, 2)), r.choice(("running", "running", "failed"))))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, leases.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_out_of_order_with_a_restart(spark, tmp_path, rocksdb):
    """Three runs from one checkpoint; within a run and between runs events come as they like, an hour late at most."""
    events = made(200, 3)
    r = random.Random(1)
    come = sorted(events, key=lambda e: e[2] + dt.timedelta(seconds=r.randrange(1800)))
    ends = [("end", 10_000 + k, T0 + dt.timedelta(days=k), "claim", "z", 1, 0, "") for k in (1, 2)]
    for part in (come[:100], [*come[100:], ends[0]], ends[1:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = leases.leased_workflows(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = rows(spark.read.schema(leases.OUTPUT).parquet(str(tmp_path / "out")).where("workflow_id <> 'end'"))
    assert got == plain(events)
    assert {x[5] for x in got} >= {"acquired", "renewed", "busy", "expired", "released", "locked", "stale", "denied", "applied"}


def test_a_finished_table(spark, tmp_path):
    events = made(80, 5)
    bad = [(None, 1, T0, "claim", "a", 1, 0, ""), ("w1", None, T0, "claim", "a", 1, 0, ""), ("w1", 900, None, "claim", "a", 1, 0, "")]
    assert rows(leases.replayed(spark.createDataFrame([*events, *bad], SCHEMA), str(tmp_path / "a"))) == plain(events)
    assert rows(leases.replayed(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))) == []
    odd = [("w", 1, T0, "claim", None, 5, 0, ""), ("w", 2, T0, "claim", "a", None, 0, ""), ("w", 3, T0, None, None, None, None, None)]
    assert [x[5] for x in rows(leases.replayed(spark.createDataFrame(odd, SCHEMA), str(tmp_path / "c")))] == ["busy", "busy", "locked"]


def test_in_order_is_the_stream(spark, tmp_path):
    """One pass over sorted events gives what the stream gives, with ids that repeat, bad rows and many workflows a task, and starts no stream."""
    events = made(80, 7)
    odd = [(None, 1, T0, "claim", "a", 1, 0, ""), ("w1", None, T0, "claim", "a", 1, 0, ""), ("w1", 900, None, "claim", "a", 1, 0, ""), ("w", 1, T0, "claim", None, 5, 0, ""), ("w", 2, T0, "claim", "a", None, 0, ""), ("w", 3, T0, None, None, None, None, None),
           ("v", 5, T0, "move", "a", None, 0, "running"), ("v", 5, T0, "claim", "b", 60_000, 0, ""), ("v", 5, T0, "claim", "a", 60_000, 0, "")]
    table = spark.createDataFrame([*events, *odd], SCHEMA)
    found = leases.in_order(table)
    assert found.schema.simpleString() == leases.replayed(table.limit(0), str(tmp_path / "a")).schema.simpleString()
    assert rows(found) == rows(leases.replayed(table, str(tmp_path / "b")))
    assert rows(leases.in_order(table.repartition(7))) == rows(leases.in_order(table.coalesce(1)))
    assert rows(leases.in_order(table.limit(0))) == []


def test_all_events(spark, sf):
    """The query over all events of the smallest table, against the plain replay."""
    from marlstone.plans import registry, workflow_queries

    events = workflow_queries.leased_events(spark.read.parquet(f"{sf}/events.parquet"))
    asked = [(str(e[0]), e[1], e[2].replace(microsecond=e[2].microsecond // 1000 * 1000), *e[3:]) for e in events.select("workflow_id", "event_id", "ts", "kind", "owner", "lease_ms", "expected_revision", "to").collect()]
    got = rows(registry.queries()["leased_workflows"](spark, sf))
    assert got == plain(asked) and {x[5] for x in got} >= {"applied", "expired", "stale"}
