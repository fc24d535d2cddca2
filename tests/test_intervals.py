"""The interval join against every pair."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import intervals
from marlstone.plans import registry

KINDS = "id int, starts timestamp, ends timestamp, labels array<string>"
BASE = datetime(2024, 1, 1)


def met(a, b):
    far = datetime(9000, 1, 1)
    good = lambda x: x[1] is not None and (x[2] is None or x[1] <= x[2])
    return good(a) and good(b) and a[1] <= (b[2] or far) and b[1] <= (a[2] or far) and bool(set(a[3] or []) & set(b[3] or []))


@pytest.mark.parametrize("unit", [1, 60, 100_000])
def test_pairs_are_all_pairs(spark, unit):
    r = random.Random(unit)

    def some(n):
        out = []
        for i in range(n):
            start = BASE + timedelta(seconds=r.randrange(20_000)) if r.random() > 0.03 else None
            end = r.choice([None, start and start + timedelta(seconds=r.choice([0, 1, 59, 60, 61, 7000, r.randrange(500)])), BASE])
            out.append((i, start, end, r.choice([None, [], ["a"], ["b", "a"], ["c", "b", "b"]])))
        return out

    left, right = some(70), some(90)
    found = intervals.overlapping(spark.createDataFrame(left, KINDS), spark.createDataFrame(right, KINDS), unit)
    assert sorted(map(tuple, found.collect())) == sorted((a[0], b[0]) for a in left for b in right if met(a, b))


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], KINDS), spark.createDataFrame([(1, BASE, None, ["a"])], KINDS)
    assert intervals.overlapping(none, none).collect() == [] and intervals.overlapping(one, none).collect() == [] and intervals.overlapping(none, one).collect() == []


def test_blocks_make_up_their_window(spark):
    rows = [(s, e) for s in range(0, 40, 3) for e in range(s - 1, 40)]
    for s, e, got in spark.createDataFrame(rows, "s long, e long").select("s", "e", intervals.blocks(F.col("s"), F.col("e"), 6)).collect():
        units = [u for x in got for u in range(x.block << x.level, (x.block + 1) << x.level)]
        assert sorted(units) == list(range(s, e + 1)) and len(got) <= 12


def test_no_nested_loop(spark, sf):
    plan = registry.queries()["evidence_in_force"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("micro", [1_000_000, 1000, 1])
def test_totals_are_those_of_all_pairs(spark, micro):
    """Counts and least ids without pairs, for times in whole seconds, milliseconds and microseconds."""
    r = random.Random(micro)

    def some(n, labels):
        out = []
        for i in range(n):
            start = BASE + timedelta(microseconds=micro * r.randrange(300)) if r.random() > 0.03 else None
            end = r.choice([None, start and start + timedelta(microseconds=micro * r.choice([0, 1, 2, 7, 90, r.randrange(50)])), BASE])
            out.append((i, start, end, r.choice(labels)))
        return out

    left, right = some(70, [None, [], ["a"], ["b", "a"], ["c", "b", "b"]]), some(120, ["a", "b", "c", "d", None])
    found = intervals.overlap_totals(spark.createDataFrame(left, KINDS), spark.createDataFrame(right, "id int, starts timestamp, ends timestamp, label string"))
    want = []
    for a in left:
        ids = [b[0] for b in right if met(a, (*b[:3], [b[3]] if b[3] else []))]
        want += [(a[0], len(ids), min(ids))] if ids else []
    assert sorted(map(tuple, found.collect())) == sorted(want)
    none, one = spark.createDataFrame([], KINDS), spark.createDataFrame([(1, BASE, None, "a")], "id int, starts timestamp, ends timestamp, label string")
    assert intervals.overlap_totals(none, one).collect() == [] and intervals.overlap_totals(none, one.limit(0)).collect() == []


def test_no_pairs_are_made(spark, sf):
    """What is read for the answer is a few rows a case, however many events hold for good."""
    plan = registry.queries()["evidence_in_force"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan and "least" in plan


def test_blocks_are_never_broadcast(spark, sf):
    """Tables of blocks look small to Spark, by the files that they are exploded from."""
    sides = [spark.createDataFrame([(1, BASE, None, ["a"])], KINDS) for _ in range(2)]
    for found in (registry.queries()["evidence_in_force"](spark, sf), intervals.overlapping(*sides)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
