"""Windows in ranges against windows over whole keys, with one key that has half of all rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import relational, spans

KEYS, ORDER = ["k"], ["ts", "id"]


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(7)
    rows = [("hot" if i % 2 else r.choice(["a", "b", None, "c"]), r.randrange(500), i, r.choice(["x", "y", None]), r.choice(["queued", "running", "failed"])) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, ts int, id int, v string, state string").repartition(5).cache()


def same(found, want):
    assert sorted(map(repr, found.select(sorted(found.columns)).collect())) == sorted(map(repr, want.select(sorted(want.columns)).collect()))


def test_each_is_the_window_over_the_key(spark, events):
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    same(spans.previous(events, KEYS, ORDER, F.col("v"), "n"), events.withColumn("n", F.lag("v").over(w)))
    same(spans.following(events, KEYS, ORDER, F.col("v"), "n"), events.withColumn("n", F.lead("v").over(w)))
    same(spans.carried(events, KEYS, ORDER, F.col("v"), "n"), events.withColumn("n", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    same(spans.numbered(events, KEYS, ORDER, "n"), events.withColumn("n", F.row_number().over(w)))
    none = events.where("false")
    assert spans.previous(none, KEYS, ORDER, F.col("v"), "n").collect() == [] and spans.numbered(none, KEYS, ORDER, "n").collect() == []


def test_a_hot_key_is_in_many_ranges(spark, events):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        by = {x["_span"]: x["count"] for x in spans.spanned(events, KEYS, ORDER).where("k = 'hot'").groupBy("_span").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(by) >= 2 and max(by.values()) < 1500


def test_transitions_of_a_hot_key(events):
    w = Window.partitionBy("k").orderBy(*ORDER)
    states = {"queued": ("running",), "running": ("failed", "running"), "failed": ()}
    found = relational.transitions(events, "k", ORDER, states).select("id", "previous", "allowed")
    plain = {x.id: x.p for x in events.select("id", F.lag("state").over(w).alias("p")).collect()}
    of = {x.id: x.state for x in events.collect()}
    for x in found.collect():
        assert x.previous == plain[x.id]
        assert x.allowed == (of[x.id] == "queued" if x.previous is None else of[x.id] in states[x.previous])
