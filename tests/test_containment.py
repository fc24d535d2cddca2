"""The containment join against every pair, and its plan."""

import random

from pyspark.sql import functions as F

from marlstone.functions.policy import CLASSIFICATIONS
from marlstone.operators import containment
from marlstone.plans import registry


def may(clearance, held, need, wanted):
    return clearance in CLASSIFICATIONS and need in CLASSIFICATIONS and CLASSIFICATIONS.index(clearance) >= CLASSIFICATIONS.index(need) and set(wanted or []) <= set(held or [])


def test_pairs_are_all_pairs(spark):
    r = random.Random(9)
    words = ["a", "b", "c", "d", "e", None]
    level = lambda: r.choice([*CLASSIFICATIONS, "unknown", None])
    some = lambda: r.choice([None, r.sample(words, r.randint(0, 3)), ["a", "a"]])
    people = [(i, level(), some()) for i in range(150)]
    things = [(i, level(), some()) for i in range(200)] + [(500 + i, "public", ["a"]) for i in range(100)] + [(900, "public", ["nobody"])]
    p, m = spark.createDataFrame(people, "principal_id int, clearance string, held array<string>"), spark.createDataFrame(things, "thing int, classification string, compartments array<string>")
    want = sorted((i, t) for i, c, h in people for t, k, w in things if may(c, h, k, w))
    assert sorted((x.principal_id, x.thing) for x in containment.readable(p, m).collect()) == want
    counts = {x.principal_id: x.readable for x in containment.readable_counts(p, m).collect()}
    assert counts == {i: sum(1 for x, _ in want if x == i) for i, *_ in people}
    assert containment.readable(p, m.where("false")).collect() == [] and {x.readable for x in containment.readable_counts(p, m.where(F.lit(False))).collect()} == {0}


def test_no_nested_loop(spark, sf):
    plan = registry.queries()["readable_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
