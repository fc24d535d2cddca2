"""The order of stages against a recursive walk."""

import random

import pytest

from marlstone.operators import graph


def walk(declared, needs):
    order, seen = [], set()

    def visit(stage):
        if stage not in seen:
            seen.add(stage)
            for below in needs.get(stage, ()):
                visit(below)
            order.append(stage)

    for stage in declared:
        visit(stage)
    return order


def got(spark, declared, needs):
    stages = spark.createDataFrame([(s, i) for i, s in enumerate(declared)], "stage string, declared long")
    edges = spark.createDataFrame([(s, i, n) for s, found in needs.items() for i, n in enumerate(found)], "stage string, place int, needs string")
    found = graph.stage_order(stages, edges).collect()
    assert sorted(r.place for r in found) == list(range(1, len(found) + 1))
    return [r.stage for r in sorted(found, key=lambda r: r.place)]


def test_small(spark):
    assert got(spark, ["c", "b", "a"], {"c": ["b"], "b": ["a"]}) == ["a", "b", "c"]
    assert got(spark, ["a", "b"], {}) == ["a", "b"]
    assert got(spark, [], {}) == []
    assert got(spark, ["d", "a", "b", "c"], {"d": ["c", "b", "c"], "b": ["a"], "c": ["a"]}) == ["a", "c", "b", "d"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    r = random.Random(seed)
    names = [f"s{i}" for i in range(60)]
    rank = r.sample(names, len(names))
    needs = {s: r.sample(rank[i + 1 : i + 15], min(len(rank[i + 1 : i + 15]), r.randrange(4))) for i, s in enumerate(rank)}
    assert got(spark, names, needs) == walk(names, needs)


def test_errors(spark):
    for declared, needs in ((["a", "b"], {"a": ["b"], "b": ["a"]}), (["a"], {"a": ["a"]}), (["a"], {"a": ["x"]}), (["a", "a"], {})):
        with pytest.raises(ValueError):
            got(spark, declared, needs)


def test_parts_of_all_brands(spark, sf):
    from marlstone.plans import registry

    brands, parts = {}, spark.read.parquet(f"{sf}/part.parquet").collect()
    for p in sorted(parts, key=lambda p: (p.p_retailprice, p.p_partkey)):
        brands.setdefault(p.p_brand, []).append(p)
    needs = {}
    for b in brands.values():
        for n in range(1, len(b) + 1):
            needs[b[n - 1].p_partkey] = [x.p_partkey for x in sorted(b[2 * n - 1 : 2 * n + 2], key=lambda x: (x.p_size, x.p_partkey))]
    found = registry.queries()["stage_order"](spark, sf).collect()
    assert [r.stage for r in sorted(found, key=lambda r: r.place)] == walk(sorted(needs), needs)
