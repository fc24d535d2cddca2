"""Strongly connected components and endless aliases against plain walks."""

import random

from pyspark.sql import functions as F

from marlstone.operators import components, graph, lint


def plain(edges):
    """node: smallest node of its component, for nodes that reach themselves."""
    out, reach = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[a] = seen
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in out if a in reach[a]}


def got(spark, edges):
    df = spark.createDataFrame(edges, "node long, depends_on long")
    return {x.node: x.root for x in components.strongly_connected(df).collect()}




def test_shapes(spark):
    shapes = [
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 1)], [(1, 1), (2, 3)], [(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (5, 1)], [(1, None), (2, 3), (3, 2)],
        [(1, 2), (2, 3), (3, 4), (4, 1), (2, 5), (5, 6), (6, 4), (7, 8), (8, 7), (4, 7)], [(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 1), (6, 7), (7, 8)], [(5, 6)],
    ]
    offset = 0
    every, want = [], {}
    for shape in shapes:  # all at once: they don't touch each other
        moved = [(a + offset, b and b + offset) for a, b in shape]
        every += moved
        want |= plain([x for x in moved if x[1]])
        offset += 100
    assert got(spark, every) == want


def test_random_graphs(spark):
    r = random.Random(4)
    every, want = [], {}
    for n, m in ((12, 14), (12, 24), (30, 33)):
        base = len(every) * 1000 + 1_000_000 * len(want)
        part = [(base + r.randrange(n), base + r.randrange(n)) for _ in range(m)]
        every += part
        want |= plain(part)
    assert got(spark, every) == want


def test_long_ring_and_chain_take_few_jobs(spark):
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("node"), ((F.col("id") + 1) % n).alias("depends_on"))
    chain = spark.range(n, 2 * n).select(F.col("id").alias("node"), (F.col("id") + 1).alias("depends_on"))
    found = components.strongly_connected(ring.union(chain))
    assert found.agg(F.count("*"), F.max("root"), F.max("node")).first() == (n, 0, n - 1)


def test_alias_cycles_of_any_length(spark):
    """Rings of 17, 18, 30 and 300 aliases, tails into them, and long chains that end."""
    edges, want, at = [], set(), 0
    for n in (1, 2, 17, 18, 30, 300):
        ring = list(range(at, at + n))
        edges += [(x, ring[(i + 1) % n]) for i, x in enumerate(ring)] + [(at + n, at), (at + n + 1, at + n)]
        want |= {*ring, at + n, at + n + 1}
        at += 1000
    edges += [(x, x + 1) for x in range(at, at + 500)]
    aliases = spark.createDataFrame(edges, "from_id long, to_id long")
    found = lint.alias_cycles(aliases).collect()
    assert {int(x.subject) for x in found} == want and len(found) == len(want) and {x.code for x in found} == {"ALIAS_CYCLE"}
    several = spark.createDataFrame([*edges, (at, 5), (0, 77_777)], "from_id long, to_id long")
    assert {int(x.subject) for x in lint.alias_cycles(several).collect()} == want | {0}
    assert lint.alias_cycles(aliases.where("false")).collect() == []


def test_cyclic_is_the_nodes_of_the_components(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", None)], "node string, depends_on string")
    assert {x.node for x in graph.cyclic(df).collect()} == {"a", "b"}
