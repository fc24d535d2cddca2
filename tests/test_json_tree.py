"""Trees of JSON values: changed leaves, references, and plans without Python."""

import json

from pyspark.sql import functions as F

from marlstone.operators import graph, json_tree
from marlstone.plans import registry


def diffs(spark, cases):
    """The changed leaves of each (before, after), a missing side being null."""
    rows = [(i, *(None if v is ... else json.dumps(v) if not isinstance(v, str) else v for v in case)) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "case int, b string, a string")
    out = [[] for _ in cases]
    for x in json_tree.differences(df, ["case"], F.col("b"), F.col("a")).collect():
        out[x.case].append((x.path, x.before, x.after))
    return [sorted(x, key=repr) for x in out]


def test_changed_leaves(spark):
    cases = [
        ({"blocking": True}, {"blocking": 1}, [("/blocking", "true", "1")]),
        ({}, {"permissions": {"network": True}}, [("/permissions/network", None, "true")]),
        ({"a": {"b": 1}}, {}, [("/a/b", "1", None)]),
        ({"x": {"a": 1}}, {"x": 5}, [("/x/a", "1", None)]),
        ({"x": None}, {}, [("/x", "null", None)]),
        ({"gates": [{"id": "a"}]}, {"gates": [{"id": "b"}]}, [("/gates", '[{"id":"a"}]', '[{"id":"b"}]')]),
        ([{"n": 1}, 2], [{"n": 3}], [("/0/n", "1", "3"), ("/1", "2", None)]),
        ([1, 2], [2, 1], [("", "[1,2]", "[2,1]")]),
        ({"a": 1}, '{"a": 1.0}', []), ('{"a": 1e2}', {"a": 100}, []), ('{"a": 1}', '{"a": 1e22}', [("/a", "1", "1e+22")]), ('{"a": 1}', '{"a": 2.5e-3}', [("/a", "1", "0.0025")]),
        ({"g": [{"id": "a", "n": 1}, {"id": "b"}]}, {"g": [{"id": "b"}, {"id": "a", "n": 2}]}, [("/g/@a/n", "1", "2")]),
        ({"g": [{"id": "a"}, {"id": "a", "n": 1}]}, {"g": [{"id": "a"}]}, [("/g/1/id", '"a"', None), ("/g/1/n", "1", None)]),
        ({"g": [{"name": "a", "n": 1}]}, {"g": [{"metadata": {"id": "a"}, "n": 1}]}, [("/g/@a/metadata/id", None, '"a"'), ("/g/@a/name", '"a"', None)]),
        ({"g": [{"id": 4, "name": "a"}]}, {"g": [{"id": 5, "name": "a"}]}, [("/g/0/id", "4", "5")]),
        ({"g": []}, {"g": 5}, []), ({"g": {}}, {"g": 5}, [("/g", "{}", "5")]), ({"g": {}}, {"g": []}, []), ({"g": []}, {"g": {"a": []}}, []), ({"a": {"b": [[{"c": 1}]]}}, {"a": {"b": [[{"c": 2}]]}}, [("/a/b", '[[{"c":1}]]', '[[{"c":2}]]')]),
        (..., {"a": 1}, [("/a", None, "1")]), (..., ..., []), ({"a": "é"}, {"a": "e"}, [("/a", '"é"', '"e"')]),
    ]
    assert diffs(spark, [x[:2] for x in cases]) == [sorted(x[2], key=repr) for x in cases]


def test_references_at_any_depth(spark):
    docs = ['{"source_id": "s", "in": [{"source_hashes": ["h", 4, ["x"], {"source_id": "deep"}]}]}', '{"source_ids": "one", "source_hash": {"a": "no"}, "other": "z"}', "{bad", "[]", '"source_id"', None]
    df = spark.createDataFrame(list(enumerate(docs)), "path int, content string")
    got = sorted((x.path, x.kind, x.value) for x in json_tree.references(df, ["path"], F.col("content")).collect())
    assert got == [(0, "hash", "h"), (0, "id", "deep"), (0, "id", "s"), (1, "id", "one")]
    bad = sorted((x.path, x.kind) for x in graph.provenance_inventory(df).collect() if x.value is None)
    assert bad == [(2, "unreadable"), (5, "unreadable")]


def test_no_python_in_the_plans(spark, sf):
    for name in ("policy_diff", "provenance_inventory"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_documents_of_one_partition_are_spread(spark, monkeypatch):
    """The first level is parsed by many tasks, however few files the documents are in."""
    from marlstone.operators import json_tree as tree

    parts, write = [], tree.written
    monkeypatch.setattr(tree, "written", lambda df: (parts or parts.append(df.rdd.getNumPartitions()), write(df))[1])
    df = spark.range(20).coalesce(1).selectExpr("id", "'{\"a\":1}' b", "'{\"a\":2}' c")
    got = tree.differences(df, ["id"], df["b"], df["c"])
    assert parts[0] > 1 and sorted(map(tuple, got.collect())) == [(i, "/a", "1", "2") for i in range(20)]
