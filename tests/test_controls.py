"""Checks of nested values, audit searches and the graph of plug-ins on small cases."""

import json

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import workflow


def strings(value):
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [s for x in value for s in strings(x)]
    return [s for k, x in value.items() for s in (k, *strings(x))] if isinstance(value, dict) else []


def test_strings_and_keys_at_any_depth(spark):
    cases = ["x", [], {}, {"a": ["b", {"c\\": 'q"uo\\"te\\\\'}], "é": None, "n": [1, True, ["\n\t\u0001ü😀"]]}, {"": ""}, ["\\", '"', '\\"', "\\\\", "/"], {"k" * 50_000: '\\"' * 50_000}, {"password": "= abcdefghijklmnop"}]
    rows = [(i, json.dumps(c, ensure_ascii=bool(i % 2))) for i, c in enumerate(cases)] + [(100, '{"a": "bearer abcdefghijklmnop"'), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "i int, j string")
    got = {r.i: (r.s, r.c) for r in df.select("i", text.content_strings(F.col("j")).alias("s"), text.secret_codes(text.content_text(F.col("j"))).alias("c")).collect()}
    for i, c in enumerate(cases):
        assert got[i][0] == strings(c)
    assert got[7][1] == ["SECRET_ASSIGNMENT"] and got[100][1] == ["SECRET_BEARER"] and got[101] == ([], []) and got[102] == ([""], [])


def test_graph_of_plugins(spark):
    three = "version string, manifest_hash string, package_hash string"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    lock = frame([(p, "1.0.0", "m", "h") for p in "abcdef"] + [("only-locked", "1.0.0", "m", "h")], f"plugin string, {three}")
    scans = frame(
        [("a", "1.0.0", "m", "h", "^1.0.0", None), ("b", "1.0.0", "m", "h", "^1.0.0", "2.x"), ("c", "1.0.0", "other", "h", "^1.0.0", "^1.0.0"), ("d", "1.0.0", "m", "h", "^2.0.0", None), ("e", "1.0.0", "m", "h", None, None),
         ("f", "1.0.0", "m", "h", "^1.0.0", None), ("f", "1.0.0", "m", "h", "^1.0.0", None), ("only-scanned", "1.0.0", "m", "h", "*", None)], f"plugin string, {three}, framework_range string, format_range string")
    needs = frame([("a", "b", "^1.0.0", False), ("a", "c", "^1.0.0", True), ("a", "gone", "*", True), ("a", "d", "^2.0.0", False), ("b", "e", "*", False), ("d", "absent", "*", False), ("e", "a", "nonsense", False)], "plugin string, dependency string, range string, optional boolean")
    bound = frame([("a", "b", "1.0.0", "m", "h"), ("a", "d", "1.0.0", "m", "h"), ("d", "absent", "1.0.0", "m", "h"), ("e", "a", "1.0.0", "m", "h"), ("c", "a", "1.0.0", "m", "h")], f"plugin string, dependency string, {three}")
    got = {tuple(r) for r in workflow.plugin_graph_errors(lock, bound, scans, needs, "1.5.0", "1.0.0").collect()}
    assert got == {
        ("only-locked", None, "GRAPH_INVALID"), ("only-scanned", None, "GRAPH_INVALID"), ("f", None, "GRAPH_INVALID"), ("c", None, "LOCK_MISMATCH"), ("b", None, "DEPENDENCY_INCOMPATIBLE"), ("d", None, "DEPENDENCY_INCOMPATIBLE"), ("e", None, "DEPENDENCY_INCOMPATIBLE"),
        ("a", "c", "LOCK_MISMATCH"), ("a", "d", "DEPENDENCY_INCOMPATIBLE"), ("b", "e", "DEPENDENCY_MISSING"), ("d", "absent", "DEPENDENCY_INCOMPATIBLE"), ("e", "a", "DEPENDENCY_INCOMPATIBLE"), ("c", "a", "LOCK_MISMATCH"),
    }


def test_gaps_and_contradictions(spark):
    from marlstone.operators import retrieval

    schema = "mount_id string, concept_id string, title string, description string, tags array<string>, body string, status string, tier string, stale_after string, source_like boolean"
    row = lambda i, body, source=False, status="stable": ("m", i, i.upper(), None, None, body, status, "unverified", None, source)
    concepts = spark.createDataFrame([row("a", "a TODO here"), row("b", "nothing"), row("s", "the gap of a source", True), row("d", "missing", status="draft"), row("x", "a conflict"), row("y", "Contradiction")], schema)
    mounts = spark.createDataFrame([("m", 0)], "mount_id string, priority int")
    relations = spark.createDataFrame([("m", "x", "y", "contradicting"), ("m", "x", "a", "contradicting"), ("m", "x", "y", "supports")], "mount_id string, concept_id string, target_id string, type string")
    citations = spark.createDataFrame([(i, f"src-{i}", f"h-{i}") for i in "abdsxy"], "concept_id string, source_id string, source_hash string")
    revoked = spark.createDataFrame([("src-d", "none")], "source_id string, source_hash string")
    found, cited = retrieval.gaps(concepts, mounts, relations, citations, revoked)
    assert {r.concept_id for r in found.collect()} == {"a", "s"} and {r.source_id for r in cited.collect()} == {"src-a", "src-s"}
    pairs, cited = retrieval.contradictions(concepts, mounts, relations, citations, revoked)
    assert {(r.concept_id, r.target_id) for r in pairs.collect()} == {("x", "y"), ("y", "x"), ("x", "a"), ("a", "x")}
    assert {r.source_id for r in cited.collect()} == {"src-a", "src-x", "src-y"}
