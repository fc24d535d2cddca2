import pytest
from pyspark.sql import functions as F

from marlstone.operators import governance, graph, lint, retrieval
from marlstone.operators.relational import wilson_lower


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "x")], "node string, depends_on string")
    got = graph.closure(spark.createDataFrame([("a",)], "node string"), e)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_alias_limit_and_cycle(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.from_id: r for r in graph.resolved_aliases(spark.createDataFrame(chain, "from_id int, to_id int")).collect()}
    assert got[4].state == "resolved" and got[4].to_id == 20 and got[4].hops == 16
    assert got[0].state == "limit" and got[100].state == "cycle" and got[200].state == "cycle"


def test_index_text(spark):
    c = spark.createDataFrame([("policies/auth.md", "Auth [x]", "How  to\nlog in"), ("policies/deep/z.md", "", None), ("top.md", "Top", "")], "path string, title string, description string")
    got = {r.directory: r.index_text for r in graph.directory_indexes(c).collect()}
    assert got["policies"] == "<!-- generated; do not edit -->\n# Policies\n\n* [Auth \\[x\\]](auth.md) - How to log in\n* [Deep](deep/)\n"
    assert got[""] == "<!-- generated; do not edit -->\n# Knowledge Index\n\n* [Policies](policies/)\n* [Top](top.md)\n"
    assert got["policies/deep"].endswith("* [z](z.md)\n")
    files = spark.createDataFrame([("index.md", got[""]), ("policies/index.md", "old")], "path string, content string")
    assert {(r.subject, r.code) for r in lint.indexes(c, files).collect()} == {("policies/index.md", "INDEX_DRIFT"), ("policies/deep/index.md", "INDEX_MISSING")}


def knowledge(spark):
    rows = [
        ("m1", "a", "Login policy", "tokens and login", "stable", "human-reviewed", "2030-01-01", False), ("m1", "b", "Other", "login", "stable", "unverified", "2020-01-01", False),
        ("m2", "c", "Login draft", "login", "draft", "human-reviewed", None, False), ("m2", "d", "Opposite", "nothing here", "deprecated", "machine-confirmed", None, False), ("m2", "e", "Login source", "login", None, "human-reviewed", None, True),
    ]
    c = spark.createDataFrame(rows, "mount_id string, concept_id string, title string, body string, status string, tier string, stale_after string, source_like boolean")
    return c.withColumns({"tags": F.lit(None).cast("array<string>"), "description": F.lit(None).cast("string")}), spark.createDataFrame([("m1", 0), ("m2", 10_000)], "mount_id string, priority int")


@pytest.mark.parametrize(("options", "want"), [
    ({}, ["a", "b"]), ({"mode": "exploratory"}, ["c", "e", "a", "b"]), ({"mode": "sources-only"}, ["e"]), ({"mode": "trusted-only"}, ["a"]), ({"mode": "fresh-only"}, ["a"]),
    ({"minimum_trust": "machine-confirmed"}, ["a"]), ({"stale_behavior": "exclude"}, ["a"]), ({"stale_behavior": "fail"}, []), ({"limit": 1}, ["a"]),
])
def test_search_modes(spark, options, want):
    c, m = knowledge(spark)
    got = retrieval.search(c, m, "Login", **options).orderBy("place").collect()
    assert [r.concept_id for r in got] == want


def test_conflicts_go_one_hop_beyond_the_limit(spark):
    c, m = knowledge(spark)
    top = retrieval.search(c, m, "login", limit=1)
    rel = spark.createDataFrame([("m1", "a", "d", "contradicting"), ("m1", "a", "b", "supports"), ("m2", "d", "b", "conflict")], "mount_id string, concept_id string, target_id string, type string")
    eligible = c.where("not source_like").select("mount_id", "concept_id", F.lit(None).cast("double").alias("normalized"))
    got = retrieval.expanded(top, eligible, rel)
    assert [(r.concept_id, r.place) for r in got.orderBy("place").collect()] == [("a", 1), ("d", 2)]
    assert sorted((r.concept_id, r.target_id) for r in retrieval.conflicts(got, rel).collect()) == [("a", "d"), ("d", "a")]


def test_access_precedes_bodies(spark):
    """A body that can't be read fails the query only if an authorized row has it."""
    c = spark.createDataFrame([("a", "public", []), ("n", "restricted", ["nightfall"])], "concept_id string, classification string, compartments array<string>")
    p = spark.createDataFrame([("internal", ["engineering"])], "clearance string, compartments array<string>")
    body = F.when(F.col("concept_id") == "n", F.raise_error(F.lit("read")).cast("string")).otherwise("text")
    assert retrieval.authorized(c, p).withColumn("body", body).select("concept_id", "body").collect() == [("a", "text")]


def test_guard_withholds_unsourced_and_revoked(spark):
    r = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "concept_id string")
    cites = spark.createDataFrame([("a", "s1", "h1"), ("b", "s1", "h1"), ("b", "s2", "h2"), ("c", "s3", None)], "concept_id string, source_id string, source_hash string")
    assert [x[0] for x in retrieval.guarded(r, cites, spark.createDataFrame([("s2", "other")], "source_id string, source_hash string")).collect()] == ["a"]


def test_sensors_must_be_deterministic(spark):
    g = governance.Registry()
    g.add(governance.Sensor("same", lambda d: d.select(F.col("id").alias("subject"), F.lit("X").alias("code"))))
    g.add(governance.Sensor("random", lambda d: d.select(F.rand().alias("subject"), F.lit("X").alias("code"))))
    assert g.run(spark.range(3), ["same"], twice=True).count() == 3
    with pytest.raises(RuntimeError):
        g.run(spark.range(3), ["random"], twice=True)
    with pytest.raises(ValueError):
        g.add(governance.Sensor("same", lambda d: d))


def test_proofs():
    p = governance.proof(b"k", {"a": 1})
    assert governance.proven(b"k", {"a": 1.0}, p) and not governance.proven(b"k", {"a": 2}, p)


def test_wilson_values(spark):
    df = spark.createDataFrame([(360, 360), (90, 90), (30, 30), (0, 0)], "s int, n int")
    assert [r[0] for r in df.select(F.round(wilson_lower(F.col("s"), F.col("n")), 5)).collect()] == [0.98944, 0.95906, 0.88649, None]


def test_lint(spark):
    c = spark.createDataFrame([("a/x.md", "t", "T", "d", "stable", "see [y](y.md) and [^s] and [^q]", "a/x.jsonl", "sha256:0", "h1", True, "2020-01-01", "unverified")], "path string, type string, title string, description string, status string, body string, sidecar_path string, sidecar_hash string, review_hash string, tombstone boolean, stale_after string, tier string")
    files = spark.createDataFrame([("a/x.md", "c"), ("a/x.jsonl", "{}")], "path string, content string")
    sources = spark.createDataFrame([("a/x.md", "s", "local.pdf"), ("a/x.md", "w", "https://e.org")], "path string, id string, resource string")
    codes = lambda df: [r.code for r in df.collect()]
    assert codes(lint.ungrounded(c, sources)) == ["CITATION_UNGROUNDED"] and codes(lint.source_resolvability(sources, files)) == ["SOURCE_UNRESOLVED"]
    assert codes(lint.sidecars(c, files)) == ["CLAIM_SIDECAR_DRIFT"] and codes(lint.broken_links(c, files)) == ["LINK_BROKEN"] and codes(lint.lifecycle(c)) == ["LIFECYCLE_INVALID"]
    assert codes(lint.review_binding(c, spark.createDataFrame([("a/x.md", "h0")], "path string, review_hash string"))) == ["MODIFIED_AFTER_REVIEW"]
    assert codes(lint.conformance(c)) == [] and codes(lint.profile(c)) == []
    mounts = spark.createDataFrame([("l", False), ("r", True)], "mount_id string, remote boolean")
    assert sorted(r.severity for r in lint.lock_drift(mounts, mounts.where("false")).collect()) == ["error", "warning"]
    leases = spark.createDataFrame([("x", 1)], "resource string, expires_at int")
    jobs = spark.createDataFrame([("j", "{bad")], "job_id string, record string")
    assert sorted(codes(lint.workflow_integrity(leases, jobs, F.lit(2)))) == ["JOB_RECORD_INVALID", "LOCK_STALE"]


def test_streams(spark, tmp_path):
    from marlstone.sources.tables import entity
    from marlstone.streaming import audit

    source = str(tmp_path / "events")
    entity(spark, "/root/testdata/sf0.001", "job_event").withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for name, df in {"dedup": audit.deduplicated(stream), "states": audit.job_states(stream)}.items():
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    keys = spark.read.parquet(source).select("idempotency_key").distinct().count()
    assert spark.table("dedup").count() == keys
    assert spark.table("states").count() == 1000


def test_provenance_spreads_its_sources(spark):
    """Ids are counted and met in as many parts as the session has at least, however small their rows are."""
    from marlstone.operators import workflow

    h, g = "sha256:" + "0" * 64, "sha256:" + "1" * 64
    sources = spark.createDataFrame([("a", "1", h), ("a", "1", h), ("a", "2", "x"), ("b", "1", h), ("b", "2", None)], "path string, id string, source_hash string")
    sidecar = spark.createDataFrame([("a", "3", h), ("b", "1", g), ("b", "2", None)], "path string, source_entry_id string, source_hash string")
    concepts = spark.createDataFrame([("a", False), ("c", False), ("d", True)], "path string, source_exempt boolean")
    found = workflow.provenance_failures(concepts, sources, sidecar)
    assert sorted(map(tuple, found.collect())) == [("a", "CLAIM_SOURCE_UNKNOWN"), ("a", "SOURCE_DUPLICATE"), ("a", "SOURCE_HASH_INVALID"), ("b", "CLAIM_HASH_MISMATCH"), ("c", "SOURCE_MISSING")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [path") == 2
