"""What the queries' SQL can't show: errors, limits, recovery, Git trees, streams of sensors that differ."""

import json
import shutil
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from marlstone.functions import canonical
from marlstone.operators import governance, graph, relational, retrieval, review, workflow
from marlstone.plans import fixtures
from marlstone.sources import federation, normalizers, pdf, scan
from marlstone.sources.store import Conflict, SnapshotStore


def git(cwd, *args):
    return subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@e.org", *args], cwd=cwd, check=True, capture_output=True).stdout.decode().strip()


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_git_trees(tmp_path):
    source, folder = tmp_path / "source", tmp_path / "fetch"
    (source / "a").mkdir(parents=True)
    folder.mkdir()
    git(source, "init", "-q", "-b", "main")
    (source / "a/x.md").write_text("one\n")
    (source / "run.sh").write_text("#!\n")
    (source / "run.sh").chmod(0o755)
    git(source, "add", "-A")
    git(source, "commit", "-q", "-m", "first")
    commit, rows = federation.git_tree(f"file://{source}", "main", str(folder))
    assert commit == git(source, "rev-parse", "HEAD") and sorted(rows) == [("a/x.md", "100644", b"one\n"), ("run.sh", "100755", b"#!\n")]
    (source / "link").symlink_to("run.sh")
    git(source, "add", "-A")
    git(source, "commit", "-q", "-m", "second")
    for ref, place in (("main", "again"), ("-x", "unsafe"), ("gone", "gone")):
        (tmp_path / place).mkdir()
        with pytest.raises(canonical.Invalid):
            federation.git_tree(f"file://{source}", ref, str(tmp_path / place))


def test_store_claims_and_recovers(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "store"))
    assert s.state()["revision"] == 0 and s.commit({"t": spark.range(3)}, 0) == 1
    with pytest.raises(Conflict):
        s.commit({"t": spark.range(1)}, 0)
    lost = f"{tmp_path}/store/t/lost"
    spark.range(9).write.parquet(lost)
    assert s._create(f"{tmp_path}/store/claims/{2:012d}", json.dumps({"t": lost}))  # a writer that died
    with pytest.raises(Conflict):
        s.commit({"t": spark.range(5)}, 1)
    assert s.recover() == [2] and not (tmp_path / "store/t/lost").exists() and s.recover() == []
    assert s.commit({"u": spark.range(5)}, 1) == 2 and s.read("t").count() == 3 and s.read("u").count() == 5


def test_documents_are_restricted(monkeypatch):
    def slow(raw):
        yield "line", {"kind": "x"}, "first", None
        time.sleep(5)

    monkeypatch.setitem(normalizers.EXTRACTORS, "text", slow)
    began = time.monotonic()
    (u,) = normalizers.units_of("s", "a.txt", b"x", limits=normalizers.tightened({"processing_ms": 200}))
    assert u["code"] == "limit-exceeded" and time.monotonic() - began < 3

    def large(raw):
        yield "line", {"kind": "x"}, str(len(bytearray(900 << 20))), None

    monkeypatch.setitem(normalizers.EXTRACTORS, "text", large)
    (u,) = normalizers.units_of("s", "a.txt", b"x", limits=normalizers.tightened({"memory_bytes": 100 << 20}))
    assert u["code"] == "limit-exceeded"
    for bad in ({"rows": 200_000}, {"rows": 0}, {"nothing": 1}):
        with pytest.raises(ValueError):
            normalizers.tightened(bad)


def test_pdf_files():
    for packed, objects in ((False, False), (True, False), (True, True)):
        raw = fixtures.pdf([["a (b) \\ c", "é"], [], ["z"]], packed, objects)
        d = pdf.Document(raw)
        assert [[t for _, _, t in pdf.page_blocks(d, p)] for p in d.pages()] == [["a (b) \\ c", "é"], [], ["z"]]
        x, y, _ = next(pdf.page_blocks(d, d.pages()[0]))
        assert (x, y) == (72.0, 700.0)
    code = lambda raw: normalizers.units_of("s", "a.pdf", raw)[0]["code"]
    good = fixtures.pdf([["x"]], False)
    assert code(good) is None and code(good.replace(b"/Catalog", b"/Catalug")) == "malformed" and code(good.replace(b"/Length", b"/Filter /LZWDecode /Length")) == "unsupported"
    assert code(b"%PDF-1.7\n1 0 obj " + b"[" * 500 + b" endobj %%EOF") == "malformed"
    assert pdf.to_unicode(b"2 beginbfchar <01> <0041> <02> <00e9> endbfchar 1 beginbfrange <05> <07> <0061> endbfrange") == {1: "A", 2: "é", 5: "a", 6: "b", 7: "c"}
    assert pdf.unpredicted(bytes([2, 1, 2, 2, 1, 1]), 2) == bytes([1, 2, 2, 3])


def test_one_run_of_an_ingestion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo")
    (tmp_path / "in/b.txt").write_bytes(b"\xff")
    units, receipts, ledger = scan.ingest(spark, str(tmp_path / "in"), None, (".txt",))
    assert units.where("code is null").count() == 2 and receipts.count() == 2 and ledger.count() == 1
    (tmp_path / "in/c.txt").write_text("new")
    units, receipts, after = scan.ingest(spark, str(tmp_path / "in"), ledger, (".txt",))
    assert {r.text for r in units.collect()} == {None, "new"} and after.count() == 2  # the quarantined one is tried again
    assert scan.ingest(spark, str(tmp_path / "in"), after, (".txt",), force=True)[1].count() == 3


@pytest.fixture
def tiny(spark):
    c = spark.createDataFrame([("m", 1, "alpha beta", "stable", "2020-01-01"), ("m", 2, "alpha", "stable", None), ("m", 3, "gamma", "stable", None)], "mount_id string, concept_id long, body string, status string, stale_after string")
    c = c.withColumns({"title": F.lit(""), "description": F.lit(None).cast("string"), "tags": F.array(F.lit("Tag")), "tier": F.lit("unverified"), "source_like": F.lit(False), "classification": F.lit("public"), "compartments": F.array().cast("array<string>")})
    relations = spark.createDataFrame([("m", 2, 3, "Conflict")], "mount_id string, concept_id long, target_id long, type string")
    cites = spark.createDataFrame([(i, f"s{i}", f"h{i}") for i in (1, 2, 3)], "concept_id long, source_id string, source_hash string")
    return c, spark.createDataFrame([("m", 0)], "mount_id string, priority int"), relations, cites, spark.createDataFrame([], "source_id string, source_hash string")


def test_search_as_one_call(spark, tiny):
    ids = lambda a: [r.concept_id for r in a.results.orderBy("place").collect()]
    a = retrieval.answer(*tiny, "alpha BETA tag")
    assert ids(a) == [1, 2, 3] and [r.concept_id for r in a.warnings.collect()] == [1] and a.citations.isEmpty() and a.conflicts.count() == 2
    assert ids(retrieval.answer(*tiny, "alpha", limit=1, include_sources=True, stale_behavior="exclude")) == [2, 3]  # a conflict comes along beyond the limit
    for nothing in ({"stale_behavior": "fail"}, {"generations": (1, 1)}, {"generations": (None, None)}, {"principal": spark.createDataFrame([("unknown", [])], "clearance string, compartments array<string>")}):
        assert ids(retrieval.answer(*tiny, "alpha", **nothing)) == []
    assert ids(retrieval.answer(*tiny, "!!")) == [] and retrieval.answer(*tiny, "alph").results.isEmpty()
    for bad in ({"limit": 0}, {"limit": 101}, {"mode": "all"}, {"minimum_trust": "high"}, {"stale_behavior": "hide"}):
        with pytest.raises(ValueError):
            retrieval.answer(*tiny, "alpha", **bad)
    for args in ((None, " ", ["audit"], 0), (None, "q", [], 0), (None, "q", ["all"], 0), (None, "q", ["audit"], 0, 400_000)):
        with pytest.raises(ValueError):
            retrieval.authorization(*args)


def test_texts_are_read_in_one_pass(spark, sf):
    from marlstone.plans import registry

    plan = registry.queries()["search_conflict_expansion"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.lower().count("documents.parquet") <= 2 and "text#" not in plan


def test_sensors_that_differ_are_an_error(spark):
    rules, calls = governance.Registry(), []

    def flickers(d):
        calls.append(1)
        return d.select(F.col("id").alias("subject"), F.lit("X").alias("code")).limit(2 + len(calls))

    rules.add(governance.Sensor("flickers", flickers))
    with pytest.raises(RuntimeError):  # the second run finds more, which a difference in one direction would miss
        rules.run(spark.range(9), ["flickers"])


def test_errors_of_bounds_and_graphs(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "stage string, needs string")
    for bad in (edges(("a", "b"), ("b", "a")), edges(("a", "gone"))):
        with pytest.raises(ValueError):
            graph.stage_levels(bad)
    with pytest.raises(ValueError):
        relational.bounded(spark.range(5), 4, "rows")
    with pytest.raises(ValueError):
        workflow.scaffold(spark.createDataFrame([("A b", "t", "x.y")], "name string, title string, knowledge_base_id string"))
    with pytest.raises(ValueError):
        graph.traversed(spark.createDataFrame([("a.md", "x")], "path string, content string"))
    holds = spark.createDataFrame([(1, "s", "active", None)] * 2, "hold_id long, source_id string, status string, kinds array<string>")
    with pytest.raises(ValueError):
        review.active_holds(holds, spark.createDataFrame([("s", "cache")], "source_id string, kind string"))


def test_kits_cut_at_utf16_units(spark):
    u = spark.createDataFrame([(1, 1, "a" * 119 + "😀b", "L1"), (1, 2, "😀" * 60, "L2"), (1, 3, "", "L3")], "source_id long, order long, text string, locator string")
    got = {r.kind: r.content for r in workflow.drafting_kit(u, spark.createDataFrame([(1, "T")], "source_id long, title string")).collect()}
    assert got["locators"] == "L1\t" + "a" * 119 + "\nL2\t" + "😀" * 60
    with pytest.raises(ValueError):
        workflow.drafting_kit(u, spark.createDataFrame([(1, "T")], "source_id long, title string"), 1)


def test_a_cluster_has_to_name_its_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from marlstone.operators.stage import shared_folder

    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://x", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        shared_folder(session)
    session.sparkContext.master = "local[2]"
    assert shared_folder(session) == conf["spark.checkpoint.dir"]


def test_external_processors(spark):
    class Store:
        def __init__(self, *objects, stuck=(), broken=()):
            self.objects, self.stuck, self.broken = list(objects), stuck, broken

        def inventory(self, source_id):
            return list(self.objects)

        def delete(self, object_id):
            if object_id in self.broken:
                raise OSError("away")
            if object_id not in self.stuck:
                self.objects.remove(object_id)

        def verify(self, object_id):
            return object_id not in self.objects

    got = review.external_treatments(spark, {"a": Store("x", "y", stuck=("y",)), "b": Store("z", broken=("z",)), "c": Store()}, "s1")
    assert {(r.processor, r.object_id, r.state) for r in got.collect()} == {("a", "x", "deleted"), ("a", "y", "remains"), ("b", "z", "failed")}


def test_plans_of_unknown_sources_are_errors(spark):
    s = spark.createDataFrame([("a", "cache", ["x"], [], [], None)], "surface_id string, kind string, source_ids array<string>, source_hashes array<string>, depends_on array<string>, retained_until string")
    holds = spark.createDataFrame([], "source_id string, kinds array<string>, active boolean")
    with pytest.raises(ValueError):
        review.revocation_plan(s, spark.createDataFrame([("y", "h")], "source_id string, source_hash string"), holds, "erase", F.lit("2026-01-01").cast("timestamp"))
