"""Queries of the lint sensors, trust and connectors, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import policy, text
from marlstone.operators import lint, workflow
from marlstone.sources import scan

from . import core_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(*entities, sql):
    def wrap(f):
        out = core_queries.query(*entities, sql=sql)(f)
        QUERIES[f.__name__] = core_queries.QUERIES.pop(f.__name__)
        ORACLES[f.__name__] = core_queries.ORACLES.pop(f.__name__)
        return out

    return wrap


def path(c: str = "doc_id"):
    return F.concat(F.lit("kb/c-"), F.col(c).cast("string"), F.lit(".md"))


P = "'kb/c-' || CAST(doc_id AS VARCHAR) || '.md'"


@query("documents", sql=f"SELECT {P} AS subject, 'CONCEPT_NONCONFORMANT' AS code FROM documents WHERE doc_id % 8 IN (0, 1)")
def lint_conformance(documents):
    return lint.conformance(documents.select(path().alias("path"), F.when(F.col("doc_id") % 8 == 0, "").when(F.col("doc_id") % 8 != 1, "note").alias("type")))


@query("documents", sql=f"SELECT {P} AS subject, 'PROFILE_FIELD_MISSING' AS code FROM documents WHERE doc_id % 9 = 2")
def lint_profile(documents):
    return lint.profile(documents.select(path().alias("path"), F.lit("note").alias("type"), F.lit("t").alias("title"), F.when(F.col("doc_id") % 9 != 2, "d").alias("description"), F.lit("stable").alias("status")))


@query("documents", sql=f"SELECT {P} AS subject, 'SOURCE_UNRESOLVED' AS code FROM documents WHERE doc_id % 4 = 1 AND doc_id % 3 <> 0")
def lint_source_resolvability(documents):
    k = F.col("doc_id")
    s = documents.select(path().alias("path"), F.when(k % 4 == 0, "https://e.org/x").when(k % 4 == 1, F.concat(F.lit("s/"), k.cast("string"))).otherwise("urn:x:y").alias("resource"))
    return lint.source_resolvability(s, documents.where("doc_id % 3 = 0").select(F.concat(F.lit("s/"), k.cast("string")).alias("path")))


@query("documents", sql=f"SELECT {P} AS subject, 'CITATION_UNGROUNDED' AS code FROM documents WHERE doc_id % 5 = 0")
def lint_ungrounded_claims(documents):
    k = F.col("doc_id")
    c = documents.select(path().alias("path"), F.concat("text", F.lit("\n[^a] "), F.when(k % 5 == 0, "[^b] [^b]").otherwise("`[^b]`")).alias("body"))
    return lint.ungrounded(c, documents.select(path().alias("path"), F.lit("a").alias("id")))


@query("documents", sql=f"SELECT {P} AS subject, 'CLAIM_SIDECAR_DRIFT' AS code FROM documents WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0")
def lint_claim_sidecars(documents):
    k = F.col("doc_id")
    side = F.concat(F.lit("kb/c-"), k.cast("string"), F.lit(".jsonl"))
    c = documents.select(path().alias("path"), F.when(k % 2 == 0, side).alias("sidecar_path"), text.byte_hash(F.col("text")).alias("sidecar_hash"))
    return lint.sidecars(c, documents.where("doc_id % 6 <> 2").select(side.alias("path"), F.when(k % 6 == 0, F.col("text")).otherwise("changed").alias("content")))


@query("documents", sql=f"SELECT {P} AS subject, 'LINK_BROKEN' AS code FROM documents WHERE (doc_id + 1) % 7 = 0 OR doc_id + 1 NOT IN (SELECT doc_id FROM documents)")
def lint_broken_links(documents):
    c = documents.select(path().alias("path"), F.concat(F.lit("see [next](c-"), (F.col("doc_id") + 1).cast("string"), F.lit(".md#top), [web](https://e.org), [root](/kb/c-1.md)")).alias("body"))
    return lint.broken_links(c, documents.where("doc_id % 7 <> 0").select(path().alias("path")))


@query("documents", sql=f"SELECT {P} AS subject, 'MODIFIED_AFTER_REVIEW' AS code FROM documents WHERE doc_id % 10 = 4")
def lint_review_binding(documents):
    h = text.byte_hash(F.col("text"))
    return lint.review_binding(documents.select(path().alias("path"), h.alias("review_hash")), documents.where("doc_id % 2 = 0").select(path().alias("path"), F.when(F.col("doc_id") % 10 == 4, "sha256:old").otherwise(h).alias("review_hash")))


@query("concept", sql="SELECT path AS subject, 'LIFECYCLE_INVALID' AS code FROM concept WHERE status = 'stable' AND concept_id % 4 = 0")
def lint_lifecycle(concept):
    return lint.lifecycle(concept.withColumn("tombstone", F.col("concept_id") % 4 == 0))


@query("supplier", sql="SELECT CAST(s_suppkey AS VARCHAR) AS subject, 'LOCK_MISSING' AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM supplier WHERE s_suppkey % 3 <> 0")
def lint_lock_drift(supplier):
    m = supplier.select(F.col("s_suppkey").alias("mount_id"), (F.col("s_suppkey") % 2 == 0).alias("remote"))
    return lint.lock_drift(m, m.where("mount_id % 3 = 0"))


@query("orders", "events", sql="""SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'LOCK_STALE' AS code FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01 00:00:00' UNION ALL SELECT CAST(event_id AS VARCHAR), 'JOB_RECORD_INVALID' FROM events WHERE event_id % 20 = 3""")
def lint_workflow_integrity(orders, events):
    leases = orders.select(F.col("o_orderkey").alias("resource"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))
    jobs = events.select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 20 == 3, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("record"))
    return lint.workflow_integrity(leases, jobs, F.lit("1996-01-01 00:00:00"))


@query("documents", sql="""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'human-reviewed' WHEN 1 THEN 'machine-confirmed' WHEN 2 THEN 'machine-confirmed' ELSE 'unverified' END AS tier FROM documents""")
def trust_tiers(documents):
    k = F.col("doc_id") % 5
    event = lambda by, at: F.struct(F.lit(by).alias("by"), F.lit(at).alias("at"))
    v = F.when(k == 0, F.array(event("process:ci", "2024-01-01T00:00:00Z"), event("human:ann", "2024-01-01T00:00:00Z"))).when(k == 1, F.array(event("human:ann", "2030-01-01T00:00:00Z"), event("lab/model-1", "2024-01-01T00:00:00Z"))).when(k == 2, F.array(event("process:ci", "2024-01-01T00:00:00Z"))).when(k == 3, F.array(event("ann", "2024-01-01T00:00:00Z")))
    return documents.select("doc_id", policy.trust_tier(v, F.lit("2026-01-01T00:00:00Z").cast("timestamp")).alias("tier"))


@query("orders", sql="""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'provider' WHEN 2 THEN 'revision.kind,content_hash' ELSE 'acquired_at,access_context.visibility' END AS failures FROM orders""")
def descriptor_failures(orders):
    k = F.col("o_orderkey") % 4
    d = F.struct(
        F.when(k == 1, "ftp").otherwise("confluence").alias("provider"), F.col("o_orderkey").cast("string").alias("remote_id"), F.when(k == 2, "etag").otherwise("version").alias("revision_kind"), F.lit("7").alias("revision_value"), F.lit("api").alias("acquired_via"),
        F.when(k == 3, "2024-02-30T00:00:00Z").otherwise("2024-02-29T00:00:00Z").alias("acquired_at"), F.when(k == 2, "md5:0").otherwise(F.concat(F.lit("sha256:"), F.sha2(F.col("o_orderkey").cast("string"), 256))).alias("content_hash"), F.when(k != 3, "internal").alias("visibility"),
    )
    return orders.select("o_orderkey", F.array_join(scan.descriptor_failures(d), ",").alias("failures"))


@query("customer", sql="SELECT c_name AS name FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1")
def config_secrets(customer):
    k = F.col("c_custkey") % 3
    v = F.when(k == 0, F.concat(F.lit("https://u:p@"), F.lower("c_mktsegment"))).when(k == 1, F.substring(F.sha2(F.col("c_name"), 256), 1, 40)).otherwise("GRAPH_CLIENT_SECRET_NAME")
    return scan.config_secrets(customer.select(F.col("c_name").alias("name"), v.alias("value")))


@query("supplier", sql="""SELECT 'MOUNT_DUPLICATE' AS code, 'm' || CAST(s_suppkey % 40 AS VARCHAR) AS subject FROM supplier GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'PRIMARY_COUNT', CAST(count(*) AS VARCHAR) FROM supplier WHERE s_suppkey % 50 = 0 HAVING count(*) <> 1 UNION ALL SELECT 'ROUTE_UNKNOWN', 'nowhere'""")
def project_semantics(supplier):
    m = supplier.select(F.concat(F.lit("m"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.lit("maintain").alias("mode"), F.when(F.col("s_suppkey") % 50 == 0, "primary").otherwise("secondary").alias("role"))
    return workflow.project_errors(m, supplier.sparkSession.createDataFrame([("m1",), ("nowhere",)], "target string"))


@query("claim", "supplier", sql="""SELECT DISTINCT 'p' || CAST(proposal_id % 100 AS VARCHAR) AS path, CASE WHEN source_id % 5 = 0 THEN 'CLAIM_SOURCE_UNKNOWN' ELSE 'CLAIM_HASH_MISMATCH' END AS code FROM claim WHERE source_id % 5 = 0 OR source_id % 7 = 0""")
def provenance_failures(claim, supplier):
    page = F.concat(F.lit("p"), (F.col("proposal_id") % 100).cast("string"))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("source_id").cast("string"), 256))
    c = claim.select(page.alias("path"), "source_id").distinct()
    sources = c.where("source_id % 5 <> 0").select("path", F.col("source_id").cast("string").alias("id"), digest.alias("source_hash"))
    sidecar = c.select("path", F.col("source_id").cast("string").alias("source_entry_id"), F.when(F.col("source_id") % 7 == 0, "sha256:" + "0" * 64).otherwise(digest).alias("source_hash"))
    return workflow.provenance_failures(c.select("path").distinct().withColumn("source_exempt", F.lit(True)), sources, sidecar)
