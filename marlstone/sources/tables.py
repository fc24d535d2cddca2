"""The driver's tables, and entities of the governed model derived from them.

Each derived entity is one SELECT that Spark and DuckDB read alike, so that a query and
its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: entity: (tables or entities that it reads, SELECT)
ENTITIES: dict[str, tuple[tuple[str, ...], str]] = {
    "concept": (("documents", "labels"), """
        SELECT d.source AS mount_id, d.doc_id AS concept_id, concat(d.source, '/', d.lang, '/doc-', CAST(d.doc_id AS STRING), '.md') AS path,
               CASE WHEN d.doc_id % 11 = 0 THEN 'references/sources' ELSE 'concepts' END AS area,
               split_part(d.text, chr(10), 1) AS title, d.text AS body,
               CASE d.doc_id % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'deprecated' ELSE 'stable' END AS status,
               CASE WHEN l.quality = 1 THEN 'human-reviewed' WHEN l.quality = 0 THEN 'machine-confirmed' ELSE 'unverified' END AS tier,
               CASE d.doc_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN 'restricted' ELSE 'public' END AS classification,
               CASE WHEN d.doc_id % 6 = 0 THEN 'nightfall' WHEN d.doc_id % 6 = 1 THEN 'engineering' ELSE NULL END AS compartment,
               CASE WHEN d.doc_id % 9 = 0 THEN '2024-01-15' WHEN d.doc_id % 9 = 1 THEN '2026-02-30' ELSE '2030-06-01' END AS stale_after
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "principal": ((), """
        SELECT * FROM (VALUES ('reader', 'internal', 'engineering'), ('auditor', 'restricted', 'nightfall'), ('guest', 'public', NULL), ('ghost', 'unknown', 'engineering')) AS p(principal_id, clearance, compartment)"""),
    "relation": (("documents",), """
        SELECT source AS mount_id, doc_id AS concept_id, doc_id + 1 AS target_id,
               CASE doc_id % 4 WHEN 0 THEN 'contradicting' WHEN 1 THEN 'supports' WHEN 2 THEN 'unresolved' ELSE 'refines' END AS type
        FROM documents WHERE doc_id % 3 = 0"""),
    "claim": (("lineitem",), """
        SELECT concat('clm_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS claim_id, l_orderkey AS proposal_id, l_suppkey AS source_id, l_partkey AS part_id,
               CASE l_linenumber % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' WHEN 2 THEN 'merged' ELSE 'conflict' END AS disposition,
               l_quantity >= 25 AS consequential, l_returnflag = 'R' AS compromised, l_returnflag AS rights
        FROM lineitem"""),
    "job_event": (("events",), """
        SELECT user_id AS job_id, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'parked' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state,
               concat(event_type, '-', CAST(user_id % 50 AS STRING)) AS idempotency_key, props AS payload
        FROM events"""),
    "surface": (("region", "nation", "supplier", "customer"), """
        SELECT concat('region:', CAST(r_regionkey AS STRING)) AS surface_id, 'source' AS kind, CAST(NULL AS STRING) AS depends_on, '2020-01-01T00:00:00Z' AS retained_until FROM region
        UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), 'index', concat('region:', CAST(n_regionkey AS STRING)), '2020-01-01T00:00:00Z' FROM nation
        UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS STRING)), 'concept', concat('nation:', CAST(s_nationkey AS STRING)), CASE WHEN s_suppkey % 4 = 0 THEN '2031-01-01T00:00:00Z' ELSE '2020-01-01T00:00:00Z' END FROM supplier
        UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING)), 'cache', concat('nation:', CAST(c_nationkey AS STRING)), '2020-01-01T00:00:00Z' FROM customer"""),
    "receipt": (("orders",), """
        SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 5 = 0 THEN 'ctag' ELSE 'etag' END AS kind, CAST(o_custkey AS STRING) AS value FROM orders"""),
    "probe": (("orders",), """
        SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 10 = 0 THEN 'etag' WHEN o_orderkey % 5 = 0 THEN 'ctag' ELSE 'etag' END AS kind,
               CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_custkey AS STRING), '-new') ELSE CAST(o_custkey AS STRING) END AS value
        FROM orders WHERE o_orderkey % 4 <> 0"""),
    "alias": (("part",), """
        SELECT p_partkey AS from_id, CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 2 ELSE p_partkey + 1 END AS to_id FROM part WHERE p_partkey % 5 <> 4 OR p_partkey % 50 = 49"""),
    "decision": (("orders",), """
        SELECT o_custkey AS proposal_id, o_orderkey AS receipt_id, o_orderdate AS decided_at, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'changes-requested' END AS decision FROM orders"""),
    "trial": (("labels",), """
        SELECT doc_id % 30 AS trial, doc_id % 12 AS case_key, CASE WHEN quality = 1 THEN 'answer' ELSE 'abstain' END AS decision, CASE WHEN doc_id % 12 < 9 THEN 'answer' ELSE 'abstain' END AS expected, doc_id % 12 >= 5 AS security_gate FROM labels"""),
    "rights": (("supplier",), """
        SELECT s_suppkey AS source_id, CASE s_suppkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'prohibited' WHEN 2 THEN 'allowed' ELSE 'metadata-only' END AS redistribution,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'CC-BY' END AS license, CAST(NULL AS STRING) AS terms, CASE WHEN s_suppkey % 2 = 0 THEN 'allowed' ELSE 'prohibited' END AS derivative_use,
               CASE WHEN s_suppkey % 5 = 0 THEN 'allowed' ELSE 'prohibited' END AS commercial_use,
               CASE s_suppkey % 6 WHEN 0 THEN '2020-01-01T00:00:00Z' WHEN 1 THEN '2020-13-01T00:00:00Z' WHEN 2 THEN '2031-01-01T00:00:00+02:00' ELSE NULL END AS expires_at
        FROM supplier"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver or a derived entity."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    needs, sql = ENTITIES[name]
    for t in needs:
        sql = _qualified(sql, t)
    return spark.sql(sql, **{f"t_{t}": table(spark, sf_dir, t) for t in needs})


def _qualified(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{t_{name}}}", sql)


def with_entities(*names: str) -> str:
    """WITH clauses (without WITH) for DuckDB."""
    return ", ".join(f"{n} AS ({ENTITIES[n][1].replace('AS STRING', 'AS VARCHAR')})" for n in names)
