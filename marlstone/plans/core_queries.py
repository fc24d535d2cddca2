"""One query for each relational operator of the model, over the driver's tables, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import policy, temporal, text
from marlstone.functions.policy import CLASSIFICATIONS
from marlstone.operators import evaluation, governance, graph, lint, relational, retrieval
from marlstone.sources.tables import TABLES, entity, with_entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2026-01-01T00:00:00Z"
TODAY = "2026-01-01"
SEARCH = "the license of er and"
PRIORITIES = (("src0", 200), ("src1", -50))


def query(*entities: str, sql: str | None = None):
    """Registers a query that gets the named entities; its SQL may use them too."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[entity(spark, sf_dir, e) for e in entities])
        if sql:
            head = [e for e in entities if e not in TABLES]
            body = sql.strip()
            if head:
                clauses = "WITH " + ("RECURSIVE " if "WITH RECURSIVE" in body else "") + with_entities(*head)
                body = f"{clauses}, {body.removeprefix('WITH RECURSIVE ').removeprefix('WITH ')}" if body.startswith("WITH ") else f"{clauses} {body}"
            ORACLES[f.__name__] = body
        return f

    return wrap


def source_like(c: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return c.withColumn("source_like", retrieval.source_like(F.concat("area", F.lit("/"), "path"), none)).withColumn("tags", F.lit(None).cast("array<string>")).withColumn("description", none).withColumn("compartments", F.when(F.col("compartment").isNotNull(), F.array("compartment")).otherwise(F.array().cast("array<string>")))


def mounts(c: DataFrame) -> DataFrame:
    p = F.lit(0)
    for m, n in PRIORITIES:
        p = F.when(F.col("mount_id") == m, n).otherwise(p)
    return c.select("mount_id").distinct().withColumn("priority", p)


def sql_terms(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_-]+'))"


SCORED = f"""
 scored AS (SELECT mount_id, concept_id, title, 5 * len(list_intersect({sql_terms(f"'{SEARCH}'")}, {sql_terms("coalesce(title, CAST(concept_id AS VARCHAR))")})) + len(list_intersect({sql_terms(f"'{SEARCH}'")}, {sql_terms("body")})) AS score
   FROM concept WHERE area <> 'references/sources' AND status IN ('stable', 'deprecated')),
 norm AS (SELECT *, score / CAST(max(score) OVER (PARTITION BY mount_id) AS DOUBLE) + CASE mount_id WHEN 'src0' THEN 0.01::DOUBLE WHEN 'src1' THEN -0.005::DOUBLE ELSE 0.0::DOUBLE END AS normalized FROM scored WHERE score > 0),
 top AS (SELECT *, row_number() OVER (ORDER BY normalized DESC, mount_id, concept_id) AS place FROM norm QUALIFY place <= 20)"""


@query("concept", sql=f"WITH {SCORED} SELECT mount_id, concept_id, title, CAST(score AS INTEGER) AS score, round(normalized, 6) AS normalized, CAST(place AS INTEGER) AS place FROM top")
def search_topk_normalized(concept):
    found = retrieval.search(source_like(concept), mounts(concept), SEARCH, today=TODAY)
    return found.select("mount_id", "concept_id", "title", F.col("score").cast("int").alias("score"), F.round("normalized", 6).alias("normalized"), "place")


@query("concept", sql=f"""WITH {SCORED.replace("status IN ('stable', 'deprecated')", "status IN ('stable', 'deprecated') AND tier = 'human-reviewed' AND stale_after = '2030-06-01'")}
SELECT mount_id, concept_id, CAST(place AS INTEGER) AS place FROM top""")
def search_trusted_fresh(concept):
    found = retrieval.search(source_like(concept), mounts(concept), SEARCH, mode="trusted-only", stale_behavior="exclude", today=TODAY)
    return found.select("mount_id", "concept_id", "place")


@query("concept", "relation", sql=f"""WITH {SCORED},
 hop AS (SELECT r.target_id AS concept_id, min(t.place) AS via FROM top t JOIN relation r ON t.concept_id = r.concept_id AND t.mount_id = r.mount_id WHERE r.type IN ('contradicting', 'conflict', 'unresolved') GROUP BY 1),
 more AS (SELECT c.mount_id, c.concept_id, h.via FROM hop h JOIN concept c USING (concept_id) WHERE c.area <> 'references/sources' AND c.status IN ('stable', 'deprecated') AND c.concept_id NOT IN (SELECT concept_id FROM top))
SELECT mount_id, concept_id, CAST(place AS INTEGER) AS place FROM top
UNION ALL SELECT mount_id, concept_id, CAST((SELECT max(place) FROM top) + row_number() OVER (ORDER BY via, mount_id, concept_id) AS INTEGER) FROM more""")
def search_conflict_expansion(concept, relation):
    c = source_like(concept)
    top = retrieval.search(c, mounts(concept), SEARCH, today=TODAY)
    eligible = c.where(retrieval.in_mode("wiki-only", F.col("source_like"), F.col("status"))).select("mount_id", "concept_id", F.lit(None).cast("double").alias("normalized"))
    return retrieval.expanded(top, eligible, relation).select("mount_id", "concept_id", F.col("place").cast("int").alias("place"))


@query("concept", "relation", sql=f"""WITH {SCORED},
 r AS (SELECT concept_id, target_id, type FROM relation WHERE type IN ('contradicting', 'conflict', 'unresolved')),
 b AS (SELECT * FROM r UNION SELECT target_id, concept_id, type FROM r), ids AS (SELECT concept_id FROM concept WHERE classification = 'public')
SELECT concept_id, target_id, type FROM b WHERE concept_id IN (FROM ids) AND target_id IN (FROM ids)""")
def visible_conflicts(concept, relation):
    return retrieval.conflicts(concept.where("classification = 'public'"), relation).select("concept_id", "target_id", "type")


def ranks(c: str) -> str:
    return f"CASE {c} WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'restricted' THEN 3 END"


@query("concept", "principal", sql=f"""SELECT p.principal_id, count(*) AS readable FROM concept c JOIN principal p ON {ranks('p.clearance')} >= {ranks('c.classification')} AND (c.compartment IS NULL OR c.compartment = p.compartment) GROUP BY 1""")
def access_subset(concept, principal):
    p = F.broadcast(principal.select("principal_id", "clearance", F.when(F.col("compartment").isNotNull(), F.array("compartment")).alias("held")))  # four stated rows
    c = source_like(concept).select("classification", "compartments").groupBy("classification", "compartments").agg(F.count("*").alias("n"))
    return c.join(p, policy.may_read(F.col("clearance"), F.col("held"), F.col("classification"), F.col("compartments"))).groupBy("principal_id").agg(F.sum("n").alias("readable"))


@query("concept", sql=f"""SELECT mount_id, CASE WHEN count(*) FILTER (WHERE classification IS NULL) = 0 THEN CASE max({ranks('classification')}) WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'restricted' END END AS required FROM concept GROUP BY 1""")
def most_restricted_by_mount(concept):
    return concept.groupBy("mount_id").agg(policy.most_restricted(F.col("classification")).alias("required"))


@query("lineitem", sql="""SELECT l_orderkey, CASE WHEN bool_or(l_linenumber = 7) THEN NULL WHEN max(l_linenumber % 4) = 0 THEN 'public' WHEN max(l_linenumber % 4) = 1 THEN 'internal' WHEN max(l_linenumber % 4) = 2 THEN 'confidential' ELSE 'restricted' END AS required FROM lineitem GROUP BY 1""")
def most_restricted_by_order(lineitem):
    c = F.when(F.col("l_linenumber") == 7, "unheard-of").otherwise(F.element_at(F.array(*map(F.lit, CLASSIFICATIONS)), F.col("l_linenumber") % 4 + 1))
    return lineitem.groupBy("l_orderkey").agg(policy.most_restricted(c).alias("required"))


@query("documents", sql="SELECT 'sha256:' || sha256(text) AS byte_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def byte_hash_duplicates(documents):
    return relational.duplicates(documents.where("text is not null").select(text.byte_hash(F.col("text")).alias("byte_hash")), "byte_hash")


# every text gets a letter and its accent apart, and line ends of all kinds
@query("documents", sql=r"SELECT doc_id, 'sha256:' || sha256(rtrim(replace(nfc_normalize(text || 'e' || chr(769)), chr(13), chr(10)), chr(10)) || chr(10) || 'x' || chr(10) || 'y' || chr(10)) AS canonical_hash FROM documents")
def canonical_text_hash(documents):
    raw = F.concat("text", F.lit("e\u0301\r\nx\ry\n\n"))
    return documents.select("doc_id", text.byte_hash(text.canonical_text(raw)).alias("canonical_hash"))


# every text gets words in compatibility forms
@query("documents", sql=f"""SELECT doc_id, len({sql_terms("text || ' fine abc 1 12'")}) AS n_terms FROM documents""")
def term_distinct_counts(documents):
    return documents.select("doc_id", F.size(text.terms(F.concat("text", F.lit(" \ufb01ne \uff21\uff22c \u2460 1\u00b2")))).cast("long").alias("n_terms"))


@query("documents", sql=r"""WITH codes(code, p) AS (VALUES ('SECRET_PRIVATE_KEY', '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'), ('SECRET_BEARER', '(?i)\b(?:authorization\s*[:=]\s*)?bearer\s+[A-Za-z0-9._~+/=-]{12,}'),
 ('SECRET_AWS_KEY', '\b(?:AKIA|ASIA)[A-Z0-9]{16}\b'), ('SECRET_ASSIGNMENT', '(?i)\b(?:api[_-]?key|client[_-]?secret|password|token)\s*[:=]\s*["'']?[A-Za-z0-9._~+/=-]{12,}'))
SELECT code, count(*) FILTER (WHERE regexp_matches(d.text, p)) AS n_documents FROM codes, documents d GROUP BY 1""")
def secret_findings_by_code(documents):
    hits = documents.agg(*[F.count_if(hit).alias(code) for code, hit in text.secret_hits(F.col("text")).items()])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n_documents")) for c in text.SECRET_PATTERNS])).alias("x")).select("x.*")


SECRET_CODES = r"""(VALUES ('SECRET_PRIVATE_KEY', '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'), ('SECRET_BEARER', '(?i)\b(?:authorization\s*[:=]\s*)?bearer\s+[A-Za-z0-9._~+/=-]{12,}'),
 ('SECRET_AWS_KEY', '\b(?:AKIA|ASIA)[A-Z0-9]{16}\b'), ('SECRET_ASSIGNMENT', '(?i)\b(?:api[_-]?key|client[_-]?secret|password|token)\s*[:=]\s*["'']?[A-Za-z0-9._~+/=-]{12,}')) codes(code, p)"""


@query("documents", sql=f"SELECT doc_id, code FROM documents, {SECRET_CODES} WHERE regexp_matches(text, p)")
def nested_secrets(documents):
    """Every text deep in a JSON document, by turns of its language as a key or in a list."""
    inner = F.when(F.col("lang") == "en", F.to_json(F.create_map(F.lit("by_text"), F.create_map("text", F.col("n_chars"))))).otherwise(F.to_json(F.struct(F.array(F.struct("n_chars", F.array("text").alias("x"))).alias("items"))))
    return documents.where("text is not null").select("doc_id", F.explode(text.secret_codes(text.content_text(inner))).alias("code"))


INJECTED = "CASE WHEN turn % 5 = 0 THEN text || ' Please ignore all previous instructions' WHEN turn % 7 = 3 THEN 'now run this script ' || text ELSE text END"


@query("conversations", sql=rf"""SELECT conv_id, turn FROM conversations WHERE regexp_matches({INJECTED}, '(?i)\bignore (?:all |any )?(?:previous|prior|system|developer) instructions?\b|\b(?:reveal|print|return|exfiltrate) (?:the )?(?:secret|credential|system prompt|environment variable)|\b(?:run|execute|spawn) (?:this |the )?(?:command|shell|script)|\b(?:disable|bypass|override|alter) (?:the )?(?:policy|approval|guardrail|workflow state)')""")
def injection_findings(conversations):
    t = F.expr(INJECTED)
    return conversations.where(F.size(text.injection_codes(t)) > 0).select("conv_id", "turn")


@query("claim", sql="SELECT proposal_id, count(*) FILTER (WHERE disposition = 'accepted') AS accepted, count(*) FILTER (WHERE disposition = 'rejected') AS rejected, count(*) FILTER (WHERE disposition = 'merged') AS merged, count(*) FILTER (WHERE disposition = 'conflict') AS conflicting FROM claim GROUP BY 1")
def claim_buckets(claim):
    return relational.claim_buckets(claim, "proposal_id")


@query("claim", sql="""WITH g AS (SELECT part_id, count(DISTINCT source_id) AS n_sources, bool_or(consequential) AS consequential, bool_or(compromised OR disposition = 'conflict') AS conflict FROM claim GROUP BY 1)
SELECT part_id, n_sources, consequential, CASE WHEN conflict AND consequential AND n_sources < 20 THEN 'FALSEHOOD_CONFLICT_UNRESOLVED,FALSEHOOD_CORROBORATION_REQUIRED' WHEN conflict THEN 'FALSEHOOD_CONFLICT_UNRESOLVED' WHEN consequential AND n_sources < 20 THEN 'FALSEHOOD_CORROBORATION_REQUIRED' ELSE '' END AS codes FROM g""")
def claim_corroboration(claim):
    return relational.corroboration(claim, "part_id", 20)


@query("claim", "supplier", sql="SELECT c.claim_id FROM claim c LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) s ON c.source_id = s.s_suppkey WHERE s.s_suppkey IS NULL")
def claims_without_evidence(claim, supplier):
    evidence = supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("source_id"))
    return relational.unbound(claim.select("claim_id", "source_id"), evidence, ["source_id"]).select("claim_id")


@query("claim", sql="""WITH d AS (SELECT claim_id, CASE WHEN part_id % 9 = 0 THEN 'accepted' ELSE disposition END AS disposition FROM claim WHERE part_id % 10 <> 0)
SELECT c.claim_id, CASE WHEN d.claim_id IS NULL THEN 'missing-right' ELSE 'differs' END AS state FROM claim c LEFT JOIN d USING (claim_id) WHERE d.claim_id IS NULL OR d.disposition <> c.disposition""")
def claim_decision_mismatch(claim):
    decisions = claim.where("part_id % 10 <> 0").select("claim_id", F.when(F.col("part_id") % 9 == 0, "accepted").otherwise(F.col("disposition")).alias("disposition"))
    return relational.mismatched(claim, decisions, "claim_id", ["disposition"])


MACHINE = "CASE previous WHEN 'queued' THEN state IN ('running', 'cancelled') WHEN 'running' THEN state IN ('completed', 'failed', 'cancelled', 'parked', 'awaiting_input') WHEN 'awaiting_input' THEN state IN ('queued', 'cancelled') WHEN 'parked' THEN state IN ('queued', 'cancelled') ELSE previous IS NULL AND state = 'queued' END"


@query("job_event", sql=f"""WITH l AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM job_event) SELECT event_id, job_id, previous, state FROM l WHERE NOT ({MACHINE})""")
def transition_violations(job_event):
    return relational.transitions(job_event, "job_id", ["ts", "event_id"], relational.JOB_STATES).where("not allowed").select("event_id", "job_id", "previous", "state")


@query("job_event", sql="SELECT event_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS sequence FROM job_event")
def audit_sequence(job_event):
    return relational.sequenced(job_event, "job_id", ["ts", "event_id"]).select("event_id", "job_id", F.col("sequence").cast("long").alias("sequence"))


@query("job_event", sql="""WITH s AS (SELECT event_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS sequence FROM job_event), k AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY job_id ORDER BY sequence), 0) + 1 AS expected FROM s WHERE event_id % 13 <> 0)
SELECT event_id, job_id, sequence, expected FROM k WHERE sequence <> expected""")
def audit_sequence_gaps(job_event):
    kept = relational.sequenced(job_event, "job_id", ["ts", "event_id"]).where("event_id % 13 <> 0")
    return relational.sequence_gaps(kept, "job_id").select("event_id", "job_id", F.col("sequence").cast("long").alias("sequence"), F.col("expected").cast("long").alias("expected"))


@query("job_event", sql="SELECT idempotency_key, count(*) AS requests, count(DISTINCT payload) AS payloads, count(DISTINCT payload) > 1 AS conflict FROM job_event GROUP BY 1")
def idempotency_conflicts(job_event):
    return relational.idempotent(job_event, "idempotency_key", "payload")


@query("job_event", sql="SELECT job_id, max(ts) AS heartbeat, max(ts) + INTERVAL 86400 SECOND <= TIMESTAMP '2024-01-30 00:00:00' AS expired FROM job_event GROUP BY 1")
def lease_expiry(job_event):
    return relational.expired(job_event, "job_id", "ts", 86400, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz" if job_event.schema["ts"].dataType.typeName() == "timestamp_ntz" else "timestamp"))


@query("decision", sql="SELECT proposal_id, receipt_id, decision FROM decision QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY decided_at DESC, receipt_id DESC) = 1")
def latest_decision(decision):
    return relational.latest(decision, "proposal_id", [F.col("decided_at"), F.col("receipt_id")]).select("proposal_id", "receipt_id", "decision")


@query("decision", sql="SELECT proposal_id, receipt_id, lead(receipt_id) OVER (PARTITION BY proposal_id ORDER BY decided_at, receipt_id) AS superseded_by FROM decision")
def supersession_chain(decision):
    return relational.superseded(decision, "proposal_id", ["decided_at", "receipt_id"], "receipt_id").select("proposal_id", "receipt_id", "superseded_by")


@query("documents", sql="SELECT doc_id FROM documents WHERE NOT (doc_id % 4 <> 0 AND doc_id % 10 <> 3)")
def incremental_skip(documents):
    ledger = documents.where("doc_id % 4 <> 0").select("doc_id", text.byte_hash(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return relational.changed(documents, ledger, "doc_id", "text").select("doc_id")


@query("concept", sql="SELECT concept_id, stale_after, stale_after <> '2030-06-01' AS is_stale FROM concept")
def stale_filter(concept):
    return concept.select("concept_id", "stale_after", temporal.is_stale(F.col("stale_after"), F.lit(TODAY)).alias("is_stale"))


@query("orders", sql="SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') <= '1996-06-30' AS is_stale FROM orders")
def stale_orders(orders):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select("o_orderkey", day.alias("day"), temporal.is_stale(day, F.lit("1996-06-30")).alias("is_stale"))


@query("customer", sql="""SELECT c_custkey, 'c_name' AS path, c_name AS before, c_name || '!' AS after FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer WHERE c_custkey % 7 = 0""")
def structural_diff(customer):
    after = customer.withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    return relational.structural_diff(customer, after, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


CLOSED = "WITH RECURSIVE reach AS (SELECT 'region:1' AS node, 0 AS depth UNION ALL SELECT s.surface_id, r.depth + 1 FROM reach r JOIN surface s ON s.depends_on = r.node)"


@query("surface", sql=f"{CLOSED} SELECT node, min(depth) AS depth FROM reach GROUP BY 1")
def impact_closure(surface):
    seeds = surface.where("surface_id = 'region:1'").select(F.col("surface_id").alias("node"))
    return graph.closure(seeds, surface.select(F.col("surface_id").alias("node"), "depends_on"))


@query("surface", sql=f"{CLOSED} SELECT s.kind, count(*) AS n FROM reach r JOIN surface s ON r.node = s.surface_id GROUP BY ROLLUP (s.kind)")
def erasure_counts(surface):
    seeds = surface.where("surface_id = 'region:1'").select(F.col("surface_id").alias("node"))
    hit = graph.closure(seeds, surface.select(F.col("surface_id").alias("node"), "depends_on")).select(F.col("node").alias("surface_id"))
    return governance.treated_counts(surface.join(hit, "surface_id", "left_semi"))


@query("surface", sql="""SELECT surface_id, kind, CASE WHEN kind IN ('concept', 'cache') AND depends_on = 'nation:3' THEN 'hold' WHEN retained_until > '2026-01-01T00:00:00Z' THEN 'retention' END AS blocked_by FROM surface""")
def retention_blocks(surface):
    holds = surface.sparkSession.createDataFrame([("nation:3", ["concept", "cache"], True), ("nation:4", [], False)], "source_id string, kinds array<string>, active boolean")
    return governance.retention(surface.withColumnRenamed("depends_on", "source_id"), holds, F.lit(NOW).cast("timestamp"))


@query("concept", "claim", sql="""WITH c AS (SELECT part_id AS concept_id, CASE WHEN source_id % 17 = 0 THEN NULL ELSE source_id END AS source_id, 'sha256:' || CAST(source_id AS VARCHAR) AS source_hash FROM claim),
 g AS (SELECT concept_id, bool_and(source_id IS NOT NULL AND source_id <> 3 AND source_hash <> 'sha256:5') AS ok FROM c GROUP BY 1)
SELECT k.concept_id FROM concept k JOIN g USING (concept_id) WHERE g.ok""")
def revocation_guard(concept, claim):
    cites = claim.select(F.col("part_id").alias("concept_id"), F.when(F.col("source_id") % 17 != 0, F.col("source_id")).alias("source_id"), F.concat(F.lit("sha256:"), F.col("source_id").cast("string")).alias("source_hash"))
    revoked = concept.sparkSession.createDataFrame([(3, "sha256:none"), (-1, "sha256:5")], "source_id long, source_hash string")
    return retrieval.guarded(concept, cites, revoked).select("concept_id")


@query("alias", sql="""WITH RECURSIVE r AS (SELECT from_id, to_id, 1 AS hops, [from_id] AS seen, from_id = to_id AS cycle FROM alias UNION ALL SELECT r.from_id, a.to_id, hops + 1, list_append(seen, r.to_id), list_contains(seen, a.to_id) OR a.to_id = r.to_id FROM r JOIN alias a ON r.to_id = a.from_id WHERE NOT cycle AND hops < 17),
 m AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY hops DESC) AS k FROM r)
SELECT from_id, to_id, hops, CASE WHEN cycle THEN 'cycle' WHEN hops > 16 THEN 'limit' ELSE 'resolved' END AS state FROM m WHERE k = 1""")
def alias_chain(alias):
    return graph.resolved_aliases(alias)


@query("documents", sql="""WITH p AS (SELECT source || '/' || lang || '/doc-' || CAST(doc_id AS VARCHAR) || '.md' AS path, 'doc-' || CAST(doc_id AS VARCHAR) AS name, source, lang FROM documents),
 r AS (SELECT source || '/' || lang AS directory, name AS title, name || '.md' AS path FROM p UNION ALL SELECT DISTINCT source, upper(lang[1]) || lang[2:], lang || '/' FROM p UNION ALL SELECT DISTINCT '', upper(source[1]) || source[2:], source || '/' FROM p)
SELECT directory, count(*) AS n_rows, '<!-- generated; do not edit -->' || chr(10) || '# ' || CASE WHEN directory = '' THEN 'Knowledge Index' ELSE upper(split_part(directory, '/', -1)[1]) || split_part(directory, '/', -1)[2:] END || chr(10) || chr(10) || string_agg('* [' || title || '](' || path || ')', chr(10) ORDER BY lower(title), path) || chr(10) AS index_text FROM r GROUP BY 1""")
def directory_index(documents):
    c = documents.select(F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("title"), F.lit("").alias("description"))
    return graph.directory_indexes(c).select("directory", F.col("n_rows").cast("long").alias("n_rows"), "index_text")


@query("concept", sql="""SELECT concept_id, t AS target, CASE WHEN t IS NULL THEN 'ambiguous' WHEN t IN ('src0', 'src1') THEN 'write' WHEN t = 'src2' THEN 'proposal' ELSE 'unknown' END AS action
FROM (SELECT concept_id, coalesce(CASE WHEN concept_id % 10 = 0 THEN 'src0' END, CASE WHEN mount_id IN ('src1', 'src2', 'src3') THEN mount_id END, CASE WHEN status = 'draft' THEN 'src1' END) AS t FROM concept)""")
def route_write(concept):
    writable = concept.sparkSession.createDataFrame([("src0", "publish"), ("src1", "maintain"), ("src2", "propose")], "mount_id string, mode string")
    none = F.lit(None).cast("string")
    return relational.routed(concept, F.when(F.col("concept_id") % 10 == 0, "src0"), F.when(F.col("mount_id").isin("src1", "src2", "src3"), F.col("mount_id")), F.when(F.col("status") == "draft", "src1"), none, writable).select("concept_id", "target", "action")


@query("receipt", "probe", sql="""SELECT r.source_id, CASE WHEN coalesce(p.value, '') = '' THEN 'unreachable' WHEN p.kind <> r.kind THEN 'indeterminate' WHEN p.value = r.value THEN 'current' ELSE 'stale' END AS state,
 CASE WHEN coalesce(p.value, '') = '' OR p.kind <> r.kind THEN 'investigate-source' WHEN p.value = r.value THEN 'none' ELSE 'refresh' END AS action FROM receipt r LEFT JOIN probe p USING (source_id)""")
def receipt_staleness(receipt, probe):
    return relational.receipt_states(receipt, probe)


WILSON = "CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, ({s}/{n} + 3.841458820694124::DOUBLE/(2*{n}) - 1.959963984540054::DOUBLE * sqrt(({s}/{n}*(1-{s}/{n}) + 3.841458820694124::DOUBLE/(4*{n}))/{n})) / (1 + 3.841458820694124::DOUBLE/{n})) END"


@query("trial", sql=f"""WITH g AS (SELECT case_key, CAST(count(*) FILTER (WHERE decision = expected) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM trial GROUP BY 1)
SELECT case_key, CAST(s AS BIGINT) AS successes, CAST(n AS BIGINT) AS observations, round(s / n, 9) AS rate, round({WILSON.format(s='s', n='n')}, 9) AS lower, {WILSON.format(s='s', n='n')} >= 0.85 AS passed FROM g""")
def wilson_gate(trial):
    return evaluation.case_results(trial, 0.85).withColumn("rate", F.round("rate", 9)).withColumn("lower", F.round("lower", 9))


@query("trial", sql=f"""WITH g AS (SELECT count(*) FILTER (WHERE decision = expected) AS decisions, count(*) AS observations, count(*) FILTER (WHERE decision = expected AND security_gate) AS secure, count(*) FILTER (WHERE security_gate) AS secure_observations FROM trial)
SELECT *, round({WILSON.format(s='CAST(decisions AS DOUBLE)', n='CAST(observations AS DOUBLE)')}, 9) AS decision_lower, secure = secure_observations AS security_passed FROM g""")
def evaluation_totals(trial):
    return evaluation.metrics(trial).withColumn("decision_lower", F.round("decision_lower", 9))


@query("rights", sql="""WITH c AS (SELECT source_id, unnest([CASE WHEN redistribution = 'unknown' OR coalesce(license, '') = '' THEN 'RIGHTS_LEGAL_REVIEW_REQUIRED' END, CASE WHEN redistribution IN ('prohibited', 'metadata-only') THEN 'RIGHTS_REDISTRIBUTION_PROHIBITED' END,
 CASE WHEN derivative_use <> 'allowed' THEN 'RIGHTS_DERIVATIVE_PROHIBITED' END, CASE WHEN commercial_use <> 'allowed' THEN 'RIGHTS_COMMERCIAL_PROHIBITED' END, CASE WHEN expires_at LIKE '2020-13%' THEN 'RIGHTS_EXPIRY_INVALID' WHEN expires_at LIKE '2020-01%' THEN 'RIGHTS_EXPIRED' END]) AS code FROM rights)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1""")
def rights_findings(rights):
    r = F.struct("redistribution", "license", "terms", "derivative_use", "commercial_use", "expires_at")
    return rights.select(F.explode(policy.rights_codes(r, F.lit("public"), F.lit("derivative"), F.lit(True), F.lit(NOW).cast("timestamp"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


GATES = ", ".join(f"('{s}', '{g}')" for s, gs in governance.GATE_SENSORS.items() for g in gs)


@query("documents", sql=f"""WITH m(sensor, gate) AS (VALUES {GATES}),
 f AS (SELECT 'secret-pattern' AS sensor, doc_id AS subject, 'SECRET_ASSIGNMENT' AS code FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'prompt-injection', doc_id, 'PROMPT_INJECTION' FROM documents WHERE doc_id % 6 = 0)
SELECT gate, subject, NOT bool_or(NOT (sensor = 'secret-pattern' AND gate = 'ingest' AND subject % 2 = 0)) AS allowed, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM f JOIN m USING (sensor) GROUP BY 1, 2""")
def gate_reports(documents):
    d = documents.select(F.col("doc_id").alias("subject"))
    f = d.where("subject % 9 = 0").select(F.lit("secret-pattern").alias("sensor"), F.lit(True).alias("blocking"), "subject", F.lit("SECRET_ASSIGNMENT").alias("code"))
    f = f.union(d.where("subject % 6 = 0").select(F.lit("prompt-injection"), F.lit(True), "subject", F.lit("PROMPT_INJECTION")))
    w = d.where("subject % 2 = 0").select(F.lit("secret-pattern").alias("sensor"), F.lit("ingest").alias("gate"), "subject", F.lit("2030-01-01T00:00:00Z").alias("expires_at"))
    w = w.union(d.select(F.lit("prompt-injection"), F.lit("review"), "subject", F.lit("2020-01-01T00:00:00Z")))
    return governance.gate_report(f, governance.gate_matrix(documents.sparkSession), w, F.lit(NOW).cast("timestamp"))


@query("documents", sql="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'ungoverned' END AS side FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 2 = 0)")
def inventory_coverage(documents):
    return relational.coverage(documents.where("doc_id % 3 = 0"), documents.where("doc_id % 2 = 0"), "doc_id").select("doc_id", "side")


TREE = """ f AS (SELECT source, concat(lang, '/doc-', CAST(doc_id AS VARCHAR), '.md') AS path, text FROM documents),
 p AS (SELECT source, sha256(path)[1:3] AS part, sha256(string_agg(path || chr(0) || sha256(text), chr(10) ORDER BY path || chr(0) || sha256(text))) AS d, count(*) AS n FROM f GROUP BY 1, 2),
 t AS (SELECT source, CAST(sum(n) AS BIGINT) AS n_files, 'sha256:' || sha256(string_agg(part || ':' || d, chr(10) ORDER BY part || ':' || d)) AS tree_hash FROM p GROUP BY 1)"""


def tree_files(documents):
    return documents.select("source", F.concat("lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


@query("documents", sql=f"WITH {TREE} SELECT * FROM t")
def tree_hashes(documents):
    return relational.tree_hash(tree_files(documents), "source", "path", "text")


@query("concept", sql=r"""WITH k AS (SELECT path, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS k FROM concept) SELECT path AS subject, 'DUPLICATE_CANDIDATE' AS code FROM k WHERE k <> '' AND k IN (SELECT k FROM k GROUP BY 1 HAVING count(*) > 1)""")
def lint_duplicate_concepts(concept):
    return lint.duplicate_concepts(concept)


@query("relation", sql="SELECT CAST(concept_id AS VARCHAR) AS subject, 'RELATIONSHIP_UNKNOWN' AS code FROM relation WHERE type NOT IN ('supports', 'contradicting')")
def lint_unknown_relationships(relation):
    return lint.unknown_relationships(relation, ("supports", "contradicting"))


@query("concept", sql="""SELECT path AS subject, 'CONCEPT_STALE' AS code FROM concept WHERE stale_after <> '2030-06-01' UNION ALL SELECT path, 'VERIFICATION_MISSING' FROM concept WHERE status = 'stable' AND tier = 'unverified'""")
def lint_stale_verification(concept):
    return lint.stale_verification(concept, TODAY)


@query("alias", sql="""WITH RECURSIVE r AS (SELECT from_id, to_id, [from_id] AS seen, from_id = to_id AS cycle FROM alias UNION ALL SELECT r.from_id, a.to_id, list_append(seen, r.to_id), list_contains(seen, a.to_id) OR a.to_id = r.to_id FROM r JOIN alias a ON r.to_id = a.from_id WHERE NOT cycle AND len(seen) < 16)
SELECT DISTINCT CAST(from_id AS VARCHAR) AS subject, 'ALIAS_CYCLE' AS code FROM r WHERE cycle""")
def lint_alias_cycles(alias):
    return lint.alias_cycles(alias)


@query("documents", sql="""WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a[^s1] `[^x]`' || chr(10) || '```' || chr(10) || '[^hid]' || chr(10) || '~~~' || chr(10) || '[^too]' || chr(10) || '```' || chr(10) || '[^s2]' WHEN 1 THEN '[^s1] and [^s1]' ELSE 'none' END AS body FROM documents)
SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['s1', 's2'] WHEN 1 THEN ['s1'] ELSE [] END) AS label FROM b""")
def footnote_labels(documents):
    body = F.when(F.col("doc_id") % 3 == 0, "a[^s1] `[^x]`\n```\n[^hid]\n~~~\n[^too]\n```\n[^s2]").when(F.col("doc_id") % 3 == 1, "[^s1] and [^s1]").otherwise("none")
    return documents.select("doc_id", F.explode(text.citations(body)).alias("label"))


@query("documents", sql=r"""SELECT doc_id, unnest(regexp_extract_all(text || ' [a](x/' || CAST(doc_id AS VARCHAR) || '.md?q#f) [b](https://e.org) [c](#top)', '\[[^\]]*\]\((x/[^)?#]+)', 1)) AS link FROM documents""")
def inline_links(documents):
    t = F.concat("text", F.lit(" [a](x/"), F.col("doc_id").cast("string"), F.lit(".md?q#f) [b](https://e.org) [c](#top)"))
    return documents.select("doc_id", F.explode(text.links(t)).alias("link"))


@query("orders", sql=r"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '2024-02-29T23:59:59Z' WHEN 1 THEN '2023-02-29T00:00:00Z' WHEN 2 THEN '2024-01-01T24:00:00Z' WHEN 3 THEN '2024-01-01T00:00:00-00:00' WHEN 4 THEN '2024-01-01T00:00:00.5+14:00' ELSE '2024-01-01T00:00:60Z' END AS s FROM orders)
SELECT o_orderkey, s, o_orderkey % 6 IN (0, 4) AS valid, CASE o_orderkey % 6 WHEN 0 THEN '2024-02-29' WHEN 4 THEN '2023-12-31' END AS day FROM x""")
def instant_validity(orders):
    values = ("2024-02-29T23:59:59Z", "2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00-00:00", "2024-01-01T00:00:00.5+14:00", "2024-01-01T00:00:60Z")
    s = F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return orders.select("o_orderkey", s.alias("s")).select("o_orderkey", "s", temporal.is_instant(F.col("s")).alias("valid"), temporal.utc_date(F.col("s")).alias("day"))


@query("orders", sql="""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 86400 WHEN 1 THEN o_orderkey * 3600 WHEN 2 THEN NULL ELSE o_orderkey END AS secs FROM orders WHERE o_orderkey > 0""")
def duration_seconds(orders):
    d = F.concat(F.when(F.col("o_orderkey") % 4 == 2, F.lit("0")).otherwise(F.lit("")), F.col("o_orderkey").cast("string"), F.element_at(F.array(*map(F.lit, "dhms")), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return orders.where("o_orderkey > 0").select("o_orderkey", temporal.seconds(d).alias("secs"))


@query("part", sql="""SELECT p_partkey, 'kb' || CAST(p_partkey % 5 AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN '1.' || CAST(p_partkey AS VARCHAR) END AS version, 'types/' || CAST(p_size AS VARCHAR) AS concept_id FROM part WHERE p_partkey % 3 <> 0""")
def parsed_references(part):
    ref = F.concat(F.lit("kb://kb"), (F.col("p_partkey") % 5).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("@1."), F.col("p_partkey").cast("string"))).otherwise(""), F.lit("/types/"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "?x").otherwise(".md"))
    return part.select("p_partkey", text.kb_reference(ref).alias("r")).where("r is not null").select("p_partkey", "r.*")


@query("nation", "customer", sql="""SELECT n_nationkey, count(*) AS checks, count(*) FILTER (WHERE c_acctbal < 0) AS failing, NOT bool_or(c_acctbal < 0) AS healthy FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1""")
def health(nation, customer):
    d = nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", F.when(F.col("c_acctbal") < 0, "fail").when(F.col("c_acctbal") < 1000, "warn").otherwise("pass").alias("status"))
    return relational.health(d, "n_nationkey")


@query("decision", "orders", sql="SELECT o.o_custkey AS proposal_id, count(*) AS pending FROM orders o WHERE o.o_custkey NOT IN (SELECT proposal_id FROM decision WHERE decision = 'approved') GROUP BY 1")
def pending_reviews(decision, orders):
    p = orders.select(F.col("o_custkey").alias("proposal_id"))
    return relational.unbound(p, decision.where("decision = 'approved'"), ["proposal_id"]).groupBy("proposal_id").agg(F.count("*").alias("pending"))


@query("documents", sql="""SELECT source, lang, count(*) AS items, CAST(max(b) AS BIGINT) AS bytes, count(*) FILTER (WHERE b <= 20000 AND n <= 15) AS within
FROM (SELECT source, lang, sum(strlen(text)) OVER w AS b, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)) GROUP BY 1, 2""")
def cumulative_caps(documents):
    return relational.within_caps(documents, ["source", "lang"], "doc_id", F.octet_length("text"), 20000, 15)


@query("orders", sql="""WITH p AS (SELECT o_orderkey AS proposal_id, o_orderkey % 2 = 0 AS has, o_orderkey % 3 = 0 AS moved, o_orderkey % 5 = 0 AS lost FROM orders)
SELECT proposal_id, NOT lost AND has AND NOT moved AS allowed, CASE WHEN lost THEN 'current-context-invalid' WHEN has AND moved THEN 'target-revision-drift' WHEN has THEN '' WHEN moved THEN 'receipt-missing,target-revision-drift' ELSE 'receipt-missing' END AS failures FROM p""")
def publication_assessment(orders):
    k = F.col("o_orderkey")
    h = lambda *names: [F.lit("h").alias(n) for n in names]
    packet = F.struct(*h("hash", "proposal_hash", "review_hash", "after_hash", "revision", "sources", "dependencies", "profile", "policies"), F.lit("none").alias("freshness_mode"), F.lit(False).alias("blocked"))
    receipt = F.when(k % 2 == 0, F.struct(F.lit("r").alias("id"), F.lit("approved").alias("decision"), F.lit("s").alias("subject"), F.lit("human:ann").alias("reviewer"), *h("packet_hash", "review_hash", "sources", "dependencies", "profile", "policies")))
    decision = F.when(k % 2 == 0, F.struct(F.lit("h").alias("packet_hash"), F.lit("r").alias("receipt_id"), F.lit("approved").alias("decision"), F.lit(True).alias("proof")))
    concept = F.struct(*[F.lit("x").alias(n) for n in ("type", "title", "description", "status", "generated_by")], F.lit(NOW).alias("generated_at"), F.lit(1).alias("n_sources"), F.lit("timeless").alias("freshness"), F.lit(None).cast("string").alias("stale_after"))
    current = F.when(k % 5 != 0, F.struct(*h("review_hash", "concept_sources", "sources", "dependencies", "profile", "policies", "freshness_hash"), F.when(k % 3 == 0, "moved").otherwise("h").alias("revision"), concept.alias("concept")))
    freshness = F.lit(None).cast("struct<packet_hash:string,value_hash:string,proof:boolean>")
    p = orders.select(k.alias("proposal_id"), F.lit("h").alias("proposal_hash"), F.lit("s").alias("subject"), F.lit("stable").alias("target_status"), packet.alias("packet"), receipt.alias("receipt"), decision.alias("decision"), current.alias("current"), freshness.alias("freshness"))
    return governance.publication(p, F.lit(NOW).cast("timestamp")).withColumn("failures", F.array_join("failures", ","))
