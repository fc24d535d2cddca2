"""Queries over governed records (search as one call, review, publication, jobs, erasure, evaluation), beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import canonical, policy, temporal, text
from marlstone.operators import evaluation, governance, graph, json_tree, lint, relational, retrieval, review, workflow
from marlstone.operators.spans import numbered
from marlstone.operators.stage import written
from marlstone.sources import store

from . import core_queries as core

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2026-01-01T00:00:00Z"


def query(*entities, sql):
    def wrap(f):
        out = core.query(*entities, sql=sql)(f)
        QUERIES[f.__name__] = core.QUERIES.pop(f.__name__)
        ORACLES[f.__name__] = core.ORACLES.pop(f.__name__)
        return out

    return wrap


def now():
    return F.lit(NOW).cast("timestamp")


def pick(c, *values):
    """The value at a remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def js(c: str) -> str:
    """A text as a JSON string, in DuckDB."""
    return f"CAST(to_json({c}) AS VARCHAR)"


# --- search -----------------------------------------------------------------------------

GUARDED = f"""{core.SCORED.replace("FROM concept WHERE", "FROM concept WHERE classification IN ('public', 'internal') AND compartment IS NULL AND")},
 hop AS (SELECT r.target_id AS concept_id, min(t.place) AS via FROM top t JOIN relation r ON t.concept_id = r.concept_id AND t.mount_id = r.mount_id WHERE r.type IN ('contradicting', 'conflict', 'unresolved') GROUP BY 1),
 may AS (SELECT * FROM concept WHERE classification IN ('public', 'internal') AND compartment IS NULL AND area <> 'references/sources' AND status IN ('stable', 'deprecated')),
 more AS (SELECT c.mount_id, c.concept_id, h.via FROM hop h JOIN may c USING (concept_id) WHERE c.concept_id NOT IN (SELECT concept_id FROM top)),
 shown AS (SELECT mount_id, concept_id, normalized, place FROM top UNION ALL SELECT mount_id, concept_id, 0, (SELECT coalesce(max(place), 0) FROM top) + row_number() OVER (ORDER BY via, mount_id, concept_id) FROM more)"""


def _answer(concept, relation, **more):
    c = core.source_like(concept)
    principal = concept.sparkSession.createDataFrame([("internal", [])], "clearance string, compartments array<string>")
    k = F.col("concept_id")
    cites = concept.select("concept_id", F.when(k % 13 != 0, k).alias("source_id"), F.concat(F.lit("sha256:"), k.cast("string")).alias("source_hash"))
    revoked = concept.sparkSession.createDataFrame([(3, "sha256:none"), (-1, "sha256:8")], "source_id long, source_hash string")
    return retrieval.answer(c, core.mounts(concept), relation, cites, revoked, core.SEARCH, principal=principal, today=core.TODAY, **more)


@query("concept", "relation", sql=f"""WITH {GUARDED}
SELECT mount_id, concept_id, round(CAST(normalized AS DOUBLE), 6) AS score, CAST(place AS INTEGER) AS place FROM shown WHERE concept_id % 13 <> 0 AND concept_id NOT IN (3, 8)""")
def guarded_search(concept, relation):
    return _answer(concept, relation).results.select("mount_id", "concept_id", "score", "place")


@query("concept", "relation", sql=f"""WITH {GUARDED}
SELECT 'STALE' AS code, concept_id FROM shown JOIN concept USING (mount_id, concept_id) WHERE stale_after <> '2030-06-01' AND concept_id % 13 <> 0 AND concept_id NOT IN (3, 8)
UNION ALL SELECT 'CITATION', concept_id FROM shown WHERE concept_id % 13 <> 0 AND concept_id NOT IN (3, 8)""")
def search_warnings_and_citations(concept, relation):
    a = _answer(concept, relation, include_sources=True)
    return a.warnings.select("code", "concept_id").union(a.citations.select(F.lit("CITATION"), "concept_id"))


@query("concept", "relation", sql="SELECT concept_id FROM concept WHERE false")
def search_during_a_revocation(concept, relation):
    """An odd or changed generation of the barrier shows nothing."""
    return _answer(concept, relation, generations=(3, 3)).results.select("concept_id").union(_answer(concept, relation, generations=(2, 4)).results.select("concept_id"))


@query("documents", sql="SELECT doc_id, doc_id % 11 = 0 OR doc_id % 4 = 1 AS source_like FROM documents")
def source_like_concepts(documents):
    k = F.col("doc_id")
    return documents.select("doc_id", retrieval.source_like(F.when(k % 11 == 0, "references/sources/a.md").otherwise("concepts/a.md"), pick(k, "Note", "Evidence Table", None, "Guide")).alias("source_like"))


@query("concept", sql="""WITH c AS (SELECT * FROM concept WHERE mount_id IN ('src0', 'src1') AND concept_id % 3 <> 0) SELECT 'concept' AS kind, concept_id FROM c UNION ALL SELECT 'source', concept_id FROM c WHERE concept_id % 2 = 0""")
def granted_concepts_and_sources(concept):
    k = F.col("concept_id")
    mounts = concept.select(F.lit("mount").alias("level"), "mount_id", F.lit(None).cast("long").alias("id"), F.when(F.col("mount_id") == "src1", "audit").alias("mode")).where("mount_id in ('src0', 'src1', 'src2')").withColumn("mode", F.when(F.col("mount_id") == "src2", "refresh").otherwise(F.col("mode"))).distinct()
    own = concept.where("concept_id % 3 <> 0").select(F.lit("concept"), "mount_id", k, F.lit(None).cast("string"))
    sources = concept.where("concept_id % 2 = 0").select(F.lit("source"), "mount_id", k, F.lit("audit"))
    c, s = retrieval.granted(concept, concept.select("mount_id", "concept_id", k.alias("source_id")), mounts.union(own).union(sources), "audit")
    return c.select(F.lit("concept").alias("kind"), "concept_id").union(s.select(F.lit("source"), "concept_id"))


@query("customer", sql="SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN 'mismatched' WHEN c_custkey % 2 = 0 THEN 'expired' ELSE 'valid' END AS state FROM customer")
def authorization_states(customer):
    token = retrieval.authorization({"clearance": "internal"}, "q", ["audit", "wiki-only"], 1_000, 60_000)
    k = F.col("c_custkey")
    s = customer.select("c_custkey", F.lit(token["principal_hash"]).alias("principal_hash"), F.lit(token["query"]).alias("query"), F.array(*map(F.lit, token["modes"])).alias("modes"), (F.lit(token["expires_ms"]) + F.when(k % 2 == 0, 0).otherwise(1)).alias("expires_ms"),
        F.when(k % 5 != 0, F.lit(token["principal_hash"])).alias("asked_hash"), F.when(k % 5 == 1, "other").otherwise("q").alias("asked_query"), F.when(k % 5 == 2, "refresh").otherwise("audit").alias("asked_mode"))
    return retrieval.authorization_state(s, F.lit(61_000)).select("c_custkey", "state")


@query("concept", sql="""SELECT concept_id AS request_id, CASE WHEN concept_id % 4 IN (0, 1) AND concept_id % 5 <> 0 THEN 'ok' ELSE 'not_found' END AS status, CASE WHEN concept_id % 4 IN (0, 1) AND concept_id % 5 <> 0 THEN 'kb://' || mount_id || '@r1/c' || CAST(concept_id AS VARCHAR) END AS uri,
 CASE WHEN concept_id % 4 IN (0, 1) AND concept_id % 5 <> 0 THEN sha256(body) END AS body_hash FROM concept""")
def fetched_by_uri(concept):
    k = F.col("concept_id")
    name = F.concat(F.lit("c"), k.cast("string"))
    requests = concept.select(k.alias("request_id"), F.concat(F.lit("kb://"), "mount_id", pick(k, "", "@r1", "@r2", "/x"), F.lit("/"), name).alias("uri"))
    have = concept.select("mount_id", name.alias("concept_id"), "body", text.byte_hash(F.when(k % 5 == 0, F.lit("changed")).otherwise(F.col("body"))).alias("byte_hash"))
    found = retrieval.fetched_by_uri(requests, concept.select("mount_id", F.lit("r1").alias("resolved_ref")).distinct(), have)
    return found.select("request_id", "status", "uri", F.sha2(F.col("body").cast("binary"), 256).alias("body_hash"))


@query("customer", sql="SELECT c_custkey, c_custkey % 4 = 0 AS allowed FROM customer")
def stable_reads(customer):
    k = F.col("c_custkey")
    return retrieval.stable_reads(customer.select("c_custkey", pick(k, 2, 3, 2, None).alias("before"), pick(k, 2, 3, 4, 2).alias("after"))).select("c_custkey", "allowed")


@query("supplier", sql="SELECT s_suppkey AS mount_id, CAST(row_number() OVER (ORDER BY s_suppkey % 3 DESC, s_suppkey) AS INTEGER) AS place FROM supplier")
def mount_order(supplier):
    return retrieval.mount_order(supplier.select(F.col("s_suppkey").alias("mount_id"), (F.col("s_suppkey") % 3).alias("priority"))).select("mount_id", "place")


# --- values and text --------------------------------------------------------------------


@query("documents", sql="SELECT doc_id, CAST(strlen(CAST(to_json(text || chr(9) || '\"' || chr(92) || chr(1)) AS VARCHAR)) AS INTEGER) AS json_bytes FROM documents")
def json_sizes(documents):
    return documents.select("doc_id", text.json_size(F.concat("text", F.lit('\t"\\\x01'))).cast("int").alias("json_bytes"))


@query("events", sql="SELECT event_id, event_id % 120 <= 100 AND event_id % 7 <> 0 AS plain FROM events")
def plain_json_guard(events):
    d, k = (F.col("event_id") % 120).cast("int"), F.col("event_id")
    nested = F.concat(F.repeat(F.lit("["), d), "props", F.repeat(F.lit("]"), d))
    return events.select("event_id", canonical.plain_json(F.when(k % 7 == 0, F.concat(nested, F.lit("]"))).otherwise(nested)).alias("plain"))


@query("documents", sql="SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN sha256(nfc_normalize(text || 'e' || chr(769))) END AS digest FROM documents")
def strict_texts(documents):
    raw = F.concat(F.encode(F.concat("text", F.lit("é")), "UTF-8"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("EDA080"))).otherwise(F.unhex(F.lit(""))))
    return documents.select("doc_id", F.sha2(text.strict_text(raw).cast("binary"), 256).alias("digest"))


@query("documents", sql=r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g')) || ' 1 fine') AS digest FROM documents")
def canonical_answers(documents):
    """A text and an ending, each canonical by itself: of a blank text the blank between them stays. An ideographic space takes every text through NFKC."""
    parts = text.canonical_answer(F.concat(F.lit(" \n"), "text", F.lit("\u3000\t "))), text.canonical_answer(F.lit(" ① ﬁne "))
    return documents.select("doc_id", F.sha2(F.concat(parts[0], F.lit(" "), parts[1]).cast("binary"), 256).alias("digest"))


@query("customer", sql=r"SELECT c_custkey, 'topics/' || CAST(c_custkey AS VARCHAR) || '-' || regexp_replace(lower(c_name), '[^a-z0-9/_-]+', '-', 'g') AS path FROM customer")
def subject_paths(customer):
    return customer.select("c_custkey", text.subject_path(F.concat(F.lit("!Topics/"), F.col("c_custkey").cast("string"), F.lit(" & "), "c_name", F.lit("??"))).alias("path"))


@query("orders", sql="SELECT o_orderkey, o_orderkey % 6 IN (0, 5) AS valid FROM orders")
def utc_timestamps(orders):
    values = ("2024-02-29T23:59:59Z", "2023-02-29T00:00:00Z", "2024-01-01T00:00:00+00:00", "2024-01-01T23:59:60Z", "2024-01-01", None)
    return orders.select("o_orderkey", temporal.is_utc(pick(F.col("o_orderkey"), *values)).alias("valid"))


@query("part", sql="""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a b/c' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'a+b' ELSE NULL END AS id FROM part""")
def clean_concept_ids(part):
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit("a%20b/c"), k.cast("string"), F.lit(".md"))).otherwise(pick(k, "", "a+b", "a/../b", "a%2F%2Fb", "a%zz", "/a\\b"))
    return part.select("p_partkey", text.clean_concept_id(raw).alias("id"))


@query("part", sql="""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'kb://a/x' WHEN 1 THEN 'kb://a/b@2/x' WHEN 2 THEN 'kb://a@/b/x' ELSE 'plain' END AS living, CASE p_partkey % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a~b' WHEN 2 THEN 'a~1' ELSE 'x' END AS pointer FROM part""")
def living_references(part):
    k = F.col("p_partkey")
    return part.select("p_partkey", text.living_reference(pick(k, "kb://a@1.0/x", "kb://a@1/b@2/x", "kb://a@/b@3/x", "plain")).alias("living"), text.pointer_unescape(pick(k, "a~1b", "a~0b", "a~01", "x")).alias("pointer"))


MERGED = "'{\"a\":{\"b\":' || CAST(event_id % 5 AS VARCHAR) || ',\"c\":2},\"k\":' || (props->>'$.k') || ',\"l\":[3]}'"


@query("events", sql=f"""SELECT event_id, {MERGED} AS merged, CASE WHEN event_id % 5 = 1 THEN '{{"a":{{"b":9}},"l":[1,2]}}' END AS replaced FROM events""")
def json_edits(events):
    k = F.col("event_id")
    base = F.concat(F.lit('{"l":[1,2],"a":{"b":'), (k % 5).cast("string"), F.lit("}}"))
    patch = F.concat(F.lit('{"a":{"c":2},"l":[3],"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return events.select("event_id", canonical.merged_json(base, patch).alias("merged"), canonical.replaced_json(base, F.lit("/a/b"), F.lit("1"), F.lit("9")).alias("replaced"))


@query("events", sql="""SELECT event_id, 'a,e' || CAST(event_id AS VARCHAR) || ',source_ids,s1,s2,n,source_hash,h' AS strings, 'hash:h,id:s1,id:s2' AS refs FROM events""")
def json_strings_and_references(events):
    v = F.concat(F.lit('{"a":"e'), F.col("event_id").cast("string"), F.lit('","source_ids":["s1","s2"],"n":[{"source_hash":"h"},4]}'))
    refs = json_tree.references(events, ["event_id"], v).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit(":"), "value"))), ",").alias("refs"))
    return events.select("event_id", F.array_join(canonical.string_list(v), ",").alias("strings")).join(refs, "event_id")


@query("events", sql="""WITH e AS (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events)
SELECT event_id, '/gates' AS path, '[{"id":"b"}]' AS before, '[{"id":"a"}]' AS after FROM e UNION ALL SELECT event_id, '/k', CAST(k AS VARCHAR), CAST(event_id AS VARCHAR) FROM e WHERE k <> event_id
UNION ALL SELECT event_id, '/limits/network', NULL, 'true' FROM e UNION ALL SELECT event_id, '/on', 'true', '1' FROM e UNION ALL SELECT event_id, '/steps/@s1/n', '1', '2' FROM e UNION ALL SELECT event_id, '/steps/@s2/n', '5', NULL FROM e""")
def policy_diff(events):
    before = F.concat(F.lit('{"on":true,"gates":[{"id":"b"}],"steps":[{"id":"s1","n":1},{"id":"s2","n":5}],"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    after = F.concat(F.lit('{"on":1,"limits":{"network":true},"gates":[{"id":"a"}],"steps":[{"id":"s1","n":2}],"k":'), F.col("event_id").cast("string"), F.lit("}"))
    found = json_tree.differences(events, ["event_id"], before, after)
    return found.where("path <> '/steps/@s2/id'")


@query("customer", sql="""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'effective-sandbox' WHEN c_custkey % 4 = 1 THEN 'isolation' WHEN c_custkey % 4 = 2 THEN 'credential,filesystem-scope,memory-ceiling,network-scope' ELSE '' END AS gaps FROM customer""")
def sandbox_gaps(customer):
    k = F.col("c_custkey") % 4
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    grant = lambda root, access: F.array(F.struct(F.lit(root).alias("root"), F.lit(access).alias("access")))
    wanted = F.struct(F.when(k == 1, "none").otherwise("sandboxed").alias("isolation"), grant("data", "read").alias("filesystem"), strings("e.org").alias("network"), strings().alias("credentials"), F.lit(True).alias("subprocess"), F.lit(False).alias("macros"), F.lit(10).alias("memory"), F.lit(5).alias("cpu"), F.lit(5).alias("output"))
    given = F.struct((k != 0).alias("effective"), F.when(k == 2, strings("filesystem", "network", "resources")).otherwise(strings(*workflow.BOUNDARIES)).alias("enforced"), F.when(k == 2, grant("other", "write")).otherwise(grant("data", "write")).alias("filesystem"), F.when(k == 2, strings()).otherwise(strings("e.org")).alias("network"),
        strings().alias("credentials"), F.lit(True).alias("subprocess"), F.lit(False).alias("macros"), F.when(k == 2, 9).otherwise(10).alias("memory"), F.lit(5).alias("cpu"), F.lit(5).alias("output"))
    return customer.select("c_custkey", F.array_join(workflow.sandbox_gaps(wanted, given), ",").alias("gaps"))


# --- contracts, permissions, routes ----------------------------------------------------------


@query("orders", sql="""SELECT o_orderkey, 'day' AS path, 'format' AS rule FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'min_length' FROM orders WHERE length(o_orderpriority) < 6 UNION ALL SELECT o_orderkey, 'o_orderstatus', 'const' FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_orderkey, 'tags', 'max_items' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'tags', 'unique' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'tags', 'min_items' FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, 'tags', 'needs' FROM orders WHERE o_orderkey % 7 = 0""")
def contract_errors_of_lists_and_formats(orders):
    k = F.col("o_orderkey")
    d = orders.select(k, "o_orderpriority", "o_orderstatus", F.when(k % 5 == 0, "2023-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("tags"), F.when(k % 7 != 0, "x").alias("owner"))
    return workflow.contract_errors(d, "o_orderkey", {"day": {"format": "date"}, "o_orderpriority": {"min_length": 6}, "o_orderstatus": {"const": "O"}, "tags": {"min_items": 1, "max_items": 2, "unique": True, "needs": "owner"}})


@query("concept", sql="""SELECT concept_id, role, action, CASE WHEN role = 'governance-reviewer' THEN action = 'read' WHEN action = 'write' THEN mount_id = 'src0' ELSE true END AS allowed FROM concept, (VALUES ('governance-reviewer', 'read'), ('governance-reviewer', 'write'), ('integrator', 'read'), ('integrator', 'write')) r(role, action)""")
def reviewers_never_write(concept):
    r = concept.select("concept_id", "path", F.explode(F.array(*[F.struct(F.lit(a).alias("role"), F.lit(b).alias("action")) for a in ("governance-reviewer", "integrator") for b in ("read", "write")])).alias("r")).select("concept_id", "path", "r.*")
    roles = {a: {"read": ("**",), "write": ("src0/**",)} for a in ("governance-reviewer", "integrator")}
    return workflow.permitted(r, roles, ("governance-reviewer",)).select("concept_id", "role", "action", "allowed")


@query("customer", sql="SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 2 = 0 OR c_mktsegment = 'BUILDING' AS allowed FROM customer")
def scoped_operations(customer):
    scopes = customer.sparkSession.createDataFrame([("BUILDING", "read"), ("BUILDING", "write"), ("MACHINERY", "read")], "scope string, operation string")
    return workflow.scoped(customer.select("c_custkey", F.col("c_mktsegment").alias("scope"), F.when(F.col("c_custkey") % 2 == 0, "read").otherwise("write").alias("operation")), scopes).select("c_custkey", "allowed")


@query("supplier", sql="""SELECT 'MOUNT_DUPLICATE' AS code, 'm' || CAST(s_suppkey // 2 AS VARCHAR) AS subject FROM supplier WHERE s_suppkey % 10 < 2 GROUP BY s_suppkey // 2 HAVING count(*) > 1 UNION ALL SELECT 'PRIMARY_COUNT', CAST(count(*) FILTER (WHERE s_suppkey % 5 = 0) AS VARCHAR) FROM supplier HAVING count(*) FILTER (WHERE s_suppkey % 5 = 0) <> 1
UNION ALL SELECT 'ROUTE_UNKNOWN', 'm' || CAST(s_suppkey + 1000000 AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'RISK_POLICY_MISSING', 'p' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 0""")
def project_errors(supplier):
    k = F.col("s_suppkey")
    mounts = supplier.select(F.concat(F.lit("m"), F.when(k % 10 < 2, F.expr("s_suppkey div 2")).otherwise(k + 500_000).cast("string")).alias("name"), F.lit("maintain").alias("mode"), F.when(k % 5 == 0, "primary").otherwise("dependency").alias("role"))
    routes = supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("m"), (k + 1_000_000).cast("string")).alias("target"))
    settings = supplier.select(F.concat(F.lit("p"), k.cast("string")).alias("name"), F.when(k % 2 == 0, "risk-based").otherwise("publish-only").alias("approval_policy"), F.when(k % 4 != 0, "r").alias("risk_policy"))
    return workflow.project_errors(mounts, routes, settings)


# --- gates and sensors ----------------------------------------------------------------------


@query("documents", sql="""SELECT gate, doc_id AS subject, CASE WHEN doc_id % 7 = 0 THEN 'CLASSIFICATION_MISSING' WHEN gate = 'retrieval' AND doc_id % 2 = 0 THEN 'ACCESS_DENIED' WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'DECLASSIFICATION_REQUIRED' WHEN doc_id % 3 = 1 AND gate <> 'retrieval' THEN 'DERIVED_CLASSIFICATION_MISSING' END AS code FROM documents, (VALUES ('review'), ('retrieval')) g(gate)""")
def classification_findings(documents):
    k = F.col("doc_id")
    d = documents.select("doc_id", F.explode(F.array(F.lit("review"), F.lit("retrieval"))).alias("gate"))
    codes = review.classification_codes(F.col("gate"), F.when(k % 7 != 0, "confidential"), F.when(k % 3 == 0, "internal").when(k % 3 == 2, "restricted"), k % 2 == 1, k % 5 == 0)
    return d.select("gate", F.col("doc_id").alias("subject"), F.get(codes, 0).alias("code"))


@query("customer", sql="SELECT c_custkey AS id, c_custkey % 4 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS issued FROM customer")
def declassification_tokens(customer):
    k = F.col("c_custkey")
    r = customer.select(k.alias("id"), F.lit("s").alias("subject"), pick(k, "confidential", "internal", "public", "confidential").alias("from_class"), pick(k, "internal", "internal", "restricted", "public").alias("to_class"), F.lit("p").alias("policy_ref"), F.lit("officer").alias("role"), F.when(k % 3 != 0, "why").otherwise("").alias("reason"), F.when(k % 5 == 0, "2025-01-01T00:00:00Z").otherwise("2027-01-01T00:00:00Z").alias("expires_at"))
    rules = customer.sparkSession.createDataFrame([("p", "officer", "confidential", "internal"), ("p", "officer", "internal", "internal"), ("p", "officer", "public", "restricted")], "policy_ref string, role string, from_class string, to_class string")
    return review.declassifications(r, rules, now()).select("id", "issued")


@query("customer", sql="SELECT c_custkey AS id, c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AS issued FROM customer")
def waiver_tokens(customer):
    k = F.col("c_custkey")
    r = customer.select(k.cast("string").alias("id"), F.lit("secret-pattern").alias("sensor"), pick(k, "ingest", "publication", "ingest").alias("gate"), F.lit("s").alias("subject"), pick(k, "officer", "officer", "reader").alias("role"), F.lit("why").alias("reason"), F.when(k % 5 == 0, NOW).otherwise("2027-01-01T00:00:00Z").alias("expires_at"))
    roles = customer.sparkSession.createDataFrame([("secret-pattern", "ingest", "officer")], "sensor string, gate string, role string")
    return review.issued_waivers(r, roles, now()).select(F.col("id").cast("long").alias("id"), "issued")


@query("documents", sql=f"""WITH m(sensor, gate) AS (VALUES {core.GATES}), f AS (SELECT 'secret-pattern' AS sensor, doc_id AS subject, 'SECRET_ASSIGNMENT' AS code FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'prompt-injection', doc_id, 'PROMPT_INJECTION' FROM documents WHERE doc_id % 6 = 0),
 r AS (SELECT gate, subject, false AS allowed, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM f JOIN m USING (sensor) GROUP BY 1, 2)
SELECT gate, subject, 'sha256:' || sha256('{{"allowed":false,"codes":"' || codes || '","gate":"' || gate || '","policy_hash":"p1","subject":"' || CAST(subject AS VARCHAR) || '"}}') AS report_hash FROM r""")
def sensor_run_reports(documents):
    """Sensors through the registry, which runs each twice; the gates' verdicts and their hashes."""
    rules = governance.Registry()
    hits = lambda n, code: lambda d: d.where(F.col("subject") % n == 0).select("subject", F.lit(code).alias("code"))
    rules.add(governance.Sensor("secret-pattern", hits(9, "SECRET_ASSIGNMENT")))
    rules.add(governance.Sensor("prompt-injection", hits(6, "PROMPT_INJECTION")))
    found = rules.run(documents.select(F.col("doc_id").alias("subject")), ["secret-pattern", "prompt-injection"])
    none = documents.sparkSession.createDataFrame([], "sensor string, gate string, subject long, expires_at string")
    reports = governance.gate_report(found, governance.gate_matrix(documents.sparkSession), none, now())
    return review.hashed_reports(reports, "p1").select("gate", "subject", "report_hash")


@query("claim", sql="""WITH g AS (SELECT part_id, count(DISTINCT source_id) AS n, bool_or(consequential) AS c, bool_or(compromised OR disposition = 'conflict') AS x, bool_or(source_id % 7 = 0 AND part_id % 2 = 0) AS s FROM claim GROUP BY 1)
SELECT part_id, concat_ws(',', CASE WHEN s THEN 'AUTHORITY_METADATA_UNTRUSTED' END, CASE WHEN x THEN 'FALSEHOOD_CONFLICT_UNRESOLVED' END, CASE WHEN c AND n < 3 THEN 'FALSEHOOD_CORROBORATION_REQUIRED' END) AS codes FROM g""")
def spoofed_authority(claim):
    c = claim.withColumns({"source_class": F.when(F.col("source_id") % 7 == 0, "authoritative").otherwise("secondary"), "authority_policy_ref": F.when(F.col("part_id") % 2 != 0, "p")})
    return relational.corroboration(c, "part_id", 3).select("part_id", "codes")


@query("claim", sql="""SELECT proposal_id, list_sort(list(DISTINCT source_id)) AS materials, count(*) AS claims, count(*) FILTER (WHERE source_id % 4 = 0 OR source_id % 3 = 0) AS unknown_sources, count(*) FILTER (WHERE disposition = 'conflict') AS conflicts FROM claim GROUP BY 1""")
def gate_inputs(claim):
    evidence = claim.where("source_id % 4 <> 0").select("source_id", F.when(F.col("source_id") % 3 == 0, "unknown").otherwise("primary").alias("source_class")).distinct()
    return review.gate_input(claim, evidence)


@query("lineitem", sql="""SELECT l_orderkey, list_sort(list_distinct(flatten(list(CASE WHEN l_linenumber % 2 = 0 THEN ['a', l_returnflag] ELSE ['b'] END)))) AS compartments, list_sort(list(DISTINCT 'attribution:' || CAST(l_suppkey AS VARCHAR))) AS obligations FROM lineitem GROUP BY 1""")
def propagated_metadata(lineitem):
    m = lineitem.select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("a"), "l_returnflag")).otherwise(F.array(F.lit("b"))).alias("compartments"), F.array(F.concat(F.lit("attribution:"), F.col("l_suppkey").cast("string"))).alias("obligations"))
    return governance.propagated(m, "l_orderkey")


# --- review and publication -------------------------------------------------------------------

PACKETS = """ b AS (SELECT CAST(proposal_id AS VARCHAR) AS p, disposition AS d, list_sort(list(claim_id)) AS ids FROM claim GROUP BY 1, 2),
 s AS (SELECT CAST(proposal_id AS VARCHAR) AS p, list_sort(list(DISTINCT CAST(source_id AS VARCHAR))) AS sources FROM claim GROUP BY 1),
 k AS (SELECT s.p AS proposal_id, '{"claims":{"accepted":' || coalesce((SELECT replace(CAST(to_json(ids) AS VARCHAR), ' ', '') FROM b WHERE b.p = s.p AND d = 'accepted'), '[]') || ',"conflict":' || coalesce((SELECT CAST(to_json(ids) AS VARCHAR) FROM b WHERE b.p = s.p AND d = 'conflict'), '[]')
   || ',"merged":' || coalesce((SELECT CAST(to_json(ids) AS VARCHAR) FROM b WHERE b.p = s.p AND d = 'merged'), '[]') || ',"rejected":' || coalesce((SELECT CAST(to_json(ids) AS VARCHAR) FROM b WHERE b.p = s.p AND d = 'rejected'), '[]') || '},"codes":' || CASE WHEN CAST(s.p AS INTEGER) % 3 = 0 THEN '["A","B"]' ELSE '[]' END
   || ',"proposal":"' || s.p || '","review_hash":"h' || s.p || '","revision":"r1","sources":' || CAST(to_json(sources) AS VARCHAR) || '}' AS packet FROM s)"""


def packets_of(claim, revision="r1"):
    p = F.col("proposal_id").cast("string")
    proposals = claim.select(p.alias("proposal_id")).distinct().select("proposal_id", F.concat(F.lit("h"), "proposal_id").alias("review_hash"), F.lit(revision).alias("revision"))
    sensors = claim.where("proposal_id % 3 = 0").select(p.alias("proposal_id"), F.explode(F.array(F.lit("B"), F.lit("A"))).alias("code"), (F.col("proposal_id") % 2 == 0).alias("blocking"))
    return review.review_packets(proposals, claim.withColumn("proposal_id", p), sensors)


@query("claim", sql=f"WITH {PACKETS} SELECT proposal_id, packet, CAST(proposal_id AS INTEGER) % 6 = 0 AS blocked, 'sha256:' || sha256(packet) AS packet_hash FROM k")
def review_packets(claim):
    return packets_of(claim)


@query("claim", sql=f"""WITH {PACKETS} SELECT 'rc' || proposal_id AS receipt_id, proposal_id, CASE WHEN CAST(proposal_id AS INTEGER) % 5 IN (1, 2) THEN 'refused' ELSE 'issued' END AS state,
 CASE WHEN CAST(proposal_id AS INTEGER) % 5 NOT IN (1, 2) THEN 'sha256:' || sha256('{{"decision":"approved","id":"rc' || proposal_id || '","packet_hash":"sha256:' || sha256(packet) || '","proposal":"' || proposal_id || '","reviewed_at":"2026-01-01T00:00:00Z","reviewer":"human:ann"}}') END AS receipt_hash FROM k""")
def review_receipts(claim):
    p = written(packets_of(claim))
    k = F.col("proposal_id").cast("int") % 5
    d = p.select(F.concat(F.lit("rc"), "proposal_id").alias("receipt_id"), "proposal_id", F.lit("approved").alias("decision"), F.when(k == 1, "process:bot").otherwise("human:ann").alias("reviewer"), F.when(k == 2, "2026-01-01").otherwise(NOW).alias("reviewed_at"))
    return review.review_receipts(p, d).select("receipt_id", "proposal_id", "state", "receipt_hash")


@query("orders", sql="""WITH g AS (SELECT CAST(o_orderkey AS VARCHAR) AS p, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'denied' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'granted' END AS state, 'sha256:' || sha256('"' || strftime(o_orderdate, '%Y-%m-%d') || '"') AS v FROM orders)
SELECT p AS proposal_id, CASE WHEN state = 'granted' THEN v END AS value_hash, CASE WHEN state = 'granted' THEN 'sha256:' || sha256('{"actor":"human:ann","packet_hash":"k' || p || '","proposal":"' || p || '","value_hash":"' || v || '"}') END AS authorization_hash, state FROM g""")
def freshness_authorizations(orders):
    k, p = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    packets = orders.select(p.alias("proposal_id"), F.concat(F.lit("k"), p).alias("packet_hash"), F.when(k % 2 == 0, "reviewed").otherwise("separate").alias("freshness_mode"))
    requests = orders.select(p.alias("proposal_id"), F.when(k % 3 == 0, "integrator").otherwise("governance-reviewer").alias("role"), F.lit("human:ann").alias("actor"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("stale_after"), F.lit("a0").alias("expected_hash"))
    return review.freshness_authorizations(packets, requests, orders.select(p.alias("proposal_id"), F.when(k % 5 == 0, "a1").otherwise("a0").alias("authorization_hash")))


@query("claim", sql=f"""WITH {PACKETS} SELECT proposal_id, CASE WHEN CAST(proposal_id AS INTEGER) % 4 = 0 THEN 'review-input-drift' WHEN CAST(proposal_id AS INTEGER) % 4 = 1 THEN 'denied' ELSE 'prepared' END AS state,
 CASE WHEN CAST(proposal_id AS INTEGER) % 4 > 1 THEN '{{"packet_hash":"sha256:' || sha256(packet) || '","prepared_at":"2026-01-01T00:00:00Z","proposal":"' || proposal_id || '","receipt":"rc' || proposal_id || '"}}' END AS intent FROM k""")
def prepared_publications(claim):
    stored, k = written(packets_of(claim)), F.col("proposal_id").cast("int") % 4
    other = packets_of(claim, "r2").where(k == 0)
    again = stored.where(k != 0).unionByName(other)
    return review.prepared(stored, again, stored.select("proposal_id", (k != 1).alias("allowed")), stored.select("proposal_id", F.concat(F.lit("rc"), "proposal_id").alias("receipt_id")), NOW)


@query("documents", sql="""WITH p AS (SELECT doc_id, 'c/' || CAST(doc_id AS VARCHAR) || '.md' AS path FROM documents) SELECT path, 'h' AS expected_review_hash, CASE WHEN doc_id % 2 = 0 THEN 'h2' ELSE 'h' END AS current_review_hash, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'invalid' WHEN doc_id % 2 = 0 THEN 'candidate' ELSE 'unneeded' END AS state FROM p""")
def reconciled_edits(documents):
    k, path = F.col("doc_id"), F.concat(F.lit("c/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    approvals = documents.select(path, F.when(k % 5 == 0, "rejected").otherwise("approved").alias("decision"), F.lit("h").alias("review_hash"), F.when(k % 7 == 0, "x").otherwise("h").alias("packet_review_hash"))
    return review.reconciled(documents.select(path, F.when(k % 2 == 0, "h2").otherwise("h").alias("review_hash")), approvals)


CODES = ("active-decision-changes-requested", "active-decision-drift", "blocking-sensor", "concept-source-drift", "current-dependency-drift", "current-policy-drift", "current-profile-drift", "current-source-drift", "dependency-binding-drift", "freshness-authorization-invalid", "freshness-trust-proof-invalid", "human-review-required", "missing-description", "missing-future-freshness", "missing-generation", "missing-source", "missing-status", "missing-title", "missing-type",
    "packet-hash-drift", "packet-proposal-drift", "packet-review-hash-invalid", "policy-binding-drift", "profile-binding-drift", "receipt-changes-requested", "receipt-subject-drift", "review-binding-drift", "review-content-drift", "review-trust-proof-invalid", "source-binding-drift", "target-revision-drift")


@query("orders", sql=f"""WITH c AS (SELECT unnest([{", ".join(f"'{c}'" for c in CODES)}]) AS code, generate_subscripts([{", ".join(f"'{c}'" for c in CODES)}], 1) - 1 AS n)
SELECT o_orderkey AS proposal_id, CASE WHEN o_orderkey % {len(CODES) + 2} = {len(CODES)} THEN 'active-decision-missing' WHEN o_orderkey % {len(CODES) + 2} = {len(CODES) + 1} THEN '' WHEN code = 'active-decision-changes-requested' THEN code || ',active-decision-drift' WHEN code = 'receipt-changes-requested' THEN 'active-decision-changes-requested,' || code ELSE code END AS failures FROM orders LEFT JOIN c ON o_orderkey % {len(CODES) + 2} = n""")
def publication_codes(orders):
    """Every code of the assessment: one field of otherwise sound bindings is off in each proposal. A decision that asks for changes drifts from its approving receipt, and one with such a receipt is named with it."""
    n = len(CODES) + 2
    k = F.col("o_orderkey") % n
    at = {c: i for i, c in enumerate(CODES)}
    off = lambda code, name, bad="x", good="h": F.when(k == at[code], F.lit(bad)).otherwise(F.lit(good)).alias(name)
    both = lambda codes, name, bad="x", good="h": F.when(k.isin(*[at[c] for c in codes]), F.lit(bad)).otherwise(F.lit(good)).alias(name)
    h = lambda *names: [F.lit("h").alias(x) for x in names]
    packet = F.struct(off("packet-proposal-drift", "proposal_hash"), *h("hash", "review_hash", "revision", "sources", "dependencies", "profile", "policies"), off("packet-review-hash-invalid", "after_hash"), both(("freshness-authorization-invalid", "freshness-trust-proof-invalid"), "freshness_mode", "separate", "none"), (k == at["blocking-sensor"]).alias("blocked"))
    receipt = F.struct(F.lit("r").alias("id"), off("receipt-changes-requested", "decision", "changes-requested", "approved"), off("receipt-subject-drift", "subject", "x", "s"), off("human-review-required", "reviewer", "process:x", "human:ann"), off("packet-hash-drift", "packet_hash"), off("review-binding-drift", "review_hash"),
        off("source-binding-drift", "sources"), off("dependency-binding-drift", "dependencies"), off("profile-binding-drift", "profile"), off("policy-binding-drift", "policies"))
    decision = F.when(k != len(CODES), F.struct(off("active-decision-drift", "packet_hash"), F.lit("r").alias("receipt_id"), both(("active-decision-changes-requested", "receipt-changes-requested"), "decision", "changes-requested", "approved"), (k != at["review-trust-proof-invalid"]).alias("proof")))
    gone = lambda code, name: F.when(k != at[code], F.lit("x")).alias(name)
    concept = F.struct(*[gone(f"missing-{x}", x) for x in ("type", "title", "description", "status")], gone("missing-generation", "generated_by"), F.lit(NOW).alias("generated_at"), F.when(k == at["missing-source"], 0).otherwise(1).alias("n_sources"), F.when(k != at["missing-future-freshness"], "timeless").alias("freshness"), F.lit("2026-01-01").alias("stale_after"))
    current = F.struct(off("review-content-drift", "review_hash"), off("target-revision-drift", "revision"), off("concept-source-drift", "concept_sources"), off("current-source-drift", "sources"), off("current-dependency-drift", "dependencies"), off("current-profile-drift", "profile"), off("current-policy-drift", "policies"), *h("freshness_hash"), concept.alias("concept"))
    freshness = F.struct(off("freshness-authorization-invalid", "packet_hash"), *h("value_hash"), (k != at["freshness-trust-proof-invalid"]).alias("proof"))
    p = orders.select(F.col("o_orderkey").alias("proposal_id"), F.lit("h").alias("proposal_hash"), F.lit("s").alias("subject"), F.lit("stable").alias("target_status"), packet.alias("packet"), receipt.alias("receipt"), decision.alias("decision"), current.alias("current"), freshness.alias("freshness"))
    return governance.publication(p, now()).select("proposal_id", F.array_join("failures", ",").alias("failures"))


@query("documents", sql="""WITH c AS (SELECT doc_id, 'k/' || CAST(doc_id AS VARCHAR) || '.md' AS path, 't' || CAST(doc_id AS VARCHAR) AS title, 'sha256:' || sha256(text) AS h FROM documents)
SELECT 'catalog' AS kind, path, title, CASE WHEN doc_id % 5 = 0 AND (doc_id % 3 = 0) THEN 'sha256:' || sha256('new') ELSE h END AS value FROM c WHERE doc_id % 3 <> 0 UNION ALL SELECT 'catalog', path, title, 'sha256:' || sha256('new') FROM c WHERE doc_id % 15 = 0
UNION ALL SELECT 'state', path, title, CASE WHEN doc_id % 3 = 0 THEN 'published' ELSE 'exists' END FROM c WHERE doc_id % 5 = 0""")
def published_catalog(documents):
    k = F.col("doc_id")
    c = documents.select(F.concat(F.lit("k/"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.lit("").alias("description"), text.byte_hash(F.col("text")).alias("byte_hash"), "doc_id")
    after, states = workflow.published(c.where("doc_id % 3 <> 0").drop("doc_id"), c.where("doc_id % 5 = 0").select("path", "title", "description", F.lit("new").alias("content"), F.lit(True).alias("creates")))
    return after.select(F.lit("catalog").alias("kind"), "path", "title", F.col("byte_hash").alias("value")).union(states.join(c.select("path", "title"), "path").select(F.lit("state"), "path", "title", "state"))


@query("part", sql="SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'new' END AS inserted, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 <> 0 THEN 'new' ELSE 'old' END AS replaced FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def immutable_puts(part):
    old = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.lit("old").alias("v"))
    new = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.lit("new").alias("v"))
    return store.merged(old, new, ["k"], False).withColumnRenamed("v", "inserted").join(store.merged(old, new, ["k"], True).withColumnRenamed("v", "replaced"), "k")


# --- jobs, logs, leases -------------------------------------------------------------------------


@query("job_event", sql="""WITH l AS (SELECT job_id AS stream, event_id AS idempotency_key, payload, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS sequence FROM job_event WHERE event_id % 2 = 0), n AS (SELECT job_id AS stream, event_id AS idempotency_key FROM job_event),
 j AS (SELECT n.*, l.sequence AS place, CASE WHEN l.sequence IS NULL THEN 'appended' WHEN n.idempotency_key % 6 = 0 THEN 'conflict' ELSE 'repeat' END AS state, (SELECT max(sequence) FROM l m WHERE m.stream = n.stream) AS last FROM n LEFT JOIN l USING (stream, idempotency_key))
SELECT stream, idempotency_key, state, CAST(CASE state WHEN 'appended' THEN coalesce(last, 0) + row_number() OVER (PARTITION BY stream, state ORDER BY idempotency_key) WHEN 'repeat' THEN place END AS BIGINT) AS sequence FROM j""")
def audit_append(job_event):
    log = relational.sequenced(job_event.where("event_id % 2 = 0").select(F.col("job_id").alias("stream"), F.col("event_id").alias("idempotency_key"), "payload"), "stream", ["idempotency_key"])
    events = job_event.select(F.col("job_id").alias("stream"), F.col("event_id").alias("idempotency_key"), F.when(F.col("event_id") % 6 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"))
    return relational.appended(log, events).select("stream", "idempotency_key", "state", F.col("sequence").cast("long").alias("sequence"))


@query("customer", sql="SELECT c_custkey AS resource, owner, CASE WHEN c_custkey % 3 <> 1 AND owner = 'a' THEN 'acquired' ELSE 'busy' END AS state, CAST(CASE WHEN c_custkey % 3 <> 1 AND owner = 'a' THEN CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 8 END END AS INTEGER) AS fence FROM customer, (VALUES ('a'), ('b')) o(owner)")
def leases(customer):
    k = F.col("c_custkey")
    held = customer.where("c_custkey % 3 <> 0").select(k.alias("resource"), F.lit("z").alias("owner"), F.lit(7).alias("fence"), F.when(k % 3 == 1, "2027-01-01").otherwise("2025-01-01").cast("timestamp").alias("expires_at"))
    asks = customer.select(k.alias("resource"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("owner"))
    return relational.acquired(held, asks, now()).select("resource", "owner", "state", "fence")


@query("orders", sql="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN 'stale' WHEN o_orderkey % 2 = 0 THEN 'denied' ELSE 'applied' END AS outcome, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 THEN 'running' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'queued' END AS state, CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 THEN 5 ELSE 4 END AS INTEGER) AS revision FROM orders""")
def revision_compare_and_set(orders):
    k = F.col("o_orderkey")
    current = orders.where("o_orderkey % 7 <> 0").select(k.alias("id"), F.when(k % 2 == 0, "completed").otherwise("queued").alias("state"), F.lit(4).alias("revision"))
    return relational.revised(current, orders.select(k.alias("id"), F.when(k % 3 == 0, 3).otherwise(4).alias("expected_revision"), F.lit("running").alias("to")), relational.JOB_STATES).select("id", "outcome", "state", "revision")


@query("customer", sql="""SELECT 'k' || CAST(c_custkey AS VARCHAR) AS idempotency_key, CASE WHEN c_custkey % 3 = 0 THEN 'created' WHEN c_custkey % 3 = 1 THEN 'existing' ELSE 'conflict' END AS outcome, CASE WHEN c_custkey % 3 = 0 THEN 'job_' || sha256('k' || CAST(c_custkey AS VARCHAR))[1:16] WHEN c_custkey % 3 = 1 THEN 'j' || CAST(c_custkey AS VARCHAR) END AS job_id FROM customer""")
def created_jobs(customer):
    k = F.col("c_custkey")
    key = F.concat(F.lit("k"), k.cast("string")).alias("idempotency_key")
    jobs = customer.where("c_custkey % 3 <> 0").select(key, F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.lit("h").alias("input_hash"))
    asks = customer.select(key, F.when(k % 3 == 2, "other").otherwise("h").alias("input_hash"))
    return workflow.created_jobs(jobs, asks.union(asks)).select("idempotency_key", "outcome", "job_id")


@query("orders", sql="SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 AND s IN ('queued', 'parked') THEN 'cancelled' WHEN o_orderkey % 3 = 0 AND s = 'running' THEN 'cancelling' ELSE s END AS state FROM (SELECT o_orderkey, ['queued', 'running', 'parked', 'completed'][o_orderkey % 4 + 1] AS s FROM orders)")
def cancelled_jobs(orders):
    k = F.col("o_orderkey")
    jobs = orders.select(k.alias("job_id"), pick(k, "queued", "running", "parked", "completed").alias("state"), F.lit(None).cast("string").alias("checkpoint"))
    return workflow.cancelled(jobs, orders.where("o_orderkey % 3 = 0").select(k.alias("job_id"))).select("job_id", "state")


FINGERPRINT = ("input_hash", "config_hash", "code_version", "model", "prompt_hash", "policy_hash", "schema_version", "seed")


@query("nation", "region", sql="""SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS stage, 0 AS depth FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 8 = 0 THEN 0 ELSE 1 END FROM nation WHERE n_regionkey % 2 = 0 OR n_nationkey % 8 = 0""")
def checkpoint_fingerprints(nation, region):
    """All eight fields of a stage's fingerprint; a different one is off in each changed stage."""
    r = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("stage"), F.lit(None).cast("string").alias("needs"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey") % 8).alias("off"))
    n = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.when(F.col("n_nationkey") % 8 == 0, F.expr("n_nationkey div 8 + 4")))
    stages = r.union(n)
    stored = stages.select("stage", *[F.lit("v").alias(f) for f in FINGERPRINT])
    current = stages.select("stage", *[F.when(F.col("off") == i, "w").otherwise("v").alias(f) for i, f in enumerate(FINGERPRINT)])
    return workflow.invalidated(stored, current, stages, list(FINGERPRINT))


@query("events", sql="SELECT event_id FROM events WHERE event_id % 3 = 0")
def audit_outbox(events):
    return workflow.outbox(events.select("event_id", "ts"), events.where("event_id % 3 <> 0")).select("event_id")


@query("orders", sql="SELECT o_orderkey, 'stable' AS status FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def ratified_drafts(orders):
    return workflow.promoted(orders.select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("auto"), (F.col("o_orderkey") % 3 == 0).alias("ratified"), F.lit("draft").alias("status"))).select("o_orderkey", "status")


@query("orders", sql="""SELECT o_orderkey AS recording_id, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'drift' WHEN o_orderkey % 5 = 0 THEN 'invalid' ELSE 'replayed' END AS state, CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderpriority END AS output FROM orders""")
def replayed_recordings(orders):
    k = F.col("o_orderkey")
    rec = orders.select(k.alias("recording_id"), F.when(k % 2 == 0, "adopt").otherwise("ingest").alias("task"), F.lit("h").alias("input_hash"), F.array(F.lit("c1"), F.lit("c2")).alias("claim_ids"), F.when(k % 5 == 0, F.array(F.lit("c9"))).otherwise(F.array(F.lit("c1"))).alias("proposal_claim_ids"), F.col("o_orderpriority").alias("output"))
    return workflow.replayed(rec, "ingest", orders.select(k.alias("recording_id"), F.when(k % 3 == 0, "x").otherwise("h").alias("input_hash")))


@query("claim", sql="""SELECT proposal_id AS recording_id, claim_id, CASE WHEN part_id % 4 = 0 THEN 'unanchored' ELSE 'bound' END AS state FROM claim WHERE proposal_id % 2 = 1""")
def recorded_claims(claim):
    locator = F.col("part_id").cast("string").alias("locator")
    c = claim.select(F.col("proposal_id").alias("recording_id"), "claim_id", "source_id", F.lit("h").alias("source_hash"), locator)
    units = claim.where("part_id % 4 <> 0").select("source_id", F.lit("h").alias("source_hash"), locator)
    return workflow.recorded_claims(c, claim.select(F.col("proposal_id").alias("recording_id"), F.when(F.col("proposal_id") % 2 == 1, "replayed").otherwise("drift").alias("state")).distinct(), units)


@query("customer", sql="""WITH u AS (SELECT c_nationkey AS s, c_custkey AS o, c_name || repeat('x', 120) AS t FROM customer), g AS (SELECT s, string_agg(t, chr(10) ORDER BY o) AS e, string_agg('L' || CAST(o AS VARCHAR) || chr(9) || t[1:120], chr(10) ORDER BY o) AS l FROM u GROUP BY 1)
SELECT 'kits/' || CAST(s AS VARCHAR) || '/evidence.txt' AS path, 'evidence' AS kind, e AS content FROM g UNION ALL SELECT 'kits/' || CAST(s AS VARCHAR) || '/locators.txt', 'locators', l FROM g UNION ALL SELECT 'kits/' || CAST(s AS VARCHAR) || '/template.md', 'template', '---' || chr(10) || 'type: ' || chr(10) || 'title: ' || n_name || chr(10) || 'status: draft' || chr(10) || '---' || chr(10) FROM g JOIN nation ON s = n_nationkey""")
def drafting_kits(customer):
    u = customer.select(F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("order"), F.concat("c_name", F.lit("x" * 120)).alias("text"), F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("locator"))
    return u.transform(lambda d: workflow.drafting_kit(d, NATIONS(customer), 1_000_000))


def NATIONS(customer):  # noqa: N802 - the titles stand beside the customers' table
    path = customer.inputFiles()[0].rsplit("/", 1)[0]
    return customer.sparkSession.read.parquet(f"{path}/nation.parquet").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("title"))


@query("nation", sql="""WITH n AS (SELECT lower(replace(n_name, '_', '-')) AS name, n_name AS title FROM nation) SELECT name || '/purpose.md' AS path, '# ' || title || chr(10) || chr(10) || 'Describe the purpose and scope.' || chr(10) AS content FROM n
UNION ALL SELECT name || '/knowledge/primary/index.md', '<!-- generated; do not edit -->' || chr(10) || '# Knowledge Index' || chr(10) FROM n
UNION ALL SELECT name || '/knowledge/primary/knowledge-base.yaml', 'kind: KnowledgeBase' || chr(10) || 'id: "local.' || name || '"' || chr(10) || 'name: primary' || chr(10) || 'access:' || chr(10) || '  classification: internal' || chr(10) FROM n
UNION ALL SELECT name || '/knowledge-project.yaml', 'kind: Project' || chr(10) || 'name: "' || name || '"' || chr(10) || 'title: "' || title || '"' || chr(10) || 'knowledge_bases:' || chr(10) || '  - name: primary' || chr(10) || '    uri: ./knowledge/primary' || chr(10) || '    mode: maintain' || chr(10) || '    role: primary' || chr(10) FROM n""")
def scaffolds(nation):
    name = F.lower(F.replace("n_name", F.lit("_"), F.lit("-")))
    return workflow.scaffold(nation.select(name.alias("name"), F.col("n_name").alias("title"), F.concat(F.lit("local."), name).alias("knowledge_base_id")))


@query("documents", sql="SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'refused' ELSE 'written' END AS state FROM documents")
def placed_files(documents):
    k = F.col("doc_id")
    path = F.concat(F.when(k % 5 == 0, "../").otherwise("a/"), k.cast("string"))
    return workflow.placed(documents.select("doc_id", path.alias("path")), documents.where("doc_id % 3 = 0").select(path.alias("path"))).select("doc_id", "state")


@query("documents", sql="SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS units, 0 AS warnings FROM documents")
def elided_envelopes(documents):
    return workflow.elided(documents.select("doc_id", F.split("text", "\n").alias("units"), F.lit(None).cast("array<string>").alias("warnings")), ["units", "warnings"])


@query("part", sql="""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'replaced' WHEN 2 THEN 'precondition' ELSE 'downgrade' END AS state, CASE WHEN p_partkey % 4 = 1 THEN '{"limits":{"memory":' || CAST(p_size AS VARCHAR) || '},"n":1}' WHEN p_partkey % 4 = 2 THEN '{"limits":{"memory":-1}, "n":1}' ELSE '{"limits":{"memory":100}, "n":1}' END AS content FROM part""")
def migrated_files(part):
    k = F.col("p_partkey")
    path = k.cast("string").alias("path")
    files = part.select(path, F.when(k % 4 == 2, '{"limits":{"memory":-1}, "n":1}').otherwise('{"limits":{"memory":100}, "n":1}').alias("content"))
    ops = part.where("p_partkey % 4 <> 0").select(path, F.lit("/limits/memory").alias("pointer"), F.lit("100").alias("before"), F.col("p_size").cast("string").alias("after"), (k % 4 == 3).alias("weakening"))
    return workflow.migrated(files, ops, confirmed=True).select("path", "state", "content")


# --- erasure -----------------------------------------------------------------------------------


@query("supplier", sql="SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0")
def impact_seeds(supplier):
    k = F.col("s_suppkey")
    s = supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("surface_id"), F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("z"))).alias("source_ids"), F.when(k % 5 == 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("source_hashes"))
    return graph.impact_seeds(s, supplier.sparkSession.createDataFrame([("x", "h"), ("y", "h2")], "source_id string, source_hash string"))


@query("supplier", sql="""SELECT CAST(s_suppkey AS VARCHAR) AS surface_id, 'sha256:' || sha256('{"depends_on":["a","b"],"id":"' || CAST(s_suppkey AS VARCHAR) || '","kind":"cache","path":' || CASE WHEN s_suppkey % 2 = 0 THEN 'null' ELSE '"p"' END || ',"retained_until":null,"source_hashes":[],"source_ids":["x"],"strategy":"purge"}') AS identity_hash FROM supplier""")
def surface_identities(supplier):
    k = F.col("s_suppkey")
    s = supplier.select(k.cast("string").alias("surface_id"), F.lit("cache").alias("kind"), F.lit("purge").alias("strategy"), F.when(k % 2 != 0, "p").alias("path"), F.lit(None).cast("string").alias("retained_until"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("depends_on"), F.array(F.lit("x"), F.lit("x")).alias("source_ids"), F.lit(None).cast("array<string>").alias("source_hashes"))
    return review.surface_identity(s)


@query("supplier", sql="""SELECT CAST(s_suppkey AS VARCHAR) AS surface_id, CASE WHEN s_suppkey % 3 = 0 THEN 'missing' WHEN s_suppkey % 3 = 1 THEN 'changed' END AS state FROM supplier WHERE s_suppkey % 3 <> 2 UNION ALL SELECT 'n' || CAST(s_suppkey AS VARCHAR), 'added' FROM supplier WHERE s_suppkey % 4 = 0""")
def drifted_surfaces(supplier):
    k, i = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    now_ = supplier.where("s_suppkey % 3 <> 0").select(i.alias("surface_id"), F.when(k % 3 == 1, "b").otherwise("a").alias("identity_hash")).union(supplier.where("s_suppkey % 4 = 0").select(F.concat(F.lit("n"), i), F.lit("a")))
    return review.drifted_surfaces(supplier.select(i.alias("surface_id"), F.lit("a").alias("identity_hash")), now_)


@query("supplier", sql="""SELECT CAST(s_suppkey AS VARCHAR) AS surface_id, '{"decision_hash":"d","event_id":"e","source_id":"' || CAST(s_suppkey AS VARCHAR) || '","status":"deleted","surface":{"kind":"log"}}' AS tombstone FROM supplier""")
def tombstones(supplier):
    t = supplier.select(F.col("s_suppkey").cast("string").alias("surface_id"), F.col("s_suppkey").alias("source_id"), F.lit("h").alias("source_hash"), F.lit("e").alias("event_id"), F.lit("log").alias("kind"), F.lit("d").alias("decision_hash"))
    return review.tombstones(t, ("source_id", "event_id"))


@query("supplier", sql="SELECT s_suppkey AS hold_id FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 1")
def active_holds(supplier):
    k = F.col("s_suppkey")
    holds = supplier.select(k.alias("hold_id"), k.alias("source_id"), F.when(k % 2 == 0, "active").otherwise("released").alias("status"), F.when(k % 3 == 1, F.array(F.lit("receipt"))).when(k % 3 == 2, F.array(F.lit("cache"), F.lit("log"))).alias("kinds"))
    return review.active_holds(holds, supplier.where("s_suppkey % 5 <> 0").select(k.alias("source_id"), F.lit("cache").alias("kind")))


@query("surface", sql="""WITH t AS (SELECT kind, surface_id LIKE '%3' OR surface_id LIKE '%17' AS open FROM surface) SELECT kind, count(*) FILTER (WHERE NOT open) AS treated, count(*) FILTER (WHERE open) AS remaining, CASE WHEN count(*) FILTER (WHERE open) > 0 THEN 'incomplete' ELSE 'erased' END AS result FROM t GROUP BY ROLLUP (kind)""")
def erasure_receipts(surface):
    return review.erasure_receipt(surface, surface.where("surface_id not like '%3'"), surface.where("surface_id like '%17'"), "erase")


@query("surface", sql="SELECT surface_id FROM surface WHERE surface_id NOT LIKE '%3'")
def erasure_remaining(surface):
    return workflow.remaining(surface, surface.where("surface_id like '%3'")).select("surface_id")


@query("surface", sql="SELECT surface_id, CASE WHEN kind = 'concept' THEN 'review-required' ELSE 'invalidated' END AS revoked, 'purged' AS erased FROM surface")
def surface_treatments(surface):
    return surface.select("surface_id", governance.treatment(F.col("kind"), "revoke").alias("revoked"), governance.treatment(F.col("kind"), "erase").alias("erased"))


# --- graphs ------------------------------------------------------------------------------------


@query("nation", "region", sql="SELECT 'root' AS stage, 0 AS level UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 1 FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 5 = 0 AND n_nationkey > 0 THEN 3 ELSE 2 END FROM nation")
def stage_levels(nation, region):
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    k = F.col("n_nationkey")
    stages = region.select(F.lit("root").alias("stage"), F.lit(None).cast("string").alias("needs")).distinct().union(region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit("root"))).union(nation.select(n(k), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).union(nation.where("n_nationkey % 5 = 0 and n_nationkey > 0").select(n(k), n(k - 4)))
    return graph.stage_levels(stages)


@query("part", sql="""WITH RECURSIVE r AS (SELECT p_partkey AS k, p_brand AS b, p_size AS z, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS n FROM part),
 e AS (SELECT a.k AS stage, c.k AS needs, c.z * 1000000000000 + c.k AS place FROM r a JOIN r c ON a.b = c.b AND c.n BETWEEN 2 * a.n AND 2 * a.n + 2),
 w AS (SELECT k AS stage, [k] AS way FROM r UNION ALL SELECT e.needs, list_append(w.way, e.place) FROM w JOIN e ON w.stage = e.stage),
 m AS (SELECT stage, min(way) AS way FROM w GROUP BY 1)
SELECT stage, CAST(row_number() OVER (ORDER BY list_append(way, 9223372036854775807)) AS INTEGER) AS place FROM m""")
def stage_order(part):
    """Parts as stages, declared by number: of a brand's parts by price, the n-th needs those at 2n to 2n + 2, the smaller ones first, so that many are needed twice."""
    ranked = numbered(part.select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], ["p_retailprice", "p_partkey"], "n")
    below = ranked.select("p_brand", F.col("n").alias("at"), F.col("p_partkey").alias("needs"), (F.col("p_size").cast("long") * 1_000_000_000_000 + F.col("p_partkey")).alias("place"))
    edges = ranked.select("p_brand", F.col("p_partkey").alias("stage"), F.explode(F.sequence(2 * F.col("n"), 2 * F.col("n") + 2)).alias("at")).join(below, ["p_brand", "at"])
    return graph.stage_order(part.select(F.col("p_partkey").alias("stage"), F.col("p_partkey").alias("declared")), edges.select("stage", "place", "needs"))


@query("part", sql="SELECT p_partkey AS node FROM part WHERE p_partkey % 10 IN (3, 4, 5) AND (p_partkey - p_partkey % 10) + 5 <= (SELECT max(p_partkey) FROM part)")
def stage_cycles(part):
    """Every ten: 1 needs 2 needs 3, 3 needs 4 needs 5 needs 3, and 5 needs 6: the middle is a cycle."""
    k = F.col("p_partkey")
    edges = part.where("p_partkey % 10 between 1 and 5").select(k.alias("node"), (k + 1).alias("depends_on")).union(part.where("p_partkey % 10 = 5").select(k, k - 2))
    return graph.cyclic(edges)


@query("documents", sql="SELECT source || '/' || lang || '/doc-' || CAST(doc_id AS VARCHAR) || '.md' AS path, 3 AS depth, 'concept' AS state FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT '../' || source || '.md', 1, 'unsafe' FROM documents GROUP BY source UNION ALL SELECT source || '/gone.md', 2, 'broken' FROM documents WHERE doc_id % 4 <> 0 GROUP BY source")
def traversed_index(documents):
    """The generated indexes walked from the root; a quarter of the concepts isn't listed, and links that lead out or nowhere are told."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    c = documents.select(path.alias("path"), F.lit(None).cast("string").alias("title"), F.lit("").alias("description"), "doc_id", "source")
    indexes = graph.directory_indexes(c.where("doc_id % 4 <> 0")).select(F.when(F.col("directory") == "", "index.md").otherwise(F.concat("directory", F.lit("/index.md"))).alias("path"), F.col("index_text").alias("content"))
    sources = F.array_sort(F.collect_set("source"))
    more = documents.agg(F.array_join(F.transform(sources, lambda s: F.concat(F.lit("[x](../"), s, F.lit(".md)"))), "\n").alias("out"))
    names = documents.select("source").distinct().select(F.concat("source", F.lit("/index.md")).alias("path"), F.lit("[y](gone.md)").alias("gone"))
    indexes = indexes.join(names, "path", "left").crossJoin(F.broadcast(more)).select("path", F.concat("content", F.coalesce("gone", F.lit("")), F.when(F.col("path") == "index.md", F.col("out")).otherwise("")).alias("content"))
    found = graph.traversed(indexes.union(c.select("path", F.lit(""))), 1 << 40, 1 << 40)
    return found.where("state <> 'index'").select("path", "depth", "state")


# --- evaluation ----------------------------------------------------------------------------------


@query("labels", sql="""WITH r AS (SELECT doc_id, doc_id % 12 AS c, doc_id % 12 < 6 AS due, quality = 1 AS q, toxic = 1 AS t FROM labels),
 f AS (SELECT due, CASE WHEN due THEN q ELSE NOT t END AS decided, due AND q AND doc_id % 2 = 0 AS fact, due AND q AND doc_id % 5 <> 0 AS locator, c >= 4 AS gate FROM r),
 m AS (SELECT *, CASE WHEN due THEN fact AND locator ELSE decided END AS passed FROM f)
SELECT 'decision_accuracy' AS metric, count(*) FILTER (WHERE decided) AS successes, count(*) AS observations FROM m UNION ALL SELECT 'grounded_fact_accuracy', count(*) FILTER (WHERE fact), count(*) FILTER (WHERE due) FROM m UNION ALL SELECT 'locator_accuracy', count(*) FILTER (WHERE locator), count(*) FILTER (WHERE due) FROM m
UNION ALL SELECT 'security_fail_closed', count(*) FILTER (WHERE passed AND gate), count(*) FILTER (WHERE gate) FROM m""")
def evaluation_scores(labels):
    k = F.col("doc_id")
    due = k % 12 < 6
    right = F.when(due, F.col("quality") == 1).otherwise(F.col("toxic") != 1)
    answers = F.when(due, right).otherwise(~right)
    captures = labels.select((k % 12).alias("case_key"), k.alias("trial"), F.when(answers, "answer").otherwise("abstain").alias("decision"), F.when(answers, F.when(k % 2 == 0, " the answer").otherwise("another")).otherwise("").alias("answer"), F.when(answers, '[{"o":1}]').otherwise("[]").alias("assertions"), F.when(answers & (k % 5 != 0), '["c"]').when(answers, '["d"]').otherwise("[]").alias("citations"))
    gold = labels.select((k % 12).alias("case_key")).distinct().select("case_key", F.when(F.col("case_key") < 6, "answer").otherwise("abstain").alias("decision"), F.array(F.lit("the answer"), F.lit("it")).alias("accepted"), F.lit('[{"o":1}]').alias("assertions"), F.lit('["c"]').alias("citations"), (F.col("case_key") >= 4).alias("security_gate"))
    return evaluation.score_totals(evaluation.scored(captures, gold))


@query("labels", sql="""WITH c AS (SELECT doc_id % 10 AS trial, doc_id // 10 % 4 AS k FROM labels), g AS (SELECT trial, count(DISTINCT k) FILTER (WHERE k < 3) AS have, count(*) FILTER (WHERE k = 3) AS extra, count(*) - count(DISTINCT k) AS repeated FROM c GROUP BY 1)
SELECT trial, 3 - have AS missing, extra, repeated FROM g WHERE have < 3 OR extra > 0 OR repeated > 0""")
def capture_gaps(labels):
    k = F.col("doc_id")
    captures = labels.select((k % 10).alias("trial"), (F.expr("doc_id div 10") % 4).alias("case_key"))
    return evaluation.capture_gaps(captures, labels.sparkSession.createDataFrame([(0,), (1,), (2,)], "case_key long"))


CATEGORIES = ("source", "contradiction", "temporal", "ambiguity", "restriction", "prompt-injection", "falsehood", "format", "revocation", "multilingual-answer", "multilingual-restriction", "human-edit")


@query("orders", sql=f"""WITH k AS (SELECT o_orderkey, o_orderkey % 12 AS c, o_orderkey // 12 % 4 AS v FROM orders), n AS (SELECT *, [{", ".join(f"'{c}'" for c in CATEGORIES)}][c + 1] AS name FROM k)
SELECT o_orderkey, CASE WHEN v = 0 THEN '' WHEN v = 1 THEN name || '-context-incomplete' WHEN v = 2 THEN 'non-answer-discloses' ELSE 'answer-unbound,assertion-unsupported,citation-unsupported,' || name || '-context-incomplete' END AS codes FROM n""")
def gold_semantics(orders):
    """All twelve kinds of context, each sound, incomplete, disclosing, and answering without evidence."""

    def evidence(source, **o):
        return {
            "source_id": source, "authority": o.get("authority", "secondary"), "locator": "l1", "locator_kind": o.get("kind", "line"), "language": o.get("language", "en"), "valid_from": o.get("since", "2025-01-01T00:00:00Z"), "valid_until": o.get("until"), "labels": [o.get("label", "a")], "state": o.get("state", "active"),
            "effective_at": o.get("effective"), "barrier_at": o.get("barrier"), "instructs": o.get("instructs", False), "normalized": o.get("normalized", False), "claims": [{"predicate": o.get("predicate", "is"), "object": o.get("object", "one")}],
        }

    sound = {
        "source": [evidence("s1", authority="authoritative")], "contradiction": [evidence("s1", authority="equal-authority"), evidence("s2", authority="equal-authority", object="two")], "temporal": [evidence("s1", until="2025-06-01T00:00:00Z")], "ambiguity": [evidence("s1")],
        "restriction": [evidence("s1", label="z")], "prompt-injection": [evidence("s1", instructs=True)], "falsehood": [evidence("s1")], "format": [evidence("s1", normalized=True, kind="table-cell")],
        "revocation": [evidence("s1", state="revoked", effective="2025-02-01T00:00:00Z", barrier="2025-03-01T00:00:00Z")], "multilingual-answer": [evidence("s1", language="es")], "multilingual-restriction": [evidence("s1", language="ja", label="z")], "human-edit": [evidence("s1")],
    }
    broken = {"falsehood": [evidence("s1", predicate="encrypts", state="revoked")]}
    rows = []
    for i, name in enumerate(CATEGORIES):
        for v in range(4):
            good, given = v in (0, 2), v >= 2
            rows.append((i, v, {
                "category": name, "decision": "answer" if v == 3 else "abstain", "accepted": ["one"] if given else [], "assertions": [{"predicate": "is", "object": "two"}] if given else [], "citations": [{"source_id": "s8", "locator": "l1"}] if given else [], "at": NOW, "labels": ["a"],
                "policy": dict.fromkeys(("unresolved_equal_authority_is_conflict", "current_sources_only", "source_instructions_are_data", "complete_evidence_set", "stable_requires_reconciliation"), True),
                "entities": [{"entity_id": "e1", "name": "n", "owner": "o1"}, {"entity_id": "e2" if good else "e1", "name": "n", "owner": "o2" if good else "o1"}],
                "artifact": {"approved_hash": "h", "current_hash": "h2" if good else "h", "reconciliation_receipt": None}, "evidence": sound[name] if good else broken.get(name, [evidence("s9", since="2027-01-01T00:00:00Z")]),
            }))
    pairs = "array<struct<predicate:string,object:string>>"
    flags = ",".join(f"{p}:boolean" for p in ("unresolved_equal_authority_is_conflict", "current_sources_only", "source_instructions_are_data", "complete_evidence_set", "stable_requires_reconciliation"))
    shape = f"category:string,decision:string,accepted:array<string>,assertions:{pairs},citations:array<struct<source_id:string,locator:string>>,at:string,labels:array<string>,policy:struct<{flags}>,entities:array<struct<entity_id:string,name:string,owner:string>>,artifact:struct<approved_hash:string,current_hash:string,reconciliation_receipt:string>," + (
        f"evidence:array<struct<source_id:string,authority:string,locator:string,locator_kind:string,language:string,valid_from:string,valid_until:string,labels:array<string>,state:string,effective_at:string,barrier_at:string,instructs:boolean,normalized:boolean,claims:{pairs}>>")
    cases = orders.sparkSession.createDataFrame(rows, f"c long, v long, x struct<{shape}>")
    o = orders.select("o_orderkey", (F.col("o_orderkey") % 12).alias("c"), (F.expr("o_orderkey div 12") % 4).alias("v")).join(F.broadcast(cases), ["c", "v"])  # 48 rows
    return o.select("o_orderkey", F.array_join(evaluation.gold_failures(F.col("x")), ",").alias("codes"))


@query("documents", sql="SELECT 'sha256:' || sha256(string_agg('sha256:' || sha256(text || chr(10)), chr(10) ORDER BY doc_id)) AS capture_set_hash FROM documents")
def capture_set_hash(documents):
    return evaluation.capture_set_hash(documents, "doc_id", "text")


@query("customer", sql="SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' ELSE 'unknown' END AS visibility FROM customer")
def access_contexts(customer):
    from marlstone.sources import scan

    return customer.select("c_custkey", scan.access_context(pick(F.col("c_custkey"), "anonymous", "organization", "users", None)).alias("visibility"))


@query("customer", sql="SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'human-reviewed' WHEN c_custkey % 3 = 1 THEN 'machine-confirmed' ELSE 'unverified' END AS tier FROM customer")
def verified_tiers(customer):
    k = F.col("c_custkey")
    event = lambda by, at: F.struct(by.alias("by"), F.lit(at).alias("at"))
    verified = F.array(event(pick(k, "human:ann", "process:ci", "someone"), "2025-01-01T00:00:00Z"), event(F.lit("human:bob"), "2027-01-01T00:00:00Z"), event(F.lit("human:eve"), "2025-13-01T00:00:00Z"))
    return customer.select("c_custkey", policy.trust_tier(verified, now()).alias("tier"))


# --- composites --------------------------------------------------------------------------------


@query("surface", sql=f"""{core.CLOSED}, m AS (SELECT node, min(depth) AS depth FROM reach GROUP BY 1) SELECT s.surface_id, s.kind, m.depth, CASE WHEN s.kind = 'cache' THEN 'hold' WHEN s.retained_until > '2026-01-01T00:00:00Z' THEN 'retention' END AS blocked_by, CASE WHEN s.kind = 'cache' OR s.retained_until > '2026-01-01T00:00:00Z' THEN 'kept' ELSE 'purged' END AS state FROM m JOIN surface s ON m.node = s.surface_id""")
def erasure_plan(surface):
    s = surface.select("surface_id", "kind", F.when(F.col("kind") == "source", F.array("surface_id")).otherwise(F.array().cast("array<string>")).alias("source_ids"), F.array().cast("array<string>").alias("source_hashes"), F.when(F.col("depends_on").isNotNull(), F.array("depends_on")).otherwise(F.array().cast("array<string>")).alias("depends_on"), "retained_until")
    session = surface.sparkSession
    return review.revocation_plan(s, session.createDataFrame([("region:1", "h")], "source_id string, source_hash string"), session.createDataFrame([("region:1", ["cache"], True), ("region:2", [], True)], "source_id string, kinds array<string>, active boolean"), "erase", now())


@query("surface", sql=f"""{core.CLOSED}, m AS (SELECT node, min(depth) AS depth FROM reach GROUP BY 1) SELECT s.surface_id, m.depth, CASE WHEN s.kind = 'concept' THEN 'review-required' ELSE 'invalidated' END AS state FROM m JOIN surface s ON m.node = s.surface_id""")
def revocation_plan(surface):
    s = surface.select("surface_id", "kind", F.array().cast("array<string>").alias("source_ids"), F.when(F.col("surface_id") == "region:1", F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("source_hashes"), F.when(F.col("depends_on").isNotNull(), F.array("depends_on")).otherwise(F.array().cast("array<string>")).alias("depends_on"), "retained_until")
    session = surface.sparkSession
    return review.revocation_plan(s, session.createDataFrame([("none", "h")], "source_id string, source_hash string"), session.createDataFrame([("none", [], True)], "source_id string, kinds array<string>, active boolean"), "revoke", now()).select("surface_id", "depth", "state")


@query("documents", sql="""SELECT 'g/' || CAST(doc_id AS VARCHAR) AS path, kind, value FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 5 = 0 THEN ['unreadable'] ELSE ['id', 'hash'] END) AS kind, unnest(CASE WHEN doc_id % 5 = 0 THEN [NULL] ELSE [source, 'h:' || lang] END) AS value FROM documents)""")
def provenance_inventory(documents):
    content = F.when(F.col("doc_id") % 5 == 0, "{not json").otherwise(F.concat(F.lit('{"a":[{"source_id":"'), "source", F.lit('"}],"source_hashes":["h:'), "lang", F.lit('","h:'), "lang", F.lit('"]}')))
    return graph.provenance_inventory(documents.select(F.concat(F.lit("g/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")))


@query("documents", sql="SELECT doc_id AS concept_id, CAST(doc_id AS VARCHAR) AS id, 'r' AS resource, CASE WHEN doc_id % 4 = 1 THEN 'sha256:' || sha256(text) END AS source_hash FROM documents WHERE doc_id % 4 IN (0, 1)")
def citation_records(documents):
    k = F.col("doc_id")
    return review.citation_records(documents.select(k.alias("concept_id"), k.cast("string").alias("id"), F.when(k % 4 != 2, "r").alias("resource"), F.when(k % 4 == 1, text.byte_hash(F.col("text"))).when(k % 4 == 3, "sha256:zz").alias("source_hash")))


@query("claim", sql="""SELECT CAST(proposal_id AS VARCHAR) AS proposal_id, 'k' AS packet_hash, list(t ORDER BY claim_id, t NULLS FIRST) AS excerpts FROM (SELECT *, CASE WHEN part_id % 3 <> 0 THEN 't' || CAST(part_id AS VARCHAR) END AS t FROM claim) GROUP BY 1""")
def shown_packets(claim):
    c = claim.select(F.col("proposal_id").cast("string").alias("proposal_id"), "claim_id", "source_id", F.col("part_id").cast("string").alias("locator"), "part_id")
    units = c.where("part_id % 3 <> 0").select("source_id", "locator", F.concat(F.lit("t"), "locator").alias("text"))
    return review.shown_packets(c.select("proposal_id", F.lit("k").alias("packet_hash")).distinct(), c, units)


@query("part", sql="""SELECT p_partkey AS migration_id, 2 AS leaves, p_partkey % 2 = 0 AS weakening, 'sha256:' || sha256('c.json' || chr(0) || '/limits/memory' || chr(0) || 'permission-boundary' || chr(0) || '10' || chr(0) || CASE WHEN p_partkey % 2 = 0 THEN '20' ELSE '5' END || chr(10) || 'c.json' || chr(0) || '/title' || chr(0) || 'content' || chr(0) || '"a"' || chr(0) || '"b' || CAST(p_partkey AS VARCHAR) || '"') AS preview_hash FROM part""")
def migration_previews(part):
    k = F.col("p_partkey")
    after = F.concat(F.lit('{"limits":{"memory":'), F.when(k % 2 == 0, "20").otherwise("5"), F.lit('},"title":"b'), k.cast("string"), F.lit('"}'))
    ops = part.select(k.alias("migration_id"), F.lit("c.json").alias("path"), F.lit("").alias("pointer"), F.lit('{"title":"a","limits":{"memory":10}}').alias("before"), after.alias("after"))
    return workflow.migration_preview(ops).withColumn("leaves", F.col("leaves").cast("int"))


@query("supplier", sql="""SELECT s_suppkey AS plugin, CAST(s_suppkey AS VARCHAR) AS id, 'POLICY_DOWNGRADE' AS code FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'shared', 'CONTRIBUTION_CONFLICT' FROM supplier WHERE s_suppkey % 5 = 0 AND (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0) > 1""")
def contribution_errors(supplier):
    k = F.col("s_suppkey")
    c = supplier.select(k.alias("plugin"), F.lit("normalizer").alias("type"), k.cast("string").alias("id"), F.lit("network").alias("setting"), F.when(k % 3 == 0, "true").otherwise("false").alias("value")).union(supplier.where("s_suppkey % 5 = 0").select(k, F.lit("sensor"), F.lit("shared"), F.lit("note"), F.lit("x")))
    return workflow.contribution_errors(c, supplier.sparkSession.createDataFrame([("normalizer", "network", "false"), ("sensor", "blocking", "true")], "type string, setting string, value string"))


@query("supplier", sql="""SELECT s_suppkey AS plugin, s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AS allowed, concat_ws(',', CASE WHEN s_suppkey % 3 = 0 THEN 'LOCK_MISMATCH' END, CASE WHEN s_suppkey % 4 = 0 THEN 'SANDBOX_network-scope' END) AS codes FROM supplier""")
def install_reports(supplier):
    k = F.col("s_suppkey").alias("plugin")
    return workflow.install_report(supplier.select(k), supplier.where("s_suppkey % 3 = 0").select(k, F.lit("LOCK_MISMATCH").alias("code")), supplier.where("s_suppkey % 4 = 0").select(k, F.lit("network-scope").alias("gap")))


@query("documents", sql=f"WITH {core.TREE} SELECT source AS plugin, n_files, tree_hash AS package_hash, codes FROM t JOIN (SELECT source, concat_ws(',', CASE WHEN bool_or(doc_id % 2 = 0 AND doc_id % 3 = 0) THEN 'EXECUTABLE_UNDECLARED' END, CASE WHEN bool_or(doc_id % 2 = 1 AND doc_id % 7 = 0) THEN 'PACKAGE_LINK' END) AS codes FROM documents GROUP BY 1) USING (source)")
def package_scans(documents):
    k = F.col("doc_id")
    path = F.concat("lang", F.lit("/doc-"), k.cast("string"), F.lit(".md")).alias("path")
    files = documents.select(F.col("source").alias("plugin"), path, F.col("text").alias("content"), F.when(k % 2 == 0, "executable").when(k % 7 == 0, "link").otherwise("regular").alias("mode"))
    return workflow.package_scans(files, documents.where("doc_id % 3 <> 0").select(F.col("source").alias("plugin"), path))


DIRECTORIES = "SELECT DISTINCT unnest(['', source, source || '/' || lang]) AS d FROM documents"


@query("documents", sql=f"""SELECT CASE WHEN d = '' THEN 'index.md' ELSE d || '/index.md' END AS subject, CASE WHEN d LIKE '%/de' THEN 'INDEX_MISSING' ELSE 'INDEX_DRIFT' END AS code FROM ({DIRECTORIES}) WHERE d LIKE '%/de' OR d LIKE 'src1/%'""")
def lint_indexes(documents):
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    c = documents.select(path.alias("path"), F.lit(None).cast("string").alias("title"), F.lit("").alias("description"))
    d = F.col("directory")
    files = graph.directory_indexes(c).where(~d.endswith("/de")).select(F.when(d == "", "index.md").otherwise(F.concat(d, F.lit("/index.md"))).alias("path"), F.when(d.startswith("src1/"), F.concat("index_text", F.lit("* more"))).otherwise(F.col("index_text")).alias("content"))
    return lint.indexes(c, files)
