"""Queries over workflow records, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import workflow
from marlstone.operators.spans import numbered
from marlstone.streaming import leases

from .core_queries import query as _query

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(*entities, sql=None):
    from . import core_queries

    def wrap(f):
        out = _query(*entities, sql=sql)(f)
        QUERIES[f.__name__] = core_queries.QUERIES.pop(f.__name__)
        if sql:
            ORACLES[f.__name__] = core_queries.ORACLES.pop(f.__name__)
        return out

    return wrap


@query("lineitem", sql="SELECT l_orderkey, l_linenumber AS first_line, min(l_returnflag) AS text FROM lineitem JOIN (SELECT l_orderkey AS k, min(l_linenumber) AS n FROM lineitem GROUP BY 1) ON k = l_orderkey AND n = l_linenumber GROUP BY 1, 2")
def source_excerpts(lineitem):
    units = lineitem.select(F.col("l_orderkey").alias("source_id"), F.lit("{}").alias("locator"), F.col("l_returnflag").alias("text"), F.struct("l_linenumber", "l_returnflag").alias("order"))
    wanted = lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line")).select(F.col("l_orderkey").alias("source_id"), F.lit("{}").alias("locator"), "first_line")
    return workflow.excerpts(wanted, units, "order").select(F.col("source_id").alias("l_orderkey"), "first_line", "text")


@query("claim", "lineitem", sql="SELECT claim_id FROM claim WHERE part_id % 4 = 0")
def unanchored_claims(claim, lineitem):
    c = claim.select("claim_id", "source_id", F.col("part_id").cast("string").alias("locator"))
    u = lineitem.where("l_partkey % 4 <> 0").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").cast("string").alias("locator"))
    return workflow.unanchored(c, u)


@query("orders", sql="""SELECT o_orderkey, 'o_orderpriority' AS path, 'pattern' AS rule FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]')
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'enum' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'o_totalprice', 'maximum' FROM orders WHERE o_totalprice > 200000""")
def contract_errors(orders):
    return workflow.contract_errors(orders, "o_orderkey", {"o_orderpriority": {"required": True, "pattern": "^[1-3]"}, "o_orderstatus": {"enum": ("F", "O")}, "o_totalprice": {"maximum": 200000}})


@query("concept", sql="""SELECT concept_id, role, action, CASE WHEN role = 'reader' AND action = 'read' THEN mount_id IN ('src0', 'src1') WHEN role = 'writer' AND action = 'write' THEN mount_id = 'src0' AND path LIKE '%/en/%' ELSE false END AS allowed
FROM concept, (VALUES ('reader', 'read'), ('writer', 'write'), ('reader', 'write')) r(role, action)""")
def role_permissions(concept):
    r = concept.select("concept_id", "path", F.explode(F.array(*[F.struct(F.lit(a).alias("role"), F.lit(b).alias("action")) for a, b in (("reader", "read"), ("writer", "write"), ("reader", "write"))])).alias("r")).select("concept_id", "path", "r.*")
    return workflow.permitted(r, {"reader": {"read": ("src0/**", "src1/*/*")}, "writer": {"write": ("src0/**/en/*",)}}).select("concept_id", "role", "action", "allowed")


@query("concept", sql="""SELECT concept_id, CASE WHEN mount_id = 'src0' THEN classification IN ('public', 'internal') WHEN mount_id = 'src1' THEN true ELSE false END AS allowed FROM concept""")
def model_routes(concept):
    routes = concept.sparkSession.createDataFrame([("src0", "m", True, "internal"), ("src1", "m", True, "restricted"), ("src2", "m", False, "restricted"), ("src3", "m", True, "unknown")], "provider string, model string, allowed boolean, max_classification string")
    return workflow.model_routes(concept.select("concept_id", F.col("mount_id").alias("provider"), F.lit("m").alias("model"), F.col("classification").alias("required")), routes).select("concept_id", "allowed")


@query("surface", sql="""WITH i AS (SELECT depends_on AS subject, kind AS surface, surface_id LIKE '%7' AS known_copy FROM surface WHERE depends_on LIKE 'nation:%')
SELECT DISTINCT subject, 'ERASURE_COPY_REMAINS' AS code FROM i WHERE known_copy UNION SELECT subject, 'ERASURE_INVENTORY_INCOMPLETE' FROM i GROUP BY 1 HAVING NOT (bool_or(surface = 'concept') AND bool_or(surface = 'cache'))""")
def erasure_findings(surface):
    i = surface.where("depends_on like 'nation:%'").select(F.col("depends_on").alias("subject"), F.col("kind").alias("surface"), F.col("surface_id").like("%7").alias("known_copy"), F.lit("invalidated").alias("status"))
    return workflow.erasure_findings(i, surface.sparkSession.createDataFrame([("concept",), ("cache",)], "surface string"))


@query("nation", "region", sql="""SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS stage, 0 AS depth FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 1 FROM nation WHERE n_regionkey % 2 = 0""")
def checkpoint_invalidation(nation, region):
    r = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("stage"), F.lit(None).cast("string").alias("needs"), F.col("r_name").alias("input_hash"), F.col("r_regionkey").alias("k"))
    n = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("stage"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("needs"), F.col("n_name").alias("input_hash"), F.lit(1).alias("k"))
    stages = r.union(n)
    now = stages.withColumn("input_hash", F.when(F.col("k") % 2 == 0, F.concat("input_hash", F.lit("*"))).otherwise(F.col("input_hash")))
    return workflow.invalidated(stages, now, stages, ["input_hash"])


@query("decision", "orders", sql="""WITH a AS (SELECT proposal_id, max(receipt_id) AS active FROM decision GROUP BY 1)
SELECT o_custkey AS proposal_id, min(o_orderkey) AS receipt_id, 'approved' AS decision FROM orders JOIN a ON a.proposal_id = o_custkey AND a.active = o_orderkey + o_custkey % 2 GROUP BY 1""")
def decision_compare_and_set(decision, orders):
    current = decision.groupBy("proposal_id").agg(F.max("receipt_id").alias("receipt_id"))
    d = orders.select(F.col("o_custkey").alias("proposal_id"), F.col("o_orderkey").alias("receipt_id"), (F.col("o_orderkey") + F.col("o_custkey") % 2).alias("expected_receipt_id"), F.lit("approved").alias("decision"))
    return workflow.decided(current, d)


@query("part", sql="SELECT p_partkey FROM part WHERE p_size % 3 = 0 OR p_partkey % 10 = 0")
def transaction_token_conflicts(part):
    store = part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_size") % 3 == 0, "new").otherwise("old").alias("token"))
    return workflow.stale_tokens(part.select("p_partkey", F.col("p_partkey").cast("string").alias("path"), F.lit("old").alias("expected_token")), store).select("p_partkey")


@query("customer", sql="""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'minimum-trust' WHEN 1 THEN 'mandatory-gates' WHEN 2 THEN 'permission-boundary' WHEN 3 THEN 'policy-boundary' WHEN 4 THEN 'sensor-severity' ELSE 'content' END AS rule, c_custkey % 6 IN (0, 1, 3) AS weakening FROM customer""")
def migration_weakening(customer):
    rows = [("/min_trust", '"human-reviewed"', '"unverified"'), ("/gates", '["a","b"]', '["a"]'), ("/limits/memory", "10", "5"), ("/retention/until", '"2025-01-01T00:00:00Z"', '"2026-01-01T00:00:00Z"'), ("/x/severity", '"warning"', '"error"'), ("/title", '"a"', '"b"')]
    d = F.element_at(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(b).alias("before"), F.lit(a).alias("after")) for p, b, a in rows]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return workflow.weakening(customer.select("c_custkey", d.alias("d")).select("c_custkey", "d.*")).select("c_custkey", "rule", "weakening")


@query("events", sql="""WITH e AS (SELECT event_id, user_id, event_id % 4 AS q, event_id % 3 AS r, event_id % 5 AS a FROM events)
SELECT c.event_id AS case_key, v.event_id AS source_id FROM e c JOIN e v ON c.user_id = v.user_id WHERE v.q = 0 AND v.r <> 0 AND c.a <> 0""")
def usable_evidence(events):
    z, k = F.lit("2026-01-01T00:00:00Z"), F.col("event_id")
    cases = events.select(k.alias("case"), F.col("user_id").alias("case_key"), z.alias("query_time"), F.when(k % 5 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("a"))).alias("access_labels"))
    evidence = events.select(F.col("user_id").alias("case_key"), k.alias("source_id"), F.when(k % 4 == 0, "2025-01-01T00:00:00Z").otherwise("2027-01-01T00:00:00Z").alias("valid_from"), F.when(k % 8 == 0, "2026-01-01T00:00:00Z").alias("valid_until"), F.array(F.lit("a"), F.lit("b")).alias("permitted_labels"), F.when(k % 3 == 0, "2025-06-01T00:00:00Z").alias("revoked_at"))
    return workflow.usable_evidence(cases, evidence, ["case"]).select(F.col("case").alias("case_key"), "source_id")


@query("lineitem", sql="SELECT l_orderkey AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, CAST(l_linenumber AS VARCHAR) AS unit_id FROM lineitem QUALIFY n BETWEEN 2 AND 3")
def drafting_slice(lineitem):
    u = lineitem.select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("order"), F.col("l_linenumber").cast("string").alias("unit_id"), F.col("l_returnflag").alias("text"))
    return workflow.drafting_slice(u, 2, 3).select("source_id", F.col("n").cast("long").alias("n"), "unit_id")


@query("concept", "relation", sql="SELECT concept_id AS source, target_id AS target, type FROM relation WHERE concept_id IN (SELECT concept_id FROM concept WHERE status = 'stable') AND target_id IN (SELECT concept_id FROM concept WHERE status = 'stable')")
def knowledge_graph(concept, relation):
    return workflow.graph_view(concept.where("status = 'stable'"), relation)


@query("job_event", "decision", "orders", sql="""SELECT count(*) FILTER (WHERE state IN ('queued', 'running')) AS active_jobs, count(*) FILTER (WHERE state = 'failed') AS failed_jobs,
 (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT proposal_id FROM decision WHERE receipt_id % 2 = 0)) AS pending, (SELECT count(DISTINCT proposal_id) FROM decision WHERE receipt_id % 2 = 0 AND decision = 'approved') AS approved FROM job_event""")
def project_assessment(job_event, decision, orders):
    return workflow.assessment(job_event, orders.select(F.col("o_custkey").alias("proposal_id")), decision.where("receipt_id % 2 = 0"))


@query("claim", sql="SELECT proposal_id AS path, 'sha256:' || sha256(string_agg(claim_id, chr(10) ORDER BY disposition, claim_id) || chr(10)) AS sidecar_hash FROM claim GROUP BY 1")
def sidecar_hashes(claim):
    return workflow.sidecar_hash(claim.select(F.col("proposal_id").alias("path"), F.col("disposition").alias("assertion_key"), F.col("claim_id").alias("id"), F.col("claim_id").alias("json")))


@query("supplier", sql="SELECT s_suppkey AS plugin, unnest(CASE WHEN s_suppkey % 10 = 0 THEN ['GRAPH_INVALID'] WHEN s_suppkey % 7 = 0 THEN ['LOCK_MISMATCH'] ELSE [] END) AS code FROM supplier UNION SELECT s_suppkey, 'DEPENDENCY_MISSING' FROM supplier WHERE (s_suppkey + 1) % 10 = 0 UNION SELECT s_suppkey, 'DEPENDENCY_MISSING' FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier) UNION SELECT s_suppkey, 'DEPENDENCY_INCOMPATIBLE' FROM supplier WHERE (s_suppkey + 1) % 10 <> 0 AND (s_suppkey + 1) % 3 = 0 AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)")
def plugin_errors(supplier):
    k = F.col("s_suppkey")
    lock = supplier.select(k.alias("plugin"), F.lit("h").alias("package_hash"))
    scans = supplier.where("s_suppkey % 10 <> 0").select(k.alias("plugin"), F.when(k % 3 == 0, "2.0.0").otherwise("1.4.0").alias("version"), F.when(k % 7 == 0, "x").otherwise("h").alias("package_hash"))
    needs = supplier.select(k.alias("plugin"), (k + 1).alias("dependency"), F.lit("^1.2.0").alias("range"), F.lit(False).alias("optional"))
    return workflow.plugin_errors(lock, scans, needs)


@query("part", sql="""WITH v AS (SELECT p_partkey AS plugin, p_size AS s, p_brand AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS n, p_type LIKE 'ECONOMY%' AS economy, p_type LIKE '%BRASS' AS brass FROM part),
 e AS (SELECT a.plugin, c.plugin AS dependency, c.s AS cs, a.economy, a.brass, c.brass AS cbrass FROM v a JOIN v c ON a.b = c.b AND c.n = a.n + 1)
SELECT plugin, CAST(NULL AS BIGINT) AS dependency, 'LOCK_MISMATCH' AS code FROM v WHERE brass
UNION ALL SELECT plugin, NULL, 'DEPENDENCY_INCOMPATIBLE' FROM v WHERE s > 40
UNION ALL SELECT plugin, dependency, CASE WHEN economy AND brass THEN 'LOCK_MISMATCH' WHEN brass THEN 'DEPENDENCY_MISSING' ELSE 'DEPENDENCY_INCOMPATIBLE' END FROM e WHERE brass OR cbrass OR cs < 10""")
def plugin_graph_errors(part):
    """Parts as plug-ins whose version has the size; each needs the next dearer one of its brand. Brass ones drifted and bind nothing, of economy ones the need is optional."""
    v = numbered(part.select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice"), ["p_brand"], ["p_retailprice", "p_partkey"], "n")
    v = v.select(F.col("p_partkey").alias("plugin"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")).alias("version"), F.lit("m").alias("manifest_hash"), F.sha2("p_type", 256).alias("package_hash"), F.col("p_type").like("%BRASS").alias("brass"), F.col("p_type").like("ECONOMY%").alias("economy"), "p_brand", "n", "p_size")
    identity = ["version", "manifest_hash", "package_hash"]
    scans = v.select("plugin", "version", "manifest_hash", F.when(F.col("brass"), "drifted").otherwise(F.col("package_hash")).alias("package_hash"), F.when(F.col("p_size") > 40, ">=2.0.0").otherwise("^1.2.0").alias("framework_range"), F.lit(None).cast("string").alias("format_range"))
    after = v.select("p_brand", (F.col("n") - 1).alias("n"), F.col("plugin").alias("dependency"), *identity)
    e = v.drop(*identity).join(after, ["p_brand", "n"])
    needs = e.select("plugin", "dependency", F.lit(">=1.10.0 <2.0.0").alias("range"), F.col("economy").alias("optional"))
    return workflow.plugin_graph_errors(v.select("plugin", *identity), e.where("not brass").select("plugin", "dependency", *identity), scans, needs, "1.4.0", "1.0.0")


LEASED = ("claim", "move", "release")
MOVES = ("running", "awaiting_approval", "completed", "failed")


def leased_events(events):
    """Events as requests for leases and moves: users as workflows, types as kinds, the amount as owner, the lease's length and the revision that is expected."""
    types = events.select("event_type").distinct().withColumn("n", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("event_type")))  # a row a type
    value = F.coalesce(F.floor("value"), F.lit(0)).cast("long")
    kind, to = F.array(*map(F.lit, LEASED)), F.array(*map(F.lit, MOVES))
    j = events.join(types, "event_type")
    return j.select(F.col("user_id").alias("workflow_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.get(kind, (F.col("n") - 1) % 3).alias("kind"), F.concat(F.lit("o"), (value % 2).cast("string")).alias("owner"),
                    ((value + 1) * 3_600_000).alias("lease_ms"), F.when(value % 3 == 2, 1).otherwise(0).cast("long").alias("expected_revision"), F.get(to, (value % 4).cast("int")).alias("to"))


@query("events")
def leased_workflows(events):
    """The stream's rules over all events, as a finished table."""
    return leases.in_order(leased_events(events))
