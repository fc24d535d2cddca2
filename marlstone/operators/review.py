"""Review packets, receipts, authorizations and what gates and erasure runs leave behind, as canonical JSON with hashes."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.canonical import artifact_hash_column, canonical_json_column, canonical_struct
from marlstone.functions.policy import CLASSIFICATIONS, rank
from marlstone.functions.temporal import instant, is_instant
from marlstone.functions.text import byte_hash, is_byte_hash, utf16_sorted
from marlstone.operators.governance import retention, treatment
from marlstone.operators.graph import closure, impact_seeds

DECISIONS = ("approved", "rejected", "changes-requested")
_true = lambda c: F.coalesce(c, F.lit(False))
_filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""


def _sorted(c: str) -> Column:
    return utf16_sorted(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias(c)


# --- gates ------------------------------------------------------------------------------


def hashed_reports(reports: DataFrame, policy_hash: str) -> DataFrame:
    """reports (gate, subject, allowed, codes) with report_hash, over the canonical JSON of all of it and the policy's hash."""
    body = F.to_json(F.struct("allowed", "codes", "gate", F.lit(policy_hash).alias("policy_hash"), F.col("subject").cast("string").alias("subject")))
    return reports.withColumn("report_hash", artifact_hash_column(body))


def classification_codes(gate: Column, required: Column, derived: Column, may_read: Column, declassified: Column) -> Column:
    """What the declassification sensor finds: required is the most restricted class of the materials, derived the result's, declassified whether an authorization covers exactly this."""
    need, have = rank(required, CLASSIFICATIONS), rank(derived, CLASSIFICATIONS)
    retrieval = gate == "retrieval"
    code = F.when(need.isNull(), "CLASSIFICATION_MISSING").when(retrieval & ~_true(may_read), "ACCESS_DENIED").when((have < need) & ~_true(declassified), "DECLASSIFICATION_REQUIRED").when(have.isNull() & ~retrieval, "DERIVED_CLASSIFICATION_MISSING")
    return F.array_compact(F.array(code))


def declassifications(requests: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """requests (subject, from_class, to_class, policy_ref, role, reason, expires_at) with issued: a reasoned, current downgrade that a rule (policy_ref, role, from_class, to_class) gives that role."""
    keys = ["policy_ref", "role", "from_class", "to_class"]
    j = requests.join(rules.select(*keys, F.lit(True).alias("_rule")).distinct(), keys, "left")
    lower = rank(F.col("to_class"), CLASSIFICATIONS) < rank(F.col("from_class"), CLASSIFICATIONS)
    return j.withColumn("issued", _true(F.col("_rule") & lower & _filled("reason") & _filled("subject") & (instant(F.col("expires_at")) > now))).drop("_rule")


def issued_waivers(requests: DataFrame, roles: DataFrame, now: Column) -> DataFrame:
    """requests (id, sensor, gate, subject, role, reason, expires_at) with issued: the role may waive that sensor at that gate, and the waiver is exact, reasoned and current."""
    keys = ["sensor", "gate", "role"]
    j = requests.join(roles.select(*keys, F.lit(True).alias("_may")).distinct(), keys, "left")
    return j.withColumn("issued", _true(F.col("_may") & _filled("id") & _filled("subject") & _filled("reason") & (instant(F.col("expires_at")) > now))).drop("_may")


def gate_input(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """proposal_id, materials (distinct, sorted), claims, unknown_sources, conflicts: what a gate is given, a claim's source being of unknown class without evidence."""
    j = claims.join(evidence.select("source_id", "source_class"), "source_id", "left")
    return j.groupBy("proposal_id").agg(F.array_sort(F.collect_set("source_id")).alias("materials"), F.count("*").alias("claims"), F.count_if(F.coalesce("source_class", F.lit("unknown")) == "unknown").alias("unknown_sources"), F.count_if(F.col("disposition") == "conflict").alias("conflicts"))


# --- review -----------------------------------------------------------------------------


def review_packets(proposals: DataFrame, claims: DataFrame, sensors: DataFrame) -> DataFrame:
    """proposal_id, packet (canonical JSON), blocked, packet_hash: the claims by disposition, the sources, the sensors' codes and the review hash that a reviewer sees as one artifact.

    proposals: proposal_id (text), review_hash, revision; claims: proposal_id, claim_id,
    disposition, source_id; sensors: proposal_id, code, blocking.
    """
    bucket = lambda d: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("disposition") == d, F.col("claim_id"))))).alias(d)
    c = claims.groupBy("proposal_id").agg(F.struct(*[bucket(d) for d in ("accepted", "conflict", "merged", "rejected")]).alias("claims"), F.array_sort(F.collect_set(F.col("source_id").cast("string"))).alias("sources"))
    s = sensors.groupBy("proposal_id").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.bool_or("blocking").alias("blocked"))
    j = proposals.join(c, "proposal_id", "left").join(s, "proposal_id", "left")
    body = F.struct("claims", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.col("proposal_id").alias("proposal"), "review_hash", "revision", "sources")
    packets = j.select("proposal_id", canonical_struct(body).alias("packet"), _true(F.col("blocked")).alias("blocked"))
    return packets.withColumn("packet_hash", byte_hash(F.col("packet")))


def review_receipts(packets: DataFrame, decisions: DataFrame) -> DataFrame:
    """receipt_id, proposal_id, decision, packet_hash, receipt_hash, state of decisions (receipt_id, proposal_id, decision, reviewer, reviewed_at) on packets: issued to human reviewers at a known instant, else refused."""
    j = decisions.join(packets.select("proposal_id", "packet_hash"), "proposal_id", "left")
    ok = F.col("packet_hash").isNotNull() & F.col("reviewer").startswith("human:") & F.col("decision").isin(*DECISIONS) & is_instant(F.col("reviewed_at"))
    body = byte_hash(canonical_struct(F.struct("decision", F.col("receipt_id").alias("id"), "packet_hash", F.col("proposal_id").alias("proposal"), "reviewed_at", "reviewer")))
    state = F.when(_true(ok), "issued").otherwise("refused")
    return j.select("receipt_id", "proposal_id", "decision", "packet_hash", F.when(state == "issued", body).alias("receipt_hash"), state.alias("state"))


def freshness_authorizations(packets: DataFrame, requests: DataFrame, active: DataFrame) -> DataFrame:
    """proposal_id, value_hash, authorization_hash, state: granted where the packet's freshness is separate, the role reviews governance and the expected authorization is the active one; else denied or conflict.

    packets: proposal_id, packet_hash, freshness_mode; requests: proposal_id, role, actor,
    stale_after, expected_hash; active: proposal_id, authorization_hash.
    """
    j = requests.join(packets.select("proposal_id", "packet_hash", "freshness_mode"), "proposal_id", "left").join(active.select("proposal_id", F.col("authorization_hash").alias("_active")), "proposal_id", "left")
    may = F.col("packet_hash").isNotNull() & F.col("freshness_mode").eqNullSafe("separate") & F.col("role").eqNullSafe("governance-reviewer")
    state = F.when(~may, "denied").when(~F.col("_active").eqNullSafe(F.col("expected_hash")), "conflict").otherwise("granted")
    j = j.select("*", state.alias("state"), F.when(state == "granted", byte_hash(F.concat(F.lit('"'), "stale_after", F.lit('"')))).alias("value_hash"))
    body = byte_hash(canonical_struct(F.struct("actor", "packet_hash", F.col("proposal_id").alias("proposal"), "value_hash")))
    return j.select("proposal_id", "value_hash", F.when(F.col("state") == "granted", body).alias("authorization_hash"), "state")


def prepared(stored: DataFrame, regenerated: DataFrame, assessed: DataFrame, receipts: DataFrame, now: str) -> DataFrame:
    """proposal_id, state, intent: a publication that may go on (its packet, made again, is the stored one, and its assessment allows it), else review-input-drift or denied."""
    j = stored.select("proposal_id", F.col("packet_hash").alias("_was")).join(regenerated.select("proposal_id", F.col("packet_hash").alias("_now")), "proposal_id", "left")
    j = j.join(assessed.select("proposal_id", "allowed"), "proposal_id", "left").join(receipts.select("proposal_id", "receipt_id"), "proposal_id", "left")
    state = F.when(~F.col("_was").eqNullSafe(F.col("_now")), "review-input-drift").when(~_true(F.col("allowed")), "denied").otherwise("prepared")
    intent = canonical_struct(F.struct(F.col("_was").alias("packet_hash"), F.lit(now).alias("prepared_at"), F.col("proposal_id").alias("proposal"), F.col("receipt_id").alias("receipt")))
    return j.select("proposal_id", state.alias("state"), F.when(state == "prepared", intent).alias("intent"))


def reconciled(concepts: DataFrame, approvals: DataFrame) -> DataFrame:
    """path, expected_review_hash, current_review_hash, state of each concept with an active approval: unneeded (nothing that was reviewed has changed), candidate (a proposal for the edit) or invalid (the approval isn't approved or is bound to something else).

    concepts: path, review_hash; approvals: path, decision, review_hash, packet_review_hash.
    """
    j = concepts.join(approvals.select("path", "decision", F.col("review_hash").alias("expected_review_hash"), "packet_review_hash"), "path")
    bound = (F.col("decision") == "approved") & F.col("expected_review_hash").eqNullSafe(F.col("packet_review_hash"))
    state = F.when(~_true(bound), "invalid").when(F.col("review_hash") == F.col("expected_review_hash"), "unneeded").otherwise("candidate")
    return j.select("path", "expected_review_hash", F.col("review_hash").alias("current_review_hash"), state.alias("state"))


# --- erasure ----------------------------------------------------------------------------


def surface_identity(surfaces: DataFrame) -> DataFrame:
    """surface_id, identity_hash over kind, strategy, path, sorted bindings and dependencies, and retention."""
    body = F.to_json(F.struct(_sorted("depends_on"), F.col("surface_id").alias("id"), "kind", "path", "retained_until", _sorted("source_hashes"), _sorted("source_ids"), "strategy"), {"ignoreNullFields": "false"})
    return surfaces.select("surface_id", artifact_hash_column(body).alias("identity_hash"))


def tombstones(treated: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """surface_id, tombstone: no more than the permitted fields (of source_id, source_hash, event_id) of what was deleted, with its kind and the decision's hash."""
    known = [F.col(k).cast("string").alias(k) for k in ("source_id", "source_hash", "event_id") if k in allowed]
    body = F.struct("decision_hash", *known, F.lit("deleted").alias("status"), F.struct("kind").alias("surface"))
    return treated.select("surface_id", canonical_json_column(F.to_json(body)).alias("tombstone"))


def active_holds(holds: DataFrame, impacted: DataFrame) -> DataFrame:
    """hold_id of active holds on an impacted source that name one of its impacted kinds, or none. A registry with a hold twice is an error.

    holds: hold_id, source_id, status, kinds; impacted: source_id, kind.
    """
    if not holds.groupBy("hold_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a hold stands twice")
    kinds = impacted.groupBy("source_id").agg(F.collect_set("kind").alias("_kinds"))  # a fixed number of kinds
    return holds.where("status = 'active'").join(kinds, "source_id").where(F.col("kinds").isNull() | F.arrays_overlap("kinds", "_kinds")).select("hold_id")


def erasure_receipt(treatments: DataFrame, done: DataFrame, copies: DataFrame, action: str) -> DataFrame:
    """kind, treated, remaining, result: after a run, by kind and in total (kind null). The result is incomplete while a surface is untreated or a copy of it is still found."""
    mark = lambda df, name: df.select("surface_id", F.lit(True).alias(name)).distinct()
    j = treatments.join(mark(done, "_done"), "surface_id", "left").join(mark(copies, "_copy"), "surface_id", "left")
    open_ = F.col("_done").isNull() | F.col("_copy").isNotNull()
    g = j.rollup("kind").agg(F.count_if(~open_).alias("treated"), F.count_if(open_).alias("remaining"))
    return g.withColumn("result", F.when(F.col("remaining") > 0, "incomplete").otherwise("erased" if action == "erase" else "revoked"))


def drifted_surfaces(planned: DataFrame, current: DataFrame) -> DataFrame:
    """surface_id, state (missing, added, changed) of surfaces whose identity isn't the planned one."""
    j = planned.select("surface_id", F.col("identity_hash").alias("_a")).join(current.select("surface_id", F.col("identity_hash").alias("_b")), "surface_id", "full_outer")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return j.select("surface_id", state.alias("state")).where("state is not null")


def revocation_plan(surfaces: DataFrame, source: DataFrame, holds: DataFrame, action: str, now: Column, immediate: bool = False) -> DataFrame:
    """surface_id, kind, depth, blocked_by, state: what a revocation or an erasure of a source reaches (by id or hash, then by dependency), and what becomes of it.

    surfaces: surface_id, kind, source_ids, source_hashes, depends_on (array),
    retained_until; source: one row of source_id, source_hash; holds: source_id, kinds,
    active. A revocation is never blocked; an erasure leaves what a hold or a retention
    keeps. A source that no surface holds is an error.
    """
    edges = surfaces.select(F.col("surface_id").alias("node"), F.explode("depends_on").alias("depends_on"))
    reached = closure(impact_seeds(surfaces, source), edges)
    if reached.isEmpty():
        raise ValueError("no surface holds the source")
    hit = surfaces.join(reached.select(F.col("node").alias("surface_id"), "depth"), "surface_id").select("surface_id", "kind", "depth", "retained_until").crossJoin(F.broadcast(source.select("source_id")))  # one row
    if action == "revoke":
        kept = hit.select("surface_id", F.lit(None).cast("string").alias("blocked_by"))
    else:
        kept = retention(hit, holds, now, immediate).select("surface_id", "blocked_by")
    j = hit.join(kept, "surface_id")
    return j.select("surface_id", "kind", "depth", "blocked_by", F.when(F.col("blocked_by").isNull(), treatment(F.col("kind"), action)).otherwise("kept").alias("state"))


class ExternalProcessor(Protocol):
    """What deletes copies outside: it lists them, deletes one by its id and tells whether it is gone. Its transport and credentials are its own."""

    def inventory(self, source_id: str) -> list[str]: ...

    def delete(self, object_id: str) -> None: ...

    def verify(self, object_id: str) -> bool: ...


def external_treatments(spark: SparkSession, processors: dict[str, ExternalProcessor], source_id: str) -> DataFrame:
    """processor, object_id, state (deleted, remains, failed) of a source's copies with external processors; each is called from the driver, object by object, and a failure is a row."""
    rows = []
    for name, p in processors.items():
        for object_id in p.inventory(source_id):
            try:
                p.delete(object_id)
                rows.append((name, object_id, "deleted" if p.verify(object_id) else "remains"))
            except Exception:  # noqa: BLE001 - what a processor raises is its own; the copy counts as there
                rows.append((name, object_id, "failed"))
    return spark.createDataFrame(rows, "processor string, object_id string, state string")


def citation_records(sources: DataFrame) -> DataFrame:
    """concept_id, id, resource, source_hash of sources that can be cited: an id, a resource and, if there is a hash, a whole one."""
    ok = F.col("id").isNotNull() & F.col("resource").isNotNull() & (F.col("source_hash").isNull() | is_byte_hash(F.col("source_hash")))
    return sources.where(ok).select("concept_id", "id", "resource", "source_hash")


def shown_packets(packets: DataFrame, claims: DataFrame, units: DataFrame) -> DataFrame:
    """proposal_id, packet_hash, excerpts: a packet with the text behind each of its claims (source_id, locator), null where no unit has it, in the claims' order."""
    first = units.groupBy("source_id", "locator").agg(F.min("text").alias("text"))
    c = claims.join(first, ["source_id", "locator"], "left").groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "text"))).alias("x"))
    return packets.select("proposal_id", "packet_hash").join(c, "proposal_id", "left").select("proposal_id", "packet_hash", F.transform("x", lambda r: r["text"]).alias("excerpts"))


def awaiting_ratification(rationales: DataFrame, proposals: DataFrame) -> DataFrame:
    """workflow_id, proposal_id, title, subject, auto_approved_at of the drafts that were approved by rule and that nobody has ratified; a proposal that is gone lends its id as the title.

    rationales: workflow_id, proposal_id, auto, ratified, decided_at; proposals: workflow_id, proposal_id, title, subject.
    """
    open_ = rationales.where(F.coalesce("auto", F.lit(False)) & ~F.coalesce("ratified", F.lit(False)))
    j = open_.join(proposals.select("workflow_id", "proposal_id", "title", "subject"), ["workflow_id", "proposal_id"], "left")
    return j.select("workflow_id", "proposal_id", F.coalesce("title", F.col("proposal_id").cast("string")).alias("title"), "subject", F.col("decided_at").alias("auto_approved_at"))
