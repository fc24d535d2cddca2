"""Workflow records: review, contracts, permissions, checkpoints, migrations, plug-ins, evaluation windows, drafting."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.canonical import replaced_json
from marlstone.functions.policy import CLASSIFICATIONS, SEVERITIES, TRUST_TIERS, rank
from marlstone.functions.temporal import instant, is_date, is_instant
from marlstone.functions.text import byte_hash, is_byte_hash, ordered, redirects_out, short_id
from marlstone.functions.versions import range_intervals, version_point, within
from marlstone.operators.graph import closure
from marlstone.operators.json_tree import differences
from marlstone.operators.relational import tree_hash
from marlstone.operators.spans import numbered
from marlstone.operators.stage import spread

# Where in a policy path a changed leaf has which rule, and what counts as done with a copy.
BOUNDARY_WORDS = ("network", "execute", "macro", "subprocess", "credential", "permission", "security", "filesystem", "access", "rights", "resource", "memory", "cpu", "output", "budget", "limit")
DATED_WORDS = ("fresh", "stale", "retention", "policy", "waiver")
SURFACE_WORDS = ("configuration", "profile", "scope", "sensor", "normalizer", "template")
BOUNDARIES = ("credential", "filesystem", "network", "resources")
ERASED_STATES = ("purged", "crypto-shredded", "tombstoned")


# --- review -----------------------------------------------------------------------------


def unanchored(claims: DataFrame, units: DataFrame) -> DataFrame:
    """claim_id of claims whose (source_id, locator) no unit has; locators are canonical JSON text."""
    return claims.join(units.select("source_id", "locator").distinct(), ["source_id", "locator"], "left_anti").select("claim_id")


def excerpts(wanted: DataFrame, units: DataFrame, order: str) -> DataFrame:
    """The text of the first unit, by order, for each wanted (source_id, locator)."""
    first = units.groupBy("source_id", "locator").agg(F.min_by("text", order).alias("text"))
    return wanted.join(first, ["source_id", "locator"])


def direct_edits(concepts: DataFrame, receipts: DataFrame) -> DataFrame:
    """path, expected and current review hash of concepts that were changed after an approval."""
    j = concepts.join(receipts.where("decision = 'approved'").select("path", F.col("review_hash").alias("expected")), "path")
    return j.where("expected <> review_hash").select("path", "expected", F.col("review_hash").alias("current"))


def decided(current: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that take effect: the receipt that they expect is the proposal's active one (null: none yet); of several, the first id."""
    j = decisions.join(current.select("proposal_id", F.col("receipt_id").alias("active")), "proposal_id", "left").where(F.col("active").eqNullSafe(F.col("expected_receipt_id")))
    return j.groupBy("proposal_id").agg(F.min_by(F.struct("receipt_id", "decision"), "receipt_id").alias("d")).select("proposal_id", "d.*")


def stale_tokens(targets: DataFrame, store: DataFrame) -> DataFrame:
    """Targets of a transaction whose expected token isn't the store's."""
    return targets.join(store.select("path", F.col("token").alias("_now")), "path", "left").where(~F.col("_now").eqNullSafe(F.col("expected_token"))).drop("_now")


def promoted(publications: DataFrame) -> DataFrame:
    """Automatic drafts that were ratified, as stable ones."""
    return publications.where("auto and ratified").withColumn("status", F.lit("stable"))


# --- contracts and permissions ------------------------------------------------------------


def contract_errors(frame: DataFrame, key: str, contract: Mapping[str, Mapping]) -> DataFrame:
    """key, path, rule of every breach. contract: by column, required, const, enum, pattern, minimum, maximum, min_length, max_length, min_items, max_items, unique, format (date, date-time), needs (a column that has to be there too)."""
    checks = []
    for name, rules in contract.items():
        c = F.col(name)
        bad = {
            "required": c.isNull() if rules.get("required") else F.lit(False),
            "enum": ~c.isin(*rules["enum"]) if "enum" in rules else F.lit(False), "pattern": ~c.rlike(rules["pattern"]) if "pattern" in rules else F.lit(False),
            "minimum": c < rules["minimum"] if "minimum" in rules else F.lit(False), "maximum": c > rules["maximum"] if "maximum" in rules else F.lit(False),
            "max_length": F.length(c) > rules["max_length"] if "max_length" in rules else F.lit(False), "unique": F.size(F.array_distinct(c)) < F.size(c) if rules.get("unique") else F.lit(False),
            "min_length": F.length(c) < rules["min_length"] if "min_length" in rules else F.lit(False), "const": ~(c == rules["const"]) if "const" in rules else F.lit(False),
            "min_items": F.size(c) < rules["min_items"] if "min_items" in rules else F.lit(False), "max_items": F.size(c) > rules["max_items"] if "max_items" in rules else F.lit(False),
            "format": ~(is_date(c) if rules["format"] == "date" else is_instant(c)) & c.isNotNull() if rules.get("format") in ("date", "date-time") else F.lit(False),
            "needs": c.isNotNull() & F.col(rules["needs"]).isNull() if "needs" in rules else F.lit(False),
        }
        checks += [F.when(F.coalesce(b, F.lit(False)), F.struct(F.lit(name).alias("path"), F.lit(rule).alias("rule"))) for rule, b in bad.items() if rule in rules]
    return frame.select(key, F.explode(F.array_compact(F.array(*checks))).alias("e")).select(key, "e.*")


def project_errors(mounts: DataFrame, routes: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """code, subject: names that stand twice, writable mounts without exactly one primary, routes to what isn't mounted, and risk-based approval (settings: name, approval_policy, risk_policy) without a policy."""
    twice = mounts.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("MOUNT_DUPLICATE").alias("code"), F.col("name").alias("subject"))
    primary = mounts.agg(F.count_if(F.col("mode") != "read-only").alias("w"), F.count_if(F.col("role") == "primary").alias("p")).where("w > 0 and p <> 1").select(F.lit("PRIMARY_COUNT"), F.col("p").cast("string"))
    lost = routes.join(mounts.select(F.col("name").alias("target")), "target", "left_anti").select(F.lit("ROUTE_UNKNOWN"), "target")
    found = twice.union(primary).union(lost)
    if settings is None:
        return found
    return found.union(settings.where("approval_policy = 'risk-based' and risk_policy is null").select(F.lit("RISK_POLICY_MISSING"), F.col("name")))


def glob_pattern(glob: str) -> str:
    """A capability glob as a regular expression: * is a part, ** any number of parts; ValueError if it is unsafe."""
    parts = glob.split("/")
    if not glob or glob.startswith("/") or any(p not in ("*", "**") and not re.fullmatch(r"[A-Za-z0-9._@+-]+", p) or p in (".", "..") for p in parts):
        raise ValueError(f"unsafe pattern {glob!r}")
    out = ""
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        out += (".*" if last else "(?:[^/]+/)*") if p == "**" else ("[^/]+" if p == "*" else re.escape(p)) + ("" if last else "/")
    return f"^{out}$"


def permitted(requests: DataFrame, roles: Mapping[str, Mapping[str, tuple[str, ...]]], reviewers: tuple[str, ...] = ()) -> DataFrame:
    """requests (role, action, path) with allowed: a glob of the role's action matches a safe path. Reviewers never write, whatever their globs."""
    ok = F.lit(False)
    for role, actions in roles.items():
        for action, globs in actions.items():
            for g in globs:
                ok = ok | ((F.col("role") == role) & (F.col("action") == action) & F.col("path").rlike(glob_pattern(g)))
    safe = F.col("path").rlike(r"^[A-Za-z0-9._@+-]+(/[A-Za-z0-9._@+-]+)*$") & ~F.col("path").rlike(r"(^|/)\.\.?(/|$)")
    ok = ok & ~(F.col("role").isin(*reviewers) & (F.col("action") == "write")) if reviewers else ok
    return requests.withColumn("allowed", F.coalesce(ok & safe, F.lit(False)))


def scoped(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """requests (scope, operation) with allowed: the scope has that operation; an unknown scope has none."""
    s = scopes.select("scope", "operation", F.lit(True).alias("_in")).distinct()
    return requests.join(s, ["scope", "operation"], "left").withColumn("allowed", F.coalesce("_in", F.lit(False))).drop("_in")


def provenance_failures(concepts: DataFrame, sources: DataFrame, sidecar: DataFrame) -> DataFrame:
    """path, code: source ids that stand twice, malformed hashes, claims of unknown sources or of another hash."""
    apart = spread(sources, "path", "id")  # as small rows, else few tasks would hold the groups of all ids
    twice = apart.groupBy("path", "id").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("SOURCE_DUPLICATE").alias("code"))
    malformed = sources.where(F.col("source_hash").isNotNull() & ~is_byte_hash(F.col("source_hash"))).select("path", F.lit("SOURCE_HASH_INVALID"))
    j = sidecar.join(apart.select("path", F.col("id").alias("source_entry_id"), F.col("source_hash").alias("_h"), F.lit(True).alias("_there")), ["path", "source_entry_id"], "left")
    code = F.when(F.col("_there").isNull(), "CLAIM_SOURCE_UNKNOWN").when(~F.col("_h").eqNullSafe(F.col("source_hash")), "CLAIM_HASH_MISMATCH")
    lost = concepts.join(sources.select("path").distinct(), "path", "left_anti").where("not source_exempt").select("path", F.lit("SOURCE_MISSING"))
    return twice.union(malformed).union(j.select("path", code.alias("code")).where("code is not null")).union(lost).distinct()


# --- gates of models and erasure ----------------------------------------------------------


def model_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """requests (provider, model, required) with allowed: a route exists, is allowed and as high as the material; unknown denies."""
    j = requests.join(routes.select("provider", "model", F.col("allowed").alias("_allowed"), "max_classification"), ["provider", "model"], "left")
    ok = F.col("_allowed").eqNullSafe(True) & (rank(F.col("required"), CLASSIFICATIONS) <= rank(F.col("max_classification"), CLASSIFICATIONS))
    return j.withColumn("allowed", F.coalesce(ok, F.lit(False))).drop("_allowed", "max_classification")


def erasure_findings(inventory: DataFrame, required: DataFrame) -> DataFrame:
    """subject, code: required surfaces that the inventory lacks, known copies that remain."""
    subjects = inventory.select("subject").distinct()
    need = subjects.join(F.broadcast(required.select("surface")))  # the stated surfaces, for each subject
    lacks = need.join(inventory.select("subject", "surface"), ["subject", "surface"], "left_anti").select("subject", F.lit("ERASURE_INVENTORY_INCOMPLETE").alias("code"))
    remains = inventory.where(F.col("known_copy") & ~F.coalesce(F.col("status").isin(*ERASED_STATES), F.lit(False))).select("subject", F.lit("ERASURE_COPY_REMAINS"))
    return lacks.union(remains).distinct()


# --- checkpoints ---------------------------------------------------------------------------


def invalidated(stored: DataFrame, now: DataFrame, stages: DataFrame, fields: list[str]) -> DataFrame:
    """stage, depth: stages whose fingerprint differs (or is new or gone), and all that depend on them."""
    a, b = stored.select("stage", F.struct(*fields).alias("a")), now.select("stage", F.struct(*fields).alias("b"))
    seeds = a.join(b, "stage", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("stage").alias("node"))
    return closure(seeds, stages.select(F.col("stage").alias("node"), F.col("needs").alias("depends_on"))).withColumnRenamed("node", "stage")


def outbox(events: DataFrame, delivered: DataFrame) -> DataFrame:
    """Audit events that were written and not delivered."""
    return events.join(delivered.select("event_id"), "event_id", "left_anti")


def append_once(sink_path: str):
    """A foreachBatch function that writes each batch under its id, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    return write


# --- migrations and plug-ins ------------------------------------------------------------------


def weakening(diff: DataFrame) -> DataFrame:
    """diff (path, before, after as JSON text) with rule and weakening of each changed leaf."""
    path = F.lower("path")
    key = F.element_at(F.split(path, "/"), -1)
    has = lambda c, words: c.rlike("|".join(words))
    before, after = F.col("before"), F.coalesce("after", F.lit("null"))
    plain = lambda c, values: rank(F.regexp_replace(c, '^"|"$', ""), values)
    none, gone = before.isNull() | (before == "null"), after == "null"
    rises = lambda values: F.coalesce(plain(after, values) >= plain(before, values), F.lit(False))
    items = lambda c: F.from_json(c, "array<string>")
    kept = F.coalesce(F.size(F.array_except(items(before), items(after))) == 0, F.lit(False)) & ~gone
    shrinks = F.when(after == "false", True).when(before.isin("true", "false") & after.isin("true", "false"), (before == after) | (before == "true")).when(after.startswith("["), F.when(none, after == "[]").otherwise(F.coalesce(F.size(F.array_except(items(after), items(before))) == 0, F.lit(False)))).otherwise(F.coalesce(after.try_cast("double") <= before.try_cast("double"), F.lit(False)))
    when = lambda c: instant(F.regexp_replace(c, '^"|"$', ""))
    rule = (
        F.when(key.contains("trust"), "minimum-trust").when(has(key, ["approval", "mandatory_gate"]) | (key == "gates") | key.endswith("_gates"), "mandatory-gates").when(key.isin("blocking", "deterministic"), key).when(key == "severity", "sensor-severity")
        .when(has(path, BOUNDARY_WORDS), "permission-boundary").when(has(path, DATED_WORDS), "policy-boundary").when(has(path, SURFACE_WORDS), "unclassified-policy-surface").otherwise("content")
    )
    safe = (
        F.when(F.col("rule") == "minimum-trust", F.when(none, plain(after, TRUST_TIERS).isNotNull()).otherwise(rises(TRUST_TIERS))).when(F.col("rule") == "mandatory-gates", F.when(none, after.startswith("[")).otherwise(kept))
        .when(F.col("rule").isin("blocking", "deterministic"), after == "true").when(F.col("rule") == "sensor-severity", F.when(none, after == '"error"').otherwise(rises(SEVERITIES)))
        .when(F.col("rule") == "permission-boundary", shrinks).when(F.col("rule") == "policy-boundary", F.when(none, ~gone).otherwise(F.coalesce(when(after) <= when(before), F.lit(False)))).otherwise(F.col("rule") == "content")
    )
    return diff.withColumn("rule", rule).withColumn("weakening", ~safe)


def plugin_errors(lock: DataFrame, scans: DataFrame, needs: DataFrame) -> DataFrame:
    """plugin, code: locked and scanned plug-ins that don't match, and dependencies that are missing, undeclared or out of range.

    lock: plugin, package_hash; scans: plugin, version, package_hash; needs: plugin, dependency, range, optional.
    """
    j = lock.join(scans.select("plugin", F.col("package_hash").alias("_h"), F.lit(True).alias("_scanned")), "plugin", "full_outer")
    drift = j.where(~F.col("_h").eqNullSafe(F.col("package_hash"))).select("plugin", F.when(F.col("_scanned").isNull(), "GRAPH_INVALID").when(F.col("package_hash").isNull(), "GRAPH_INVALID").otherwise("LOCK_MISMATCH").alias("code"))
    have = scans.select(F.col("plugin").alias("dependency"), F.col("version").alias("_v"), version_point(F.col("version")).alias("_point"))
    d = needs.withColumn("_intervals", range_intervals(F.col("range"))).join(have, "dependency", "left")
    ok = within(F.col("_point"), F.col("_intervals"))
    code = F.when(F.col("_v").isNull() & ~F.col("optional"), "DEPENDENCY_MISSING").when(F.col("_v").isNotNull() & ~F.coalesce(ok, F.lit(False)), "DEPENDENCY_INCOMPATIBLE")
    return drift.union(d.select("plugin", code.alias("code")).where("code is not null")).distinct()


def plugin_graph_errors(lock: DataFrame, bound: DataFrame, scans: DataFrame, needs: DataFrame, framework: str, form: str) -> DataFrame:
    """plugin, dependency (null: the plug-in itself), code of all that keeps a locked graph from running.

    GRAPH_INVALID: locked or scanned only, or scanned twice. LOCK_MISMATCH: other bytes or
    another manifest than locked, a bound dependency that isn't declared, or an installed
    optional one that isn't bound. DEPENDENCY_MISSING: a required one isn't bound.
    DEPENDENCY_INCOMPATIBLE: a bound one isn't installed with the bound bytes and version
    or is out of the declared range, or the framework or format isn't in the plug-in's.

    lock: plugin, version, manifest_hash, package_hash; bound: plugin, dependency and the same
    three; scans: plugin, the three, framework_range, format_range (null: any); needs:
    plugin, dependency, range, optional. A malformed version or range is in no range. Every
    error is told, where a first one would end an installation.
    """
    same = lambda prefix: F.col("version").eqNullSafe(F.col(f"{prefix}version")) & F.col("manifest_hash").eqNullSafe(F.col(f"{prefix}manifest_hash")) & F.col("package_hash").eqNullSafe(F.col(f"{prefix}package_hash"))
    is_in = lambda point, wanted: F.coalesce(within(point, range_intervals(wanted)), F.lit(False))
    identity = ("version", "manifest_hash", "package_hash")
    once = scans.groupBy("plugin").agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_{c}") for c in identity])
    one = lock.withColumn("_locked", F.lit(True)).join(once, "plugin", "full_outer")
    own = one.select("plugin", F.when(F.col("_locked").isNull() | F.col("_n").isNull() | (F.col("_n") > 1), "GRAPH_INVALID").when(~same("_"), "LOCK_MISMATCH").alias("code"))
    hosted = is_in(version_point(F.lit(framework)), F.col("framework_range")) & (F.col("format_range").isNull() | is_in(version_point(F.lit(form)), F.col("format_range")))
    host = scans.select("plugin", F.when(~hosted, "DEPENDENCY_INCOMPATIBLE").alias("code"))
    have = once.select(F.col("plugin").alias("dependency"), F.lit(True).alias("_there"), version_point(F.col("_version")).alias("_point"), *[F.col(f"_{c}") for c in identity])
    edges = needs.withColumn("_declared", F.lit(True)).join(bound.withColumn("_bound", F.lit(True)), ["plugin", "dependency"], "full_outer").join(have, "dependency", "left")
    free, fits = F.col("_bound").isNull(), same("_") & F.col("_there").isNotNull() & is_in(F.col("_point"), F.col("range"))
    code = (
        F.when(F.col("_declared").isNull(), "LOCK_MISMATCH").when(free & ~F.coalesce("optional", F.lit(False)), "DEPENDENCY_MISSING")
        .when(free & F.col("_there").isNotNull(), "LOCK_MISMATCH").when(~free & ~fits, "DEPENDENCY_INCOMPATIBLE")
    )
    none = F.lit(None).cast(needs.schema["dependency"].dataType).alias("dependency")
    every = own.select("plugin", none, "code").union(host.select("plugin", none, "code")).union(edges.select("plugin", "dependency", code.alias("code")))
    return every.where("code is not null").distinct()


# --- evaluation, drafting, views ----------------------------------------------------------------


def usable_evidence(cases: DataFrame, evidence: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """case_key, carried columns and source_id of evidence in force at the case's time (its last instant included), with a label of its principal, and not revoked by then."""
    j = cases.join(evidence, "case_key")
    at = instant(F.col("query_time"))
    inside = (instant(F.col("valid_from")) <= at) & (F.col("valid_until").isNull() | (at <= instant(F.col("valid_until"))))
    revoked = F.coalesce(instant(F.col("revoked_at")) <= at, F.lit(False))
    return j.where(F.coalesce(inside, F.lit(False)) & F.arrays_overlap("access_labels", "permitted_labels") & ~revoked).select("case_key", *(carried or []), "source_id")


def drafting_slice(units: DataFrame, first: int, last: int) -> DataFrame:
    """Text units number first to last of each source, from 1, with an excerpt of 120 characters."""
    texts = units.where(F.coalesce(F.col("text"), F.lit("")) != "")
    return numbered(texts, ["source_id"], ["order"], "n").where(F.col("n").between(first, last)).select("source_id", "n", "unit_id", F.substring("text", 1, 120).alias("excerpt"))


def graph_view(catalog: DataFrame, relations: DataFrame) -> DataFrame:
    """source, target, type of edges between concepts of the catalog."""
    ids = catalog.select("concept_id").distinct()
    return relations.join(ids, "concept_id", "left_semi").join(ids.withColumnRenamed("concept_id", "target_id"), "target_id", "left_semi").select(F.col("concept_id").alias("source"), F.col("target_id").alias("target"), "type")


def assessment(jobs: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: jobs that run, failed jobs, proposals without a decision and approved ones."""
    j = jobs.agg(F.count_if(F.col("state").isin("queued", "running")).alias("active_jobs"), F.count_if(F.col("state") == "failed").alias("failed_jobs"))
    p = proposals.select("proposal_id").distinct().join(decisions.groupBy("proposal_id").agg(F.bool_or(F.col("decision") == "approved").alias("approved")), "proposal_id", "left")
    return j.join(p.agg(F.count_if(F.col("approved").isNull()).alias("pending"), F.count_if(F.col("approved")).alias("approved")))


def remaining(treatments: DataFrame, done: DataFrame) -> DataFrame:
    """Surfaces of an erasure that no checkpoint has yet: a resumed run treats these."""
    return treatments.join(done.select("surface_id"), "surface_id", "left_anti")


def sidecar_lines(claims: DataFrame) -> Column:
    """Aggregate: a concept's sidecar as JSON lines, by assertion key and id."""
    by = [ordered(claims, c).alias(f"k{i}") for i, c in enumerate(("assertion_key", "id"))]
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "json"))), lambda x: x["json"]), "\n")


def sidecar_hash(claims: DataFrame) -> DataFrame:
    """path, sidecar_hash of the canonical sidecar."""
    return claims.groupBy("path").agg(byte_hash(F.concat(sidecar_lines(claims), F.lit("\n"))).alias("sidecar_hash"))


# --- jobs, recordings, kits, publication -------------------------------------------------------


def created_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """idempotency_key, job_id, outcome of each distinct request to create a job: created, existing (the same input) or conflict (another input under the key).

    jobs: idempotency_key, job_id, input_hash; requests: idempotency_key, input_hash. A
    new job's id follows from its key.
    """
    one = requests.groupBy("idempotency_key").agg(F.min("input_hash").alias("input_hash"), (F.min("input_hash") != F.max("input_hash")).alias("_split"))
    j = one.join(jobs.select("idempotency_key", "job_id", F.col("input_hash").alias("_was")), "idempotency_key", "left")
    outcome = F.when(F.col("_split") | (F.col("_was") != F.col("input_hash")), "conflict").when(F.col("_was").isNotNull(), "existing").otherwise("created")
    return j.select("idempotency_key", F.when(outcome == "created", short_id("job", F.col("idempotency_key"))).when(outcome == "existing", F.col("job_id")).alias("job_id"), outcome.alias("outcome"))


def cancelled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """job_id, state, checkpoint of jobs after requests to cancel: at once where nothing runs, at its next checkpoint where one does; what has ended stays.

    jobs: job_id, state, checkpoint.
    """
    j = jobs.join(requests.select("job_id", F.lit(True).alias("_asked")).distinct(), "job_id", "left")
    state = F.when(F.col("_asked") & F.col("state").isin("queued", "parked", "awaiting_input"), "cancelled").when(F.col("_asked") & (F.col("state") == "running"), "cancelling").otherwise(F.col("state"))
    return j.select("job_id", state.alias("state"), "checkpoint")


def replayed(recordings: DataFrame, task: str, inputs: DataFrame) -> DataFrame:
    """recording_id, state, output of recorded model outputs: replayed if the task and every input hash are those of the run, else drift; an output whose proposals name claims that it lacks, or twice, is invalid.

    recordings: recording_id, task, input_hash, claim_ids, proposal_claim_ids, output;
    inputs: recording_id, input_hash. A stand-in for a model that gives the same each time.
    """
    j = recordings.join(inputs.select("recording_id", F.col("input_hash").alias("_now")), "recording_id", "left")
    claims, wanted = F.col("claim_ids"), F.col("proposal_claim_ids")
    bad = (F.size(F.array_distinct(claims)) < F.size(claims)) | (F.size(F.array_distinct(wanted)) < F.size(wanted)) | (F.size(F.array_except(wanted, claims)) > 0)
    state = F.when((F.col("task") != task) | ~F.col("input_hash").eqNullSafe(F.col("_now")), "drift").when(bad, "invalid").otherwise("replayed")
    return j.select("recording_id", state.alias("state"), F.when(state == "replayed", F.col("output")).alias("output"))


def recorded_claims(claims: DataFrame, replays: DataFrame, units: DataFrame) -> DataFrame:
    """recording_id, claim_id, state of the claims of replayed recordings: bound (its source, hash and locator are a unit's) or unanchored."""
    c = claims.join(replays.where("state = 'replayed'").select("recording_id"), "recording_id", "left_semi")
    j = c.join(units.select("source_id", "source_hash", "locator", F.lit(True).alias("_there")).distinct(), ["source_id", "source_hash", "locator"], "left")
    return j.select("recording_id", "claim_id", F.when(F.col("_there"), "bound").otherwise("unanchored").alias("state"))


def drafting_kit(units: DataFrame, titles: DataFrame, most_units: int = 200) -> DataFrame:
    """path, kind, content of a kit's files for each source: its evidence, a template to fill in and the locators with excerpts of 120 UTF-16 units. Beyond most_units a kit is asked for in slices, so that is an error."""
    u = units.where(F.coalesce(F.col("text"), F.lit("")) != "")
    if not u.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") > most_units).isEmpty():
        raise ValueError(f"a kit has at most {most_units} units")
    width = lambda x: F.when(F.octet_length(x) == 4, 2).otherwise(1)  # noqa: E731 - UTF-16 units of a character
    add = lambda acc, x: F.when(acc["n"] + width(x) <= 120, F.struct((acc["n"] + width(x)).alias("n"), F.concat(acc["s"], x).alias("s"))).otherwise(F.struct(F.lit(121).alias("n"), acc["s"].alias("s")))
    short = F.aggregate(F.filter(F.split(F.substring("text", 1, 120), ""), lambda x: x != ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), add)["s"]
    excerpt = F.when(F.octet_length("text") <= 120, F.col("text")).otherwise(short)
    g = u.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("order", F.col("text").alias("t"), "locator", excerpt.alias("e")))).alias("x")).join(titles, "source_id", "left")
    lines = lambda f: F.array_join(F.transform("x", f), "\n")
    files = {"evidence": ("evidence.txt", lines(lambda x: x["t"])), "template": ("template.md", F.concat(F.lit("---\ntype: \ntitle: "), F.coalesce("title", F.lit("")), F.lit("\nstatus: draft\n---\n"))), "locators": ("locators.txt", lines(lambda x: F.concat(x["locator"], F.lit("\t"), x["e"])))}
    rows = F.array(*[F.struct(F.concat(F.lit("kits/"), F.col("source_id").cast("string"), F.lit(f"/{name}")).alias("path"), F.lit(kind).alias("kind"), content.alias("content")) for kind, (name, content) in files.items()])
    return g.select(F.explode(rows).alias("f")).select("f.*")


def scaffold(projects: DataFrame) -> DataFrame:
    """path, content of a project's first files (name, title, knowledge_base_id); names that can't be a path are an error."""
    name, kb = F.col("name"), F.col("knowledge_base_id")
    bad = projects.where(~(name.rlike("^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$") & kb.rlike("^[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?$") & kb.contains(".")))
    if not bad.isEmpty():
        raise ValueError("a project's name or its knowledge base's id is invalid")
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"'))
    files = {
        "knowledge-project.yaml": F.concat(F.lit("kind: Project\nname: "), quote(name), F.lit("\ntitle: "), quote(F.col("title")), F.lit("\nknowledge_bases:\n  - name: primary\n    uri: ./knowledge/primary\n    mode: maintain\n    role: primary\n")),
        "knowledge/primary/index.md": F.lit("<!-- generated; do not edit -->\n# Knowledge Index\n"),
        "knowledge/primary/knowledge-base.yaml": F.concat(F.lit("kind: KnowledgeBase\nid: "), quote(kb), F.lit("\nname: primary\naccess:\n  classification: internal\n")),
        "purpose.md": F.concat(F.lit("# "), F.col("title"), F.lit("\n\nDescribe the purpose and scope.\n")),
    }
    rows = F.array(*[F.struct(F.concat(name, F.lit(f"/{path}")).alias("path"), content.alias("content")) for path, content in files.items()])
    return projects.select(F.explode(rows).alias("f")).select("f.*")


def placed(files: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """files (path, content) with state: written, or refused where a file is there already and may not be overwritten, or the path leaves its root."""
    j = files.join(existing.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    there = F.col("_there") & F.lit(not overwrite)
    return j.withColumn("state", F.when(redirects_out(F.col("path")) | F.coalesce(there, F.lit(False)), "refused").otherwise("written")).drop("_there")


def published(catalog: DataFrame, publications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog after publications, and their states: (path, title, description, byte_hash), (path, state).

    publications: path, title, description, content, creates. One that creates refuses to
    overwrite, one that updates needs its concept, and of several for a path none is taken
    (ambiguous). Indexes follow from the new catalog.
    """
    one = publications.groupBy("path").agg(F.count("*").alias("_n"), F.first("title").alias("title"), F.first("description").alias("description"), F.first("content").alias("content"), F.first("creates").alias("creates"))
    j = one.join(catalog.select("path", F.lit(True).alias("_there")), "path", "left")
    state = F.when(F.col("_n") > 1, "ambiguous").when(F.col("creates") & F.coalesce("_there", F.lit(False)), "exists").when(~F.col("creates") & F.col("_there").isNull(), "missing").otherwise("published")
    j = j.withColumn("state", state)
    done = j.where("state = 'published'").select("path", "title", "description", byte_hash(F.col("content")).alias("byte_hash"))
    return catalog.select("path", "title", "description", "byte_hash").join(done.select("path"), "path", "left_anti").unionByName(done), j.select("path", "state")


def elided(envelopes: DataFrame, arrays: list[str]) -> DataFrame:
    """envelopes with each list replaced by its number of members."""
    return envelopes.withColumns({c: F.coalesce(F.size(F.coalesce(F.col(c), F.array())), F.lit(0)) for c in arrays})


def sandbox_gaps(wanted: Column, given: Column) -> Column:
    """Sorted names of what an executable wants and a sandbox doesn't enforce or grant.

    wanted: struct<isolation, filesystem array<struct<root, access>>, network, credentials, subprocess, macros, memory, cpu, output>;
    given: struct<effective, enforced, filesystem, network, credentials, subprocess, macros, memory, cpu, output>.
    """
    covers = lambda grant, need: (grant["root"] == need["root"]) & ((grant["access"] == "write") | (grant["access"] == need["access"]))
    beyond = lambda k: F.size(F.array_except(wanted[k], given[k])) > 0
    gaps = F.concat(
        F.transform(F.array_except(F.array(*map(F.lit, BOUNDARIES)), given["enforced"]), lambda x: x),
        F.array_compact(F.array(
            F.when(F.exists(wanted["filesystem"], lambda need: ~F.exists(given["filesystem"], lambda grant: covers(grant, need))), "filesystem-scope"), F.when(beyond("network"), "network-scope"), F.when(beyond("credentials"), "credential-scope"),
            F.when(wanted["subprocess"] & ~given["subprocess"], "subprocess-scope"), F.when(wanted["macros"] & ~given["macros"], "macro-scope"),
            *[F.when(wanted[k] > given[k], f"{k}-ceiling") for k in ("memory", "cpu", "output")],
        )),
    )
    return F.when(wanted["isolation"] != "sandboxed", F.array(F.lit("isolation"))).when(~given["effective"], F.array(F.lit("effective-sandbox"))).otherwise(F.array_sort(F.array_distinct(gaps)))


def migrated(files: DataFrame, operations: DataFrame, confirmed: bool, waived: bool = False) -> DataFrame:
    """path, content, state of files after a migration's replacements, a row a file: replaced, unchanged, precondition (another value is there), or unconfirmed and downgrade where the preview isn't confirmed or a weakening isn't waived.

    files: path, content (JSON); operations: path, pointer, before, after (JSON), weakening.
    """
    j = files.join(operations, "path", "left")
    new = replaced_json(F.col("content"), F.col("pointer"), F.col("before"), F.col("after"))
    state = F.when(F.col("pointer").isNull(), "unchanged").when(F.lit(not confirmed), "unconfirmed").when(F.col("weakening") & F.lit(not waived), "downgrade").when(F.col("_new").isNull(), "precondition").otherwise("replaced")
    j = j.withColumn("_new", new).withColumn("state", state)
    return j.select("path", F.when(F.col("state") == "replaced", F.col("_new")).otherwise(F.col("content")).alias("content"), "state")


def migration_preview(operations: DataFrame) -> DataFrame:
    """migration_id, leaves, weakening, preview_hash of migrations before they run: every changed leaf with its rule, and one hash over all of them that a confirmation has to name.

    operations: migration_id, path, pointer, before, after (JSON).
    """
    d = differences(operations.withColumnRenamed("path", "file"), ["migration_id", "file", "pointer"], F.col("before"), F.col("after"))
    leaves = weakening(d.select("migration_id", "file", F.concat("pointer", "path").alias("path"), "before", "after"))
    line = F.concat_ws("\0", "file", "path", "rule", F.coalesce("before", F.lit("-")), F.coalesce("after", F.lit("-")))
    g = leaves.groupBy("migration_id").agg(F.count("*").alias("leaves"), F.bool_or("weakening").alias("weakening"), F.array_sort(F.collect_list(line)).alias("x"))
    return g.select("migration_id", "leaves", "weakening", byte_hash(F.array_join("x", "\n")).alias("preview_hash"))


def contribution_errors(contributions: DataFrame, policy: DataFrame) -> DataFrame:
    """plugin, id, code of contributions that set what the policy fixes for their type otherwise (POLICY_DOWNGRADE), or have an id that another plug-in's contribution of the type has (CONTRIBUTION_CONFLICT).

    contributions: plugin, type, id, setting, value; policy: type, setting, value.
    """
    weak = contributions.join(policy.select("type", "setting", F.col("value").alias("_fixed")), ["type", "setting"]).where("value <> _fixed").select("plugin", "id", F.lit("POLICY_DOWNGRADE").alias("code"))
    owners = contributions.select("plugin", "type", "id").distinct()
    twice = owners.groupBy("type", "id").agg(F.count("*").alias("n")).where("n > 1")
    return weak.union(owners.join(twice, ["type", "id"], "left_semi").select("plugin", "id", F.lit("CONTRIBUTION_CONFLICT"))).distinct()


def install_report(plugins: DataFrame, errors: DataFrame, gaps: DataFrame) -> DataFrame:
    """plugin, allowed, codes: a plug-in may be installed if nothing was found (errors: plugin, code) and its sandbox has no gap (gaps: plugin, gap)."""
    found = errors.select("plugin", "code").union(gaps.select("plugin", F.concat(F.lit("SANDBOX_"), "gap"))).groupBy("plugin").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    j = plugins.select("plugin").distinct().join(found, "plugin", "left")
    return j.select("plugin", F.col("codes").isNull().alias("allowed"), F.coalesce("codes", F.lit("")).alias("codes"))


def package_scans(files: DataFrame, declared: DataFrame) -> DataFrame:
    """plugin, n_files, package_hash, codes: the digest of a package's files (plugin, path, content, mode), and files with unsafe paths, links, or executables that it doesn't declare (plugin, path)."""
    j = files.join(declared.select("plugin", "path", F.lit(True).alias("_said")).distinct(), ["plugin", "path"], "left")
    code = F.when(redirects_out(F.col("path")), "PACKAGE_PATH_UNSAFE").when(F.col("mode") == "link", "PACKAGE_LINK").when((F.col("mode") == "executable") & F.col("_said").isNull(), "EXECUTABLE_UNDECLARED")
    found = j.groupBy("plugin").agg(F.array_join(F.array_sort(F.collect_set(code)), ",").alias("codes"))
    return tree_hash(files, "plugin", "path", "content").join(found, "plugin").select("plugin", "n_files", F.col("tree_hash").alias("package_hash"), "codes")
