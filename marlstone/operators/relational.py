"""The implicit joins, aggregates, windows and set operations of the model, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.text import byte_hash, utf16_sorted
from marlstone.operators.spans import following, numbered, previous

# Allowed next states.
JOB_STATES = {"queued": ("running", "cancelled"), "running": ("completed", "failed", "cancelled", "parked", "awaiting_input"), "awaiting_input": ("queued", "cancelled"), "parked": ("queued", "cancelled"), "completed": (), "failed": (), "cancelled": ()}
WORKFLOW_STATES = {
    "planned": ("running", "cancelled"), "running": ("awaiting_approval", "completed", "failed", "cancelled", "parked"), "awaiting_approval": ("running", "rejected", "cancelled"),
    "failed": ("retrying", "cancelled"), "retrying": ("running", "failed", "cancelled"), "parked": ("running", "cancelled"), "completed": (), "rejected": (), "cancelled": (),
}
Z = 1.959963984540054


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unbound(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner: they have to be none."""
    return left.join(right.select(*keys), keys, "left_anti")


def mismatched(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, state (missing-left, missing-right, differs) of a full outer comparison by identity."""
    a = left.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    b = right.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    state = F.when(F.col("_in_a").isNull(), "missing-left").when(F.col("_in_b").isNull(), "missing-right").when(~same, "differs")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def structural_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, path, before, after of every column that changed; columns become text."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(key, "x.path", F.col("x.value").alias(name))
    return long(before, "before").join(long(after, "after"), [key, "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the last by order; the maximum is combined before the shuffle, so no key is gathered."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], *rest)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def transitions(events: DataFrame, key: str, order: list[str], states: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each event with the state before it and allowed; the first state of a key is allowed if it is the machine's first."""
    table = F.create_map(*[F.lit(x) for k, v in states.items() for x in (k, ",".join(v))])
    allowed = F.split(table[F.col("previous")], ",")
    first = next(iter(states))
    return previous(events, [key], order, F.col("state"), "previous").withColumn("allowed", F.when(F.col("previous").isNull(), F.col("state") == first).otherwise(F.coalesce(F.array_contains(allowed, F.col("state")), F.lit(False))))


def sequenced(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A contiguous sequence from 1 in each key."""
    return numbered(events, [key], order, "sequence")


def sequence_gaps(events: DataFrame, key: str) -> DataFrame:
    """Rows whose sequence isn't one more than the one before (from 1)."""
    before = previous(events, [key], ["sequence"], F.col("sequence"), "_before")
    return before.withColumn("expected", F.coalesce("_before", F.lit(0)) + 1).drop("_before").where("sequence <> expected")


def idempotent(requests: DataFrame, key: str, payload: str) -> DataFrame:
    """key, requests, payloads, conflict: whether one key was used with different payloads."""
    g = requests.groupBy(key).agg(F.count("*").alias("requests"), F.count_distinct(F.sha2(F.col(payload).cast("binary"), 256)).alias("payloads"))
    return g.withColumn("conflict", F.col("payloads") > 1)


def expired(leases: DataFrame, key: str, at: str, seconds: int, now: Column) -> DataFrame:
    """key, heartbeat, expired: the last heartbeat and whether its lease is over."""
    return leases.groupBy(key).agg(F.max(at).alias("heartbeat")).withColumn("expired", F.col("heartbeat") + F.expr(f"interval {seconds} seconds") <= now)


def changed(files: DataFrame, ledger: DataFrame, key: str, text: str, force: bool = False) -> DataFrame:
    """Files that the ledger doesn't have with the same bytes; all of them with force."""
    f = files.withColumn("content_hash", byte_hash(F.col(text)))
    return f if force else f.join(ledger.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def claim_buckets(claims: DataFrame, key: str) -> DataFrame:
    """Number of claims of each disposition."""
    n = lambda *d: F.count_if(F.col("disposition").isin(*d))
    return claims.groupBy(key).agg(n("accepted").alias("accepted"), n("rejected").alias("rejected"), n("merged").alias("merged"), n("conflict").alias("conflicting"))


def corroboration(claims: DataFrame, key: str, minimum: int) -> DataFrame:
    """key, n_sources (distinct ids), consequential, codes of falsehood findings.

    A source that claims authority (source_class, if the claims have that column) needs the
    policy that gives it (authority_policy_ref).
    """
    spoofed = (F.col("source_class") == "authoritative") & F.col("authority_policy_ref").isNull() if "source_class" in claims.columns else F.lit(False)
    g = claims.groupBy(key).agg(F.count_distinct("source_id").alias("n_sources"), F.bool_or("consequential").alias("consequential"), F.bool_or(F.col("compromised") | (F.col("disposition") == "conflict")).alias("conflict"), F.coalesce(F.bool_or(spoofed), F.lit(False)).alias("spoofed"))
    codes = F.array_compact(F.array(F.when(F.col("spoofed"), "AUTHORITY_METADATA_UNTRUSTED"), F.when(F.col("conflict"), "FALSEHOOD_CONFLICT_UNRESOLVED"), F.when(F.col("consequential") & (F.col("n_sources") < minimum), "FALSEHOOD_CORROBORATION_REQUIRED")))
    return g.select(key, "n_sources", "consequential", F.array_join(F.array_sort(codes), ",").alias("codes"))


def wilson_lower(successes: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of the Wilson interval; null without observations."""
    p, z2 = successes / n, z * z
    return F.when(n > 0, F.greatest(F.lit(0.0), (p + z2 / (2 * n) - z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)))


def receipt_states(receipts: DataFrame, probes: DataFrame, key: str = "source_id") -> DataFrame:
    """Receipts with a live probe: unreachable, indeterminate, current or stale, and the action that follows."""
    j = receipts.join(probes.select(key, F.col("kind").alias("_kind"), F.col("value").alias("_value")), key, "left")
    state = F.when(F.coalesce(F.col("_value"), F.lit("")) == "", "unreachable").when(~F.col("_kind").eqNullSafe(F.col("kind")), "indeterminate").when(F.col("_value") == F.col("value"), "current").otherwise("stale")
    action = F.when(state == "stale", "refresh").when(state == "current", "none").otherwise("investigate-source")
    return j.select(key, state.alias("state"), action.alias("action"))


def routed(concepts: DataFrame, explicit: Column, owner: Column, by_type: Column, default: Column, writable: DataFrame) -> DataFrame:
    """target and action of each write: explicit, else owner, else the type's route, else the default; none is ambiguous."""
    t = concepts.withColumn("target", F.coalesce(explicit, owner, by_type, default)).join(writable.select(F.col("mount_id").alias("target"), "mode"), "target", "left")
    action = F.when(F.col("target").isNull(), "ambiguous").when(F.col("mode").isNull(), "unknown").when(F.col("mode").isin("propose", "read-only"), "proposal").otherwise("write")
    return t.withColumn("action", action).drop("mode")


def coverage(discovered: DataFrame, represented: DataFrame, key: str) -> DataFrame:
    """key, side: what is on one side only (missing, ungoverned)."""
    return unbound(discovered.select(key).distinct(), represented, [key]).withColumn("side", F.lit("missing")).union(unbound(represented.select(key).distinct(), discovered, [key]).withColumn("side", F.lit("ungoverned")))


def tree_hash(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """key, n_files, tree_hash: one digest a key over its files in path order.

    The files are dealt to 4,096 parts by a hash of the path; each part has a digest over
    its lines in order, and the key's digest is that of its parts' digests in order, so
    that no task gathers a key's whole listing.
    """
    line = F.concat(F.col(path), F.lit("\0"), F.sha2(F.col(content).cast("binary"), 256))
    rows = files.select(F.col(key), F.substring(F.sha2(F.col(path).cast("binary"), 256), 1, 3).alias("part"), line.alias("line"))
    digest = lambda lines: F.sha2(F.array_join(utf16_sorted(F.collect_list(lines)), "\n").cast("binary"), 256)
    parts = rows.groupBy(key, "part").agg(digest("line").alias("d"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(F.sum("n").alias("n_files"), F.concat(F.lit("sha256:"), digest(F.concat("part", F.lit(":"), "d"))).alias("tree_hash"))


def superseded(history: DataFrame, key: str, order: list[str], entry: str) -> DataFrame:
    """Each entry of a key's history with the one that came after it (null for the active one)."""
    return following(history, [key], order, F.col(entry), "superseded_by")


def within_caps(items: DataFrame, keys: list[str], order: str, size: Column, most_bytes: int, most_items: int) -> DataFrame:
    """keys, items, bytes, within: how many of a key's items, in order, stay under both caps together.

    Sums run in spans of the order, and the spans' totals give the offsets, so that a key
    with very many items is never one window.
    """
    d = items.select(*keys, F.col(order).alias("_o"), F.floor(F.col(order) / 4096).alias("_span"), size.cast("long").alias("_b"))
    totals = d.groupBy(*keys, "_span").agg(F.sum("_b").alias("b"), F.count("*").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_span", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*keys, "_span").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    r = d.withColumns({"_rb": F.sum("_b").over(inside), "_rn": F.count("*").over(inside)}).join(offsets, [*keys, "_span"])
    good = (F.col("_rb") + F.col("b0") <= most_bytes) & (F.col("_rn") + F.col("n0") <= most_items)
    return r.groupBy(*keys).agg(F.count("*").alias("items"), F.sum("_b").alias("bytes"), F.count_if(good).alias("within"))


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, or an error when it is used if it has more rows: a list's bound fails and never cuts."""
    if df.count() > most:
        raise ValueError(f"more than {most} {what}")
    return df


def health(diagnostics: DataFrame, key: str) -> DataFrame:
    """key, checks, failing, healthy: nothing that was checked fails. diagnostics: key, status (pass, warn, fail)."""
    return diagnostics.groupBy(key).agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "fail").alias("failing"), (~F.bool_or(F.col("status") == "fail")).alias("healthy"))


def appended(log: DataFrame, events: DataFrame, key: str = "stream", idempotency: str = "idempotency_key", payload: str = "payload") -> DataFrame:
    """key, idempotency key, payload, sequence, state of each new event: appended with the next numbers of its stream, a repeat (the same payload is there) or a conflict.

    log: key, idempotency key, payload, sequence. Events with one idempotency key and
    different payloads are one conflict, told with the smallest payload.
    """
    keys = [key, idempotency]
    one = events.groupBy(*keys).agg(F.min(payload).alias(payload), (F.min(payload) != F.max(payload)).alias("_split"))
    j = one.join(log.select(*keys, F.col(payload).alias("_was"), F.col("sequence").alias("_at")), keys, "left")
    state = F.when(F.col("_split") | (F.col("_was") != F.col(payload)), "conflict").when(F.col("_was").isNotNull(), "repeat").otherwise("appended")
    last = log.groupBy(key).agg(F.max("sequence").alias("_last"))
    j = j.withColumn("state", state).join(last, key, "left")
    j = numbered(j, [key, "state"], [idempotency], "_number")
    return j.select(*keys, payload, F.when(F.col("state") == "appended", F.coalesce("_last", F.lit(0)) + F.col("_number")).when(F.col("state") == "repeat", F.col("_at")).alias("sequence"), "state")


def acquired(leases: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """resource, owner, fence, state of each request for a resource: acquired (free, expired or one's own; the fence rises) or busy; of several requests the first owner gets it.

    leases: resource, owner, fence, expires_at; requests: resource, owner.
    """
    j = requests.distinct().join(leases.select("resource", F.col("owner").alias("_owner"), F.col("fence").alias("_fence"), "expires_at"), "resource", "left")
    can = F.col("_owner").isNull() | (F.col("expires_at") <= now) | (F.col("_owner") == F.col("owner"))
    first = j.where(can).groupBy("resource").agg(F.min("owner").alias("_first"))
    j = j.withColumn("_can", can).join(first, "resource", "left")
    wins = F.coalesce(F.col("_can") & (F.col("owner") == F.col("_first")), F.lit(False))
    return j.select("resource", "owner", F.when(wins, F.coalesce("_fence", F.lit(0)) + 1).alias("fence"), F.when(wins, "acquired").otherwise("busy").alias("state"))


def revised(current: DataFrame, requests: DataFrame, states: dict[str, tuple[str, ...]]) -> DataFrame:
    """id, state, revision, outcome of requests for a new state: applied if the expected revision is the current one and the move is allowed; else stale, denied or unknown.

    current: id, state, revision; requests: id, expected_revision, to. Of several that
    could be applied the first state by name is, and the others are stale.
    """
    j = requests.join(current.select("id", F.col("state").alias("_state"), F.col("revision").alias("_revision")), "id", "left")
    moves = F.create_map(*[F.lit(x) for k, v in states.items() for x in (k, ",".join(v))])
    fresh, may = F.col("_revision") == F.col("expected_revision"), F.coalesce(F.array_contains(F.split(moves[F.col("_state")], ","), F.col("to")), F.lit(False))
    first = j.where(fresh & may).groupBy("id").agg(F.min("to").alias("_first"))
    j = j.join(first, "id", "left")
    outcome = F.when(F.col("_state").isNull(), "unknown").when(~fresh, "stale").when(~may, "denied").when(F.col("to") != F.col("_first"), "stale").otherwise("applied")
    done = outcome == "applied"
    return j.select("id", F.when(done, F.col("to")).otherwise(F.col("_state")).alias("state"), F.when(done, F.col("_revision") + 1).otherwise(F.col("_revision")).alias("revision"), outcome.alias("outcome"))
