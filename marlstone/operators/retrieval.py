"""Federated lexical retrieval: access, modes, trust, freshness, scoring, conflicts, revocation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.canonical import artifact_hash
from marlstone.functions.policy import TRUST_TIERS, may_read, rank
from marlstone.functions.temporal import is_stale
from marlstone.functions.text import has_term, nfkc, ordered, query_terms
from marlstone.operators.stage import written

# Query modes, those that see everything, and relationship types that are conflicts.
MODES = ("wiki-only", "sources-only", "trusted-only", "fresh-only", "exploratory", "audit", "refresh")
OPEN_MODES = ("exploratory", "audit", "refresh")
CONFLICT_TYPES = ("contradicting", "conflict", "unresolved")
STALE_BEHAVIORS = ("warn", "exclude", "fail")
WEIGHTS = {"title": 5, "tags": 4, "description": 3, "body": 1}
PRIORITY_UNIT, PRIORITY_MOST = 10000, 0.01
LIMITS = (1, 100)
LIFETIME_MS = (1, 300_000)


def source_like(path: Column, type_: Column) -> Column:
    """A concept that stands for a source: by its place or by its type."""
    return F.coalesce(path.startswith("references/sources/"), F.lit(False)) | F.coalesce(type_.rlike("(?i)source|evidence"), F.lit(False))


def authorized(concepts: DataFrame, principal: DataFrame) -> DataFrame:
    """Concepts that the one row of principal (clearance, compartments) may read; decided on catalog columns, before any body is used."""
    p = F.broadcast(principal.select(F.col("clearance").alias("_clearance"), F.col("compartments").alias("_held")))
    return concepts.join(p, may_read(F.col("_clearance"), F.col("_held"), F.col("classification"), F.col("compartments"))).drop("_clearance", "_held")


def granted(concepts: DataFrame, sources: DataFrame, grants: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and source citations by a policy's three levels.

    grants: level (mount, concept, source), mount_id, id (null at the level of mounts),
    mode. A concept needs its mount's and its own grant, and is not read otherwise; a
    source needs its own too, and only its citation goes if it lacks one.
    """
    g = grants.where((F.col("mode") == mode) | F.col("mode").isNull())
    mounts = g.where("level = 'mount'").select("mount_id").distinct()
    own = lambda level, key: g.where(F.col("level") == level).select("mount_id", F.col("id").alias(key)).distinct()
    c = concepts.join(mounts, "mount_id", "left_semi").join(own("concept", "concept_id"), ["mount_id", "concept_id"], "left_semi")
    s = sources.join(c.select("mount_id", "concept_id"), ["mount_id", "concept_id"], "left_semi").join(own("source", "source_id"), ["mount_id", "source_id"], "left_semi")
    return c, s


def authorization(principal: dict | None, query: str, modes: list[str], issued_ms: int, lifetime_ms: int = 60_000) -> dict:
    """A snapshot of an authorization: bound to the principal's hash, the exact query and modes, for a limited time."""
    if not modes or any(m not in MODES for m in modes):
        raise ValueError("an unsupported mode")
    if not query.strip():
        raise ValueError("a query is needed")
    if not LIFETIME_MS[0] <= lifetime_ms <= LIFETIME_MS[1]:
        raise ValueError("the lifetime is out of bounds")
    return {"principal_hash": artifact_hash(principal), "query": query, "modes": list(dict.fromkeys(modes)), "expires_ms": issued_ms + lifetime_ms}


def authorization_state(snapshots: DataFrame, now_ms: Column) -> DataFrame:
    """snapshots (principal_hash, query, modes, expires_ms, and asked_hash, asked_query, asked_mode) with state: valid, expired or mismatched."""
    bound = F.col("principal_hash").eqNullSafe(F.col("asked_hash")) & F.col("query").eqNullSafe(F.col("asked_query")) & F.coalesce(F.array_contains("modes", F.col("asked_mode")), F.lit(False))
    return snapshots.withColumn("state", F.when(F.col("expires_ms").isNull() | ~bound, "mismatched").when(F.col("expires_ms") <= now_ms, "expired").otherwise("valid"))


def in_mode(mode: str, source_like: Column, status: Column) -> Column:
    """Which concepts a query mode sees; a missing status is stable."""
    if mode in OPEN_MODES:
        return F.lit(True)
    if mode == "sources-only":
        return source_like
    return ~source_like & F.coalesce(status, F.lit("stable")).isin("stable", "deprecated")


def trusted(tier: Column, minimum: str, mode: str) -> Column:
    least = "human-reviewed" if mode == "trusted-only" and minimum == "unverified" else minimum
    return F.coalesce(rank(tier, TRUST_TIERS) >= TRUST_TIERS.index(least), F.lit(False))


def raw_score(query: Column, fields: dict[str, Column]) -> Column:
    """Sum over the query's terms of the weights of the fields that hold them; query and fields as token lists."""
    out = F.lit(0)
    for name, tokens in fields.items():
        out = out + F.lit(WEIGHTS[name]) * F.size(F.array_intersect(query, tokens))
    return out


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that later expressions read and don't evaluate again, as the optimiser would have them do for each use and each filter."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_s")).select(*df.columns, "_s.*")


def text_score(query: list[str], fields: dict[str, Column]) -> Column:
    """The same from lower-case texts, without a list of each text's tokens: a term is looked for until its first place."""
    out = F.lit(0)
    for name, low in fields.items():
        for term in query:
            out = out + F.when(has_term(low, term), WEIGHTS[name]).otherwise(0)
    return out


def normalized(candidates: DataFrame, most: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """score over the mount's largest, plus a small clamp of the mount's priority. Expects mount_id, score, priority; most has the largest by keys, if it is known."""
    keys = keys or ["mount_id"]
    most = candidates.groupBy(*keys).agg(F.max("score").alias("_most")) if most is None else most  # a row a mount (and query)
    bonus = F.least(F.greatest(F.col("priority") / PRIORITY_UNIT, F.lit(-PRIORITY_MOST)), F.lit(PRIORITY_MOST))
    return candidates.join(most, keys).withColumn("normalized", F.col("score") / F.col("_most") + bonus).drop("_most")


def mount_order(mounts: DataFrame) -> DataFrame:
    """mounts with their place: by falling priority, then by id. Mounts are few."""
    return mounts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("priority").desc(), ordered(mounts, "mount_id"))))


def ranked(candidates: DataFrame, limit: int) -> DataFrame:
    """The first limit rows (1 to 100) by score, mount and concept, with their place from 1."""
    if not LIMITS[0] <= limit <= LIMITS[1]:
        raise ValueError("the limit is out of bounds")
    order = [F.col("normalized").desc(), ordered(candidates, "mount_id"), ordered(candidates, "concept_id")]
    top = candidates.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def eligible(concepts: DataFrame, *, mode: str = "wiki-only", minimum_trust: str = "unverified", stale_behavior: str = "warn", today: str) -> DataFrame:
    """Concepts that the mode, the trust and the freshness let in, with is_stale; no text is looked at."""
    if mode not in MODES or minimum_trust not in TRUST_TIERS or stale_behavior not in STALE_BEHAVIORS:
        raise ValueError("an unsupported mode, trust tier or stale behaviour")
    c = concepts.where(in_mode(mode, F.col("source_like"), F.col("status")) & trusted(F.col("tier"), minimum_trust, mode))
    c = c.withColumn("is_stale", F.col("stale_after").isNotNull() & is_stale(F.col("stale_after"), F.lit(today)))
    return c.where(~F.col("is_stale")) if mode == "fresh-only" or stale_behavior == "exclude" else c


def hits(concepts: DataFrame, query: str, normalise: bool = True) -> DataFrame:
    """mount_id, concept_id, title, tier, score, is_stale of the eligible concepts with a term, written once: nothing after it reads a text again."""
    wanted = query_terms(query)
    form = nfkc if normalise else (lambda c: c)
    low = {"title": F.coalesce("title", F.col("concept_id").cast("string")), "tags": F.array_join("tags", " "), "description": F.col("description"), "body": F.col("body")}
    keep = ["mount_id", "concept_id", "title", "tier", "is_stale"]
    c = settled(concepts.select(*keep, *[form(v).alias(f"_{k}") for k, v in low.items()]), {f"_low_{k}": F.lower(f"_{k}") for k in low})
    c = settled(c.select(*keep, *[f"_low_{k}" for k in low]), {"score": text_score(wanted, {k: F.col(f"_low_{k}") for k in low})})
    return written(c.select("mount_id", "concept_id", "title", "tier", "score", "is_stale").where("score > 0"))


def search(concepts: DataFrame, mounts: DataFrame, query: str, *, mode: str = "wiki-only", minimum_trust: str = "unverified", stale_behavior: str = "warn", today: str = "2026-01-01", limit: int = 20, normalise: bool = True, principal: DataFrame | None = None) -> DataFrame:
    """mount_id, concept_id, title, tier, score, normalized, is_stale, place of the best concepts.

    concepts: mount_id, concept_id, title, description, tags, body, status, tier,
    stale_after, source_like (and classification, compartments for a principal); mounts:
    mount_id, priority. Access and filters come before scoring, and the texts are read in
    one pass. With stale_behavior fail a stale selection empties the answer.
    """
    c = concepts if principal is None else authorized(concepts, principal)
    found = hits(eligible(c, mode=mode, minimum_trust=minimum_trust, stale_behavior=stale_behavior, today=today), query, normalise)
    top = written(ranked(normalized(found.join(mounts, "mount_id")), limit))
    if stale_behavior == "fail" and not top.where("is_stale").isEmpty():
        return top.where("false")
    return top


@dataclass(frozen=True)
class Answer:
    """What a search gives; all frames are small, and all are empty if nothing may be shown, for whatever reason."""

    results: DataFrame
    conflicts: DataFrame
    warnings: DataFrame
    citations: DataFrame


def answer(concepts: DataFrame, mounts: DataFrame, relations: DataFrame, citations: DataFrame, revoked: DataFrame, query: str, *, principal: DataFrame | None = None, generations: tuple[int | None, int | None] = (0, 0), include_sources: bool = False, mode: str = "wiki-only", stale_behavior: str = "warn", minimum_trust: str = "unverified", today: str = "2026-01-01", limit: int = 20, normalise: bool = True) -> Answer:
    """A guarded federated search as one call: access, filters, scoring, top k, conflict expansion, revocation guard, conflicts, warnings and citations.

    relations: mount_id, concept_id, target_id, type; citations: concept_id, source_id,
    source_hash; revoked: source_id, source_hash; generations: the barrier's generation
    read before and after, which has to be even and unchanged.
    """
    c = concepts if principal is None else authorized(concepts, principal)
    c = eligible(c, mode=mode, minimum_trust=minimum_trust, stale_behavior=stale_behavior, today=today)
    found = hits(c, query, normalise)
    top = written(ranked(normalized(found.join(mounts, "mount_id")), limit))
    more = expanded(top, c.select("mount_id", "concept_id", F.lit(None).cast("double").alias("normalized")), relations)
    shown = c.select("mount_id", "concept_id", "title", "tier", "is_stale").join(F.broadcast(more), ["mount_id", "concept_id"])  # at most a row a relation of the selected ones
    shown = written(shown.select("mount_id", "concept_id", "title", "tier", "is_stale", F.round("normalized", 6).alias("score"), "place"))
    if stale_behavior == "fail" and not shown.where("is_stale").isEmpty() or not generation_stable(*generations):
        shown = shown.where("false")
    kept = written(guarded(shown, citations.join(F.broadcast(shown.select("concept_id").distinct()), "concept_id", "left_semi"), revoked))
    cited = citations.join(F.broadcast(kept.select("concept_id").distinct()), "concept_id", "left_semi")
    return Answer(
        kept, conflicts(kept, relations), kept.where("is_stale").select(F.lit("STALE").alias("code"), "mount_id", "concept_id"),
        cited if include_sources or mode == "audit" else cited.where("false"),
    )


# What an audit looks for.
GAP_TERMS, CONFLICT_TERMS = "gap missing todo", "conflict contradiction"


def gaps(concepts: DataFrame, mounts: DataFrame, relations: DataFrame, citations: DataFrame, revoked: DataFrame, **given) -> tuple[DataFrame, DataFrame]:
    """Concepts that tell of something missing, sources among them, and what these cite: an audit search; the arguments are those of answer()."""
    a = answer(concepts, mounts, relations, citations, revoked, GAP_TERMS, mode="audit", **given)
    return a.results, a.citations


def contradictions(concepts: DataFrame, mounts: DataFrame, relations: DataFrame, citations: DataFrame, revoked: DataFrame, **given) -> tuple[DataFrame, DataFrame]:
    """Conflicts between concepts that an audit finds by the words for them, and what these cite."""
    a = answer(concepts, mounts, relations, citations, revoked, CONFLICT_TERMS, mode="audit", **given)
    return a.conflicts, a.citations


def expanded(selected: DataFrame, eligible: DataFrame, relations: DataFrame) -> DataFrame:
    """selected, then the targets of its conflicts that are eligible: one hop, after the last place, each once. Both: mount_id, concept_id, normalized, place.

    selected is a written table of at most 100 rows, so that what it touches is small.
    """
    last = selected.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    own = F.broadcast(selected.select("mount_id", "concept_id", "place"))
    hop = relations.where(F.lower("type").isin(*CONFLICT_TYPES)).join(own, ["mount_id", "concept_id"]).groupBy(F.col("target_id").alias("concept_id")).agg(F.min("place").alias("via"))
    new = eligible.join(hop, "concept_id").join(F.broadcast(selected.select("mount_id", "concept_id")), ["mount_id", "concept_id"], "left_anti")
    new = new.select("mount_id", "concept_id", F.coalesce("normalized", F.lit(0.0)).alias("normalized"), "via")
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("via", "mount_id", "concept_id"))  # at most a row a relation of the few selected
    return selected.select("mount_id", "concept_id", "normalized", "place").unionByName(new.withColumn("place", (F.lit(last) + number).cast("int")).select("mount_id", "concept_id", "normalized", "place"))


def conflicts(results: DataFrame, relations: DataFrame) -> DataFrame:
    """Conflicts with both ends in the results, in both directions."""
    r = relations.where(F.lower("type").isin(*CONFLICT_TYPES)).select("concept_id", "target_id", "type")
    both = r.union(r.select(F.col("target_id").alias("concept_id"), F.col("concept_id").alias("target_id"), "type")).distinct()
    ids = results.select("concept_id").distinct()
    return both.join(ids, "concept_id", "left_semi").join(ids.withColumnRenamed("concept_id", "target_id"), "target_id", "left_semi")


def generation_stable(before: int | None, after: int | None) -> bool:
    """A barrier's generation that is known, even and unchanged: nothing was being revoked meanwhile."""
    return before is not None and before == after and before % 2 == 0


def stable_reads(reads: DataFrame) -> DataFrame:
    """reads (before, after: generations) with allowed, by the same rule."""
    return reads.withColumn("allowed", F.coalesce((F.col("before") == F.col("after")) & (F.col("before") % 2 == 0), F.lit(False)))


def guarded(results: DataFrame, citations: DataFrame, revoked: DataFrame, key: str = "concept_id") -> DataFrame:
    """Results with at least one source, all of which have an id and a hash and are not revoked (by id or hash)."""
    c = citations.join(revoked.select(F.col("source_id"), F.lit(True).alias("_by_id")).distinct(), "source_id", "left")
    c = c.join(revoked.select(F.col("source_hash"), F.lit(True).alias("_by_hash")).distinct(), "source_hash", "left")
    good = F.col("source_id").isNotNull() & F.col("source_hash").isNotNull() & F.col("_by_id").isNull() & F.col("_by_hash").isNull()
    return results.join(c.groupBy(key).agg(F.bool_and(good).alias("_ok")).where("_ok").select(key), key, "left_semi")


def fetched(concepts: DataFrame, mount_id: str, concept_id) -> DataFrame:
    """One concept whose bytes still have the catalog's hash; an absent one is an empty frame of the same schema."""
    return concepts.where((F.col("mount_id") == mount_id) & (F.col("concept_id") == concept_id) & (F.concat(F.lit("sha256:"), F.sha2(F.col("body").cast("binary"), 256)) == F.col("byte_hash")))


def fetched_by_uri(requests: DataFrame, mounts: DataFrame, concepts: DataFrame) -> DataFrame:
    """request_id, status, uri, body of each request for kb://mount[@revision]/concept: ok, or not_found alike for what is absent, at another revision, changed or not authorized.

    concepts hold what the asker may read: mount_id, concept_id (text), body, byte_hash;
    mounts: mount_id, resolved_ref.
    """
    part = lambda k: F.regexp_extract("uri", "^kb://([^/@]+)(?:@([^/]+))?/(.+)$", k)
    r = requests.select("request_id", part(1).alias("mount_id"), F.nullif(part(2), F.lit("")).alias("_at"), part(3).alias("concept_id"))
    now = F.concat(F.lit("sha256:"), F.sha2(F.col("body").cast("binary"), 256))
    j = r.join(mounts.select("mount_id", "resolved_ref"), "mount_id", "left").join(concepts.where(now == F.col("byte_hash")).select("mount_id", "concept_id", "body"), ["mount_id", "concept_id"], "left")
    ok = F.col("body").isNotNull() & (F.col("_at").isNull() | F.col("_at").eqNullSafe(F.col("resolved_ref")))
    return j.select("request_id", F.when(ok, "ok").otherwise("not_found").alias("status"), F.when(ok, F.concat(F.lit("kb://"), "mount_id", F.lit("@"), "resolved_ref", F.lit("/"), "concept_id")).alias("uri"), F.when(ok, F.col("body")).alias("body"))

