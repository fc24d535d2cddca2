"""Core lint sensors over a workspace: each takes frames and gives subject and code of its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.temporal import is_stale
from marlstone.functions.text import byte_hash, citations, links
from marlstone.operators.components import endless
from marlstone.operators.graph import directory_indexes


def _found(df: DataFrame, subject: str, code: str) -> DataFrame:
    return df.select(F.col(subject).cast("string").alias("subject"), F.lit(code).alias("code"))


def conformance(concepts: DataFrame) -> DataFrame:
    """A frontmatter that doesn't parse (type null) or has an empty type."""
    return _found(concepts.where(F.coalesce("type", F.lit("")) == ""), "path", "CONCEPT_NONCONFORMANT")


def profile(concepts: DataFrame) -> DataFrame:
    need = F.lit(False)
    for c in ("type", "title", "description", "status"):
        need = need | (F.coalesce(c, F.lit("")) == "")
    return _found(concepts.where(need), "path", "PROFILE_FIELD_MISSING")


def source_resolvability(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Local resources without a file; https, kb and urn pass."""
    local = sources.where(~F.col("resource").rlike("^(https|kb|urn):"))
    return _found(local.join(files.select(F.col("path").alias("resource")), "resource", "left_anti"), "path", "SOURCE_UNRESOLVED")


def ungrounded(concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """Footnotes without a source entry of that id."""
    cited = concepts.select("path", F.explode(citations(F.col("body"))).alias("id"))
    return _found(cited.join(sources.select("path", "id"), ["path", "id"], "left_anti").select("path").distinct(), "path", "CITATION_UNGROUNDED")


def sidecars(concepts: DataFrame, files: DataFrame) -> DataFrame:
    """Claim sidecars that are missing or whose bytes have another hash than the concept binds."""
    c = concepts.where("sidecar_path is not null").select("path", "sidecar_path", "sidecar_hash")
    j = c.join(files.select(F.col("path").alias("sidecar_path"), byte_hash(F.col("content")).alias("now")), "sidecar_path", "left")
    return _found(j.where(~F.col("now").eqNullSafe(F.col("sidecar_hash"))), "path", "CLAIM_SIDECAR_DRIFT")


def broken_links(concepts: DataFrame, files: DataFrame) -> DataFrame:
    """Relative links (from the concept's directory) without a file."""
    base = F.when(F.col("path").contains("/"), F.regexp_replace("path", "[^/]*$", "")).otherwise("")
    target = concepts.select("path", base.alias("base"), F.explode(links(F.col("body"))).alias("link"))
    target = target.select("path", F.when(F.col("link").startswith("/"), F.substring("link", 2, 1 << 20)).otherwise(F.concat("base", "link")).alias("to"))
    return _found(target.join(files.select(F.col("path").alias("to")), "to", "left_anti").select("path").distinct(), "path", "LINK_BROKEN")


def alias_cycles(aliases: DataFrame) -> DataFrame:
    """Aliases that are on a cycle, of any length, or lead into one: neither resolves."""
    return _found(endless(aliases), "from_id", "ALIAS_CYCLE")


def duplicate_concepts(concepts: DataFrame) -> DataFrame:
    """Concepts that share a title but for case and blanks."""
    key = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    c = concepts.select("path", key.alias("k")).where("k <> ''")
    return _found(c.join(c.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "k", "left_semi"), "path", "DUPLICATE_CANDIDATE")


def unknown_relationships(relations: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return _found(relations.where(~F.coalesce(F.col("type").isin(*allowed), F.lit(False))), "concept_id", "RELATIONSHIP_UNKNOWN")


def indexes(concepts: DataFrame, files: DataFrame) -> DataFrame:
    """Directories without an index, and indexes that aren't what would be generated."""
    path = F.when(F.col("directory") == "", "index.md").otherwise(F.concat("directory", F.lit("/index.md")))
    want = directory_indexes(concepts).select(path.alias("path"), "index_text")
    j = want.join(files.select("path", "content"), "path", "left")
    code = F.when(F.col("content").isNull(), "INDEX_MISSING").when(F.col("content") != F.col("index_text"), "INDEX_DRIFT")
    return j.select(F.col("path").alias("subject"), code.alias("code")).where("code is not null")


def review_binding(concepts: DataFrame, receipts: DataFrame) -> DataFrame:
    j = concepts.join(receipts.select("path", F.col("review_hash").alias("bound")), "path")
    return _found(j.where("review_hash <> bound"), "path", "MODIFIED_AFTER_REVIEW")


def lifecycle(concepts: DataFrame) -> DataFrame:
    return _found(concepts.where("status = 'stable' and tombstone"), "path", "LIFECYCLE_INVALID")


def lock_drift(mounts: DataFrame, lock: DataFrame) -> DataFrame:
    """Mounts without a lock entry: a warning for local ones, an error for remote ones."""
    missing = mounts.join(lock.select("mount_id"), "mount_id", "left_anti")
    return missing.select(F.col("mount_id").cast("string").alias("subject"), F.lit("LOCK_MISSING").alias("code"), F.when(F.col("remote"), "error").otherwise("warning").alias("severity"))


def workflow_integrity(leases: DataFrame, jobs: DataFrame, now) -> DataFrame:
    stale = _found(leases.where(F.col("expires_at") <= now), "resource", "LOCK_STALE")
    return stale.union(_found(jobs.where(F.try_parse_json("record").isNull()), "job_id", "JOB_RECORD_INVALID"))


def stale_verification(concepts: DataFrame, today: str) -> DataFrame:
    old = _found(concepts.where(F.col("stale_after").isNotNull() & is_stale(F.col("stale_after"), F.lit(today))), "path", "CONCEPT_STALE")
    return old.union(_found(concepts.where("status = 'stable' and tier = 'unverified'"), "path", "VERIFICATION_MISSING"))
