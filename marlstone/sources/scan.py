"""Scans of files and snapshots, the skip ledger, receipts and remote connectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.canonical import parse_concept
from marlstone.functions.temporal import is_instant
from marlstone.functions.text import byte_hash, is_byte_hash, redirects_out, secret_looking
from marlstone.operators import merkle
from marlstone.operators.stage import written

# Directories that a scan skips, providers with their kinds of revision, and the other closed sets.
SKIPPED = ("node_modules", "knowledge", "workflow", "mounts")
REVISION_KINDS = {"onedrive": ("etag", "ctag"), "sharepoint": ("etag", "ctag"), "confluence": ("version",), "google-drive": ("version", "md5")}
VISIBILITIES = ("public", "internal", "restricted", "unknown")
SNAPSHOT_LIMITS = {"files": 100_000, "bytes": 1 << 30, "file_bytes": 64 << 20, "depth": 128}


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """path (from the root), content, length of every file below root, without dot files and skipped directories."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = re.escape(re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/"))
    path = F.regexp_replace("path", rf"^.*?{inner}/", "")
    f = f.select(path.alias("path"), "content", "length")
    return f.where(walkable(F.col("path"), extensions))


def walkable(path: Column, extensions: tuple[str, ...] = ()) -> Column:
    """Whether a scan takes a relative path: it stays in its root, nothing of it is hidden or skipped, and its extension is wanted."""
    ok = ~redirects_out(path) & ~path.rlike(r"(^|/)\.") & ~path.rlike(rf"(^|/)({'|'.join(SKIPPED)})/")
    return ok & F.lower(path).rlike(rf"({'|'.join(e.replace('.', '[.]') for e in extensions)})$") if extensions else ok


def ingested(found: DataFrame, ledger: DataFrame | None = None, force: bool = False) -> DataFrame:
    """source_id, filename, content, content_hash of files whose bytes the ledger doesn't have yet."""
    f = found.select(F.col("path").alias("filename"), "content", byte_hash(F.col("content")).alias("content_hash"))
    f = f.withColumn("source_id", F.concat(F.lit("src_"), F.substring(F.sha2(F.col("filename").cast("binary"), 256), 1, 16)))
    return f if force or ledger is None else f.join(ledger.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")


def concepts(found: DataFrame) -> DataFrame:
    """Markdown files with their frontmatter (canonical JSON), body, three digests and error."""
    return found.where(F.col("path").endswith(".md")).select("path", parse_concept(F.col("content")).alias("c")).select("path", "c.*")


def snapshot(found: DataFrame, limits: Mapping[str, int] | None = SNAPSHOT_LIMITS) -> DataFrame:
    """n_files, n_bytes, tree_hash of a tree: the root of a digest tree over path and hash of each file; beyond a limit (None: there is none) it is an error, not a cut."""
    f = found.select("path", "content", "length")
    depth = F.size(F.split("path", "/"))
    t = f.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.max("length").alias("most"), F.max(depth).alias("depth"))
    if limits is not None:
        over = (F.col("n_files") > limits["files"]) | (F.col("n_bytes") > limits["bytes"]) | (F.col("most") > limits["file_bytes"]) | (F.col("depth") > limits["depth"])
        t = written(t.withColumn("n_files", F.when(over, F.raise_error(F.lit("the snapshot is over its limits")).cast("long")).otherwise(F.col("n_files"))))
    root = merkle.root(merkle.tree(merkle.lines(f, F.col("path"), F.col("content"))))
    return t.select("n_files", "n_bytes").crossJoin(F.broadcast(root))  # a row each


def catalog_errors(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """id, code: entries whose path is unsafe, whose id isn't the path, that stand twice, or whose file is missing or has other bytes."""
    j = catalog.join(found.select("path", byte_hash(F.col("content")).alias("now")), "path", "left")
    twice = catalog.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit(True).alias("twice"))
    j = j.join(twice, "path", "left")
    code = F.when(redirects_out(F.col("path")), "CATALOG_PATH_UNSAFE").when(F.col("id") != F.regexp_replace("path", r"\.md$", ""), "CATALOG_ID_MISMATCH").when(F.col("twice"), "CATALOG_DUPLICATE").when(F.col("now").isNull(), "CATALOG_FILE_MISSING").when(F.col("now") != F.col("byte_hash"), "CATALOG_HASH_MISMATCH")
    return j.select("id", code.alias("code")).where("code is not null")


def descriptor_failures(d: Column) -> Column:
    """Failures of a remote descriptor: struct<provider, remote_id, revision_kind, revision_value, acquired_via, acquired_at, content_hash, visibility>."""
    kinds = F.create_map(*[F.lit(x) for k, v in REVISION_KINDS.items() for x in (k, ",".join(v))])
    known = F.coalesce(d["provider"].isin(*REVISION_KINDS), F.lit(False))
    return F.array_compact(F.array(
        F.when(~known, "provider"), F.when(~F.coalesce(F.length(d["remote_id"]).between(1, 2048), F.lit(False)), "remote_id"),
        F.when(F.coalesce(d["revision_value"], F.lit("")) == "", "revision").when(known & ~F.coalesce(F.array_contains(F.split(kinds[d["provider"]], ","), d["revision_kind"]), F.lit(False)), "revision.kind"),
        F.when(~F.coalesce(d["acquired_via"].isin("api", "export", "mcp"), F.lit(False)), "acquired_via"), F.when(~is_instant(d["acquired_at"]), "acquired_at"), F.when(~is_byte_hash(d["content_hash"]), "content_hash"),
        F.when(~F.coalesce(d["visibility"].isin(*VISIBILITIES), F.lit(False)), "access_context.visibility"),
    ))


def bound_receipts(descriptors: DataFrame, content: DataFrame) -> DataFrame:
    """Receipts of descriptors whose declared hash is that of the bytes, with byte_length."""
    c = content.select("source_id", byte_hash(F.col("content")).alias("now"), F.octet_length("content").alias("byte_length"))
    return descriptors.join(c, "source_id").where(F.col("now") == F.col("content_hash")).drop("now")


def readiness(env_names: Mapping[str, tuple[str, ...]], env: Mapping[str, str]) -> dict[str, dict[str, Any]]:
    """By connector, whether every variable that it names is set; values are never kept."""
    return {k: {"ready": all(env.get(n) for n in names), "missing": sum(not env.get(n) for n in names)} for k, names in env_names.items()}


def config_secrets(values: DataFrame) -> DataFrame:
    """Entries (name, value) whose value looks like a credential and not a variable's name."""
    return values.where(secret_looking(F.col("value"))).select("name")


class SourceError(Exception):
    """What a remote answered instead of content; no body is kept."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


# Error codes by HTTP status.
STATUS_CODES = {401: "access-denied", 403: "access-denied", 404: "not-found", 429: "rate-limited"}
DRIVE_EXPORTS = {"application/vnd.google-apps.document": ".docx", "application/vnd.google-apps.spreadsheet": ".xlsx", "application/vnd.google-apps.presentation": ".pptx", "application/vnd.google-apps.drawing": ".pdf"}
Transport = Callable[[str], tuple[int, Any]]


def expected(transport: Transport, url: str) -> Any:
    status, body = transport(url)
    if status != 200:
        raise SourceError(STATUS_CODES.get(status, "unavailable"))
    return body


def drive_item(transport: Transport, base: str, item: str) -> dict:
    """A file of a document library: content, and an etag or ctag as revision."""
    meta = expected(transport, f"{base}/items/{item}")
    kind = "etag" if meta.get("eTag") else "ctag"
    shared = (meta.get("shared") or {}).get("scope")
    return {"remote_id": meta["id"], "revision_kind": kind, "revision_value": meta.get("eTag") or meta.get("cTag"), "visibility": "public" if shared == "anonymous" else "internal" if shared else "unknown", "filename": meta.get("name"), "content": expected(transport, f"{base}/items/{item}/content")}


def site_page(transport: Transport, base: str, page: str) -> dict:
    """A site page: the HTML of its web parts in order."""
    meta = expected(transport, f"{base}/pages/{page}?parts=1")
    body = "".join(p.get("innerHtml", "") for p in meta.get("webParts", []))
    return {"remote_id": meta["id"], "revision_kind": "etag", "revision_value": meta.get("eTag"), "visibility": "internal", "filename": f"{meta['id']}.html", "content": f"<html><head><title>{meta.get('title', '')}</title></head><body>{body}</body></html>".encode()}


def wiki_page(transport: Transport, base: str, page: str) -> dict:
    """A wiki page's storage form as HTML, its version number as revision."""
    meta = expected(transport, f"{base}/pages/{page}?body-format=storage")
    return {"remote_id": str(meta["id"]), "revision_kind": "version", "revision_value": str(meta["version"]["number"]), "visibility": "internal", "filename": f"{meta['id']}.html", "content": f"<html><head><title>{meta['title']}</title></head><body>{meta['body']['storage']['value']}</body></html>".encode()}


def drive_file(transport: Transport, base: str, file: str) -> dict:
    """A file of a drive; native documents are exported, with a note that this loses some fidelity."""
    meta = expected(transport, f"{base}/files/{file}")
    extension = DRIVE_EXPORTS.get(meta["mimeType"], "")
    kind = "md5" if meta.get("md5Checksum") else "version"
    return {"remote_id": meta["id"], "revision_kind": kind, "revision_value": meta.get("md5Checksum") or str(meta.get("version")), "visibility": "unknown", "filename": meta["name"] + extension, "fidelity": "exported" if extension else "original", "content": expected(transport, f"{base}/files/{file}/{'export' if extension else 'content'}")}


def acquired(spark: SparkSession, requests: list[tuple[str, Callable[[], dict]]]) -> DataFrame:
    """One row a request (source_id, fetch): its content or its error code. A remote is read on the driver, item by item, as the reader's own credentials allow."""
    rows = []
    for source_id, fetch in requests:
        try:
            r = fetch()
            rows.append((source_id, r["remote_id"], r["revision_kind"], r["revision_value"], r["visibility"], r["filename"], bytes(r["content"]), None))
        except SourceError as e:
            rows.append((source_id, None, None, None, None, None, None, e.code))
    return spark.createDataFrame(rows, "source_id string, remote_id string, revision_kind string, revision_value string, visibility string, filename string, content binary, error string")


def access_context(scope: Column) -> Column:
    """What a library's sharing scope makes visible: to anyone, within the organisation, to those invited; nothing known without one."""
    return F.when(scope == "anonymous", "public").when(scope == "organization", "internal").when(scope == "users", "restricted").otherwise("unknown")


def readiness_rows(needs: DataFrame, env: DataFrame) -> DataFrame:
    """connector, missing, ready: by connector, how many of the variables that it names (connector, name) aren't set (env: name of those that are)."""
    j = needs.join(env.select("name", F.lit(True).alias("_set")).distinct(), "name", "left")
    return j.groupBy("connector").agg(F.count_if(F.col("_set").isNull()).alias("missing")).withColumn("ready", F.col("missing") == 0)


def ingest(spark: SparkSession, root: str, ledger: DataFrame | None, extensions: tuple[str, ...] = (), force: bool = False, descriptors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of an ingestion: (units, receipts, the ledger after it). New and changed files are normalised; receipts bind remote descriptors (source_id, content_hash, ...) to the bytes that came; a quarantined file isn't in the ledger, so that it is tried again.

    With remote descriptors the ledger is never used to skip.
    """
    from marlstone.sources.normalizers import normalize

    new = ingested(files(spark, root, extensions), ledger, force or descriptors is not None)
    units = written(normalize(new))
    receipts = bound_receipts(descriptors, new) if descriptors is not None else new.select("source_id", "content_hash", F.octet_length("content").alias("byte_length"))
    done = units.where("code is null").select("source_id", F.col("source_hash").alias("content_hash")).distinct()
    after = done if ledger is None else ledger.select("source_id", "content_hash").join(done.select("source_id"), "source_id", "left_anti").unionByName(done)
    return units, receipts, after


def sidecar_claims(files_: DataFrame, schema: str) -> DataFrame:
    """path, line, claim, code: the claims of JSON-lines sidecars (path, content as text), blank lines left out; a line that isn't an object of the schema is a row with CLAIM_SIDECAR_INVALID."""
    rows = files_.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line", "json")).where(F.trim("json") != "")
    claim = F.from_json("json", schema, {"mode": "PERMISSIVE"})
    valid = F.coalesce(F.schema_of_variant(F.try_parse_json("json")).startswith("OBJECT"), F.lit(False))
    return rows.select("path", F.col("line").cast("long").alias("line"), F.when(valid, claim).alias("claim"), F.when(~valid, "CLAIM_SIDECAR_INVALID").alias("code"))
