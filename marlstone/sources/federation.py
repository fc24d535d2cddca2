"""Mounts of other knowledge bases: snapshots of directories and Git trees, verified copies, and their lock."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.canonical import Invalid
from marlstone.functions.text import byte_hash, redirects_out
from marlstone.operators.relational import tree_hash
from marlstone.operators.stage import written

# What may be done through a mount, and file modes that a tree may hold.
MOUNT_MODES = ("read-only", "propose", "draft", "maintain", "publish")
BLOB_MODES = ("100644", "100755")
REF = re.compile(r"^(?!-)[^\x00-\x20\x7f]{1,1024}$")
MOUNT_NAME = r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$"


def _git(args: list[str], cwd: str) -> bytes:
    found = subprocess.run(["git", "-c", "core.hooksPath=/dev/null", *args], cwd=cwd, capture_output=True, timeout=120, check=False)
    if found.returncode:
        raise Invalid(f"git {args[0]} failed")
    return found.stdout


def git_tree(uri: str, ref: str, folder: str) -> tuple[str, list[tuple[str, str, bytes]]]:
    """(commit, [(path, mode, content)]) of a ref, by a bare shallow fetch into an empty folder: blobs only, no checkout, no hooks.

    The tree of one knowledge base is read on the driver, within a snapshot's limits;
    links, submodules and unsafe paths are errors.
    """
    if not REF.match(ref):
        raise Invalid("an unsafe ref")
    repository = str(Path(folder) / "repository.git")
    _git(["init", "-q", "--bare", repository], folder)
    _git(["fetch", "-q", "--depth=1", "--no-tags", uri, ref], repository)
    commit = _git(["rev-parse", "--verify", "--end-of-options", "FETCH_HEAD^{commit}"], repository).decode().strip()
    out = []
    for entry in filter(None, _git(["ls-tree", "-r", "-z", "--full-tree", commit], repository).split(b"\0")):
        head, _, name = entry.partition(b"\t")
        mode, kind, blob = head.decode().split()
        path = name.decode("utf-8", "strict")
        if kind != "blob" or mode not in BLOB_MODES or path.startswith("/") or "\\" in path or any(p in ("", ".", "..") for p in path.split("/")):
            raise Invalid("a link, a submodule or an unsafe path")
        out.append((path, mode, _git(["cat-file", "blob", blob], repository)))
    return commit, out


def mount_errors(mounts: DataFrame) -> DataFrame:
    """name, code of mounts (name, uri, mode, ref) that can't be resolved: an invalid name or mode, no URI, or a Git mount without a safe ref."""
    git = F.col("uri").startswith("git+")
    code = F.when(~F.coalesce(F.col("name").rlike(MOUNT_NAME), F.lit(False)), "MOUNT_INVALID").when(F.coalesce("uri", F.lit("")) == "", "MOUNT_INVALID").when(~F.coalesce(F.col("mode").isin(*MOUNT_MODES), F.lit(False)), "MOUNT_INVALID").when(git & ~F.coalesce(F.col("ref").rlike(r"^(?!-)[^\x00-\x20\x7f]{1,1024}$"), F.lit(False)), "GIT_REF_REQUIRED")
    return mounts.select("name", code.alias("code")).where("code is not null")


def copied(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """key, n_files, tree_hash, verified of a copy: written, read again and hashed again. What it was copied to is the written table."""
    before = tree_hash(files, key, path, content)
    after = tree_hash(written(files.select(key, path, content)), key, path, content).select(F.col(key).alias("_k"), F.col("tree_hash").alias("_now"))
    return before.join(after, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "n_files", "tree_hash", F.col("tree_hash").eqNullSafe(F.col("_now")).alias("verified"))


def resolved(mounts: DataFrame, trees: DataFrame, manifests: DataFrame) -> DataFrame:
    """alias, id, version, resolved_ref, manifest_hash, tree_hash, mode, priority of each mount; a base that two mounts have is an error row (code).

    mounts: name, mode, priority, commit (null for a directory, whose tree hash is its
    revision); trees: name, tree_hash; manifests: name, id, version, content.
    """
    j = mounts.join(trees.select("name", "tree_hash"), "name").join(manifests.select("name", "id", "version", byte_hash(F.col("content")).alias("manifest_hash")), "name", "left")
    twice = manifests.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("DUPLICATE_KB_ID").alias("_twice"))
    code = F.coalesce("_twice", F.when(F.col("id").isNull(), "MANIFEST_MISSING"))
    return j.join(twice, "id", "left").select(F.col("name").alias("alias"), "id", "version", F.coalesce("commit", "tree_hash").alias("resolved_ref"), "manifest_hash", "tree_hash", "mode", F.coalesce("priority", F.lit(0)).alias("priority"), code.alias("code"))


def lock_drift(lock: DataFrame, now: DataFrame) -> DataFrame:
    """alias, code of mounts whose lock entry is missing, isn't resolved any more, or binds another revision, manifest or tree."""
    names = ("id", "resolved_ref", "manifest_hash", "tree_hash")
    side = lambda df, name: df.select("alias", F.struct(*names).alias(name))
    j = side(lock, "_a").join(side(now, "_b"), "alias", "full_outer")
    code = F.when(F.col("_a").isNull(), "LOCK_MISSING").when(F.col("_b").isNull(), "MOUNT_MISSING").when(F.col("_a") != F.col("_b"), "LOCK_DRIFT")
    return j.select("alias", code.alias("code")).where("code is not null")


def portable_path(c: Column) -> Column:
    """Whether a path stays in its root and has no hidden, empty or climbing part."""
    return ~redirects_out(c) & ~c.rlike(r"(^|/)\.") & (c != "")
