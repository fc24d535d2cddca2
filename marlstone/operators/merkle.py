"""Digest trees over tables of files: one root, proofs that a file is in it, and changes that rehash a path.

A file's line is its path, a zero byte and the digest of its bytes. Lines are dealt to
buckets by the first DIGITS hexadecimal digits of the path's hash, whatever the paths look
like, so that no task gathers a directory or the whole table. A bucket's digest is that of
its lines, a node's that of its children's "prefix:digest", at most 16, and the root has
the empty prefix. Lists are joined by a line feed, in the order of their UTF-16 units. A table without
files has the digest of no bytes; rows that repeat count as often as they stand there; a
null content is told from an empty one by a line without a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import byte_hash, utf16_sorted
from marlstone.operators.stage import written

DIGITS = 6  # fixed: part of the digest's form; 16,777,216 buckets


def _key(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, DIGITS)


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def lines(files: DataFrame, path: Column, content: Column) -> DataFrame:
    """path, prefix, line of each file; only digests go on from here."""
    f = files.select(path.alias("path"), content.alias("_c"))
    return f.select("path", _key(F.col("path")).alias("prefix"), F.concat("path", F.lit("\0"), F.coalesce(byte_hash(F.col("_c")), F.lit(""))).alias("line"))


def _buckets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prefix").agg(_digest(_joined(utf16_sorted(F.collect_list("line")))).alias("digest"))


def _parents(children: DataFrame, level: int) -> DataFrame:
    """prefix, digest of the nodes of a level over all their children."""
    line = F.concat("prefix", F.lit(":"), "digest")
    return children.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(_digest(_joined(F.array_sort(F.collect_list(line)))).alias("digest"))


def _at(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.where(F.col("level") == level).select("prefix", "digest")


def tree(rows: DataFrame) -> DataFrame:
    """level (DIGITS for buckets, 0 for the root), prefix, digest of every node over lines(). Each level is written, so that none is made twice."""
    now = written(_buckets(rows))
    nodes = now.select(F.lit(DIGITS).alias("level"), "prefix", "digest")
    for level in range(DIGITS - 1, -1, -1):
        now = written(_parents(now, level))
        nodes = nodes.union(now.select(F.lit(level), "prefix", "digest"))
    return nodes


def root(nodes: DataFrame) -> DataFrame:
    """tree_hash, one row, for a table without files too."""
    return _at(nodes, 0).agg(F.concat(F.lit("sha256:"), F.coalesce(F.max("digest"), _digest(F.lit("")))).alias("tree_hash"))


def updated(nodes: DataFrame, rows: DataFrame, changed: DataFrame) -> DataFrame:
    """The nodes after changes: rows are the lines() now, changed the paths that were added, edited or removed. Only their buckets and what stands above these is hashed anew."""
    touched = written(changed.select(_key(F.col("path")).alias("prefix")).distinct())
    now = written(_buckets(rows.join(touched, "prefix", "left_semi")))
    out = _at(nodes, DIGITS).join(touched, "prefix", "left_anti").union(now).select(F.lit(DIGITS).alias("level"), "prefix", "digest")
    for level in range(DIGITS - 1, -1, -1):
        above = touched.select(F.substring("prefix", 1, level).alias("prefix")).distinct()
        beside = _at(nodes, level + 1).join(touched, "prefix", "left_anti").join(above.select(F.col("prefix").alias("_p")), F.substring("prefix", 1, level) == F.col("_p"), "left_semi")
        now, touched = written(_parents(beside.union(now), level)), above
        out = out.union(_at(nodes, level).join(above, "prefix", "left_anti").union(now).select(F.lit(level), "prefix", "digest"))
    return out


def proofs(nodes: DataFrame, rows: DataFrame, paths: DataFrame) -> DataFrame:
    """path, line, bucket (all its lines), way (the children's lines of each node above, from the lowest): what shows without the other files that a path's line is under the root. A path that isn't in the table has no row."""
    asked = written(rows.join(paths.select("path").distinct(), "path", "left_semi"))
    keys = asked.select("prefix").distinct()
    bucket = rows.join(keys, "prefix", "left_semi").groupBy("prefix").agg(utf16_sorted(F.collect_list("line")).alias("bucket"))
    steps = keys.select("prefix", F.explode(F.sequence(F.lit(0), F.lit(DIGITS - 1))).alias("at")).withColumn("above", F.substring(F.col("prefix"), F.lit(1), F.col("at")))
    need = steps.select(F.col("at").alias("_at"), F.col("above").alias("_above")).distinct()
    up = nodes.where("level > 0").withColumn("above", F.expr("substring(prefix, 1, level - 1)"))
    up = up.join(need, (F.col("level") - 1 == F.col("_at")) & (F.col("above") == F.col("_above"))).groupBy("_at", "_above").agg(F.array_sort(F.collect_list(F.concat("prefix", F.lit(":"), "digest"))).alias("lines"))
    way = steps.join(up, (F.col("at") == F.col("_at")) & (F.col("above") == F.col("_above"))).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("k"), F.col("lines")))).alias("way"))
    found = asked.join(bucket, "prefix").join(way, "prefix")
    return found.select("path", "line", "bucket", F.transform("way", lambda x: x["lines"]).alias("way"))


def proven_root(path: Column, line: Column, bucket: Column, way: Column) -> Column:
    """The root that a proof leads to; null if a step doesn't hold what the step below gives."""
    start = F.when(F.array_contains(bucket, line) & line.startswith(F.concat(path, F.lit("\0"))), _digest(_joined(bucket)))
    key = _key(path)

    def step(digest: Column, x: Column) -> Column:
        child = F.concat(F.substring(key, F.lit(1), F.lit(DIGITS) - x["i"]), F.lit(":"), digest)
        return F.when(F.array_contains(x["l"], child), _digest(_joined(x["l"])))

    steps = F.transform(way, lambda l, i: F.struct(i.alias("i"), l.alias("l")))
    return F.when(F.size(way) == DIGITS, F.concat(F.lit("sha256:"), F.aggregate(steps, start, step)))
