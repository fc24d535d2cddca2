"""Closures over edges, alias chains, the order of stages, directory trees and their indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import directory_title, links, markdown_text, redirects_out, utf16
from marlstone.operators.components import strongly_connected
from marlstone.operators.json_tree import references
from marlstone.operators.spans import numbered
from marlstone.operators.stage import written

MOST_HOPS = 16


def closure(seeds: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """node, depth: all nodes that depend on a seed, directly or not. edges: node, depends_on. Each edge is followed once."""
    e = edges.where("depends_on is not null").select("node", "depends_on").distinct()
    seen = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, most):
        new = e.join(front.select(F.col("node").alias("depends_on")), "depends_on", "left_semi").select("node").distinct().join(seen.select("node"), "node", "left_anti")
        front = written(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    raise RuntimeError(f"the closure is deeper than {most}")


def resolved_aliases(aliases: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """from_id, to_id, hops, state (resolved, cycle, limit): each alias followed to its end, at most so many hops."""
    step = aliases.select(F.col("from_id").alias("_from"), F.col("to_id").alias("_to")).hint("merge")  # else each task holds it whole, a hop
    now = aliases.select("from_id", "to_id", F.lit(1).alias("hops"), F.array("from_id").alias("seen"))
    now = now.withColumn("state", F.when(F.col("to_id") == F.col("from_id"), "cycle"))
    for hop in range(2, most + 2):
        j = now.join(step, (F.col("to_id") == F.col("_from")) & F.col("state").isNull(), "left")
        seen = F.concat("seen", F.array("to_id"))
        moved = F.col("_to").isNotNull()
        state = F.when(F.col("state").isNotNull(), F.col("state")).when(~moved, "resolved").when(F.array_contains(seen, F.col("_to")), "cycle").when(F.lit(hop > most), "limit")
        now = j.select("from_id", F.when(moved, F.col("_to")).otherwise(F.col("to_id")).alias("to_id"), F.when(moved, F.lit(hop)).otherwise(F.col("hops")).alias("hops"), F.when(moved, seen).otherwise(F.col("seen")).alias("seen"), state.alias("state"))
    return now.select("from_id", "to_id", "hops", "state")


def provenance_inventory(files: DataFrame) -> DataFrame:
    """path, kind (id, hash), value: every reference to a source in governed JSON files (path, content), at any depth; a file that isn't JSON is told with kind unreadable."""
    bad = files.where(F.try_parse_json("content").isNull()).select("path", F.lit("unreadable").alias("kind"), F.lit(None).cast("string").alias("value"))
    return references(files, ["path"], F.col("content")).select("path", "kind", "value").distinct().union(bad)


def impact_seeds(surfaces: DataFrame, source: DataFrame) -> DataFrame:
    """node: surfaces that hold a source by its id or by its hash (source: source_id, source_hash); two equi-joins, each surface once."""
    by = lambda lists, key: surfaces.select(F.col("surface_id").alias("node"), F.explode(lists).alias(key)).join(source.select(key).distinct(), key, "left_semi").select("node")
    return by("source_ids", "source_id").union(by("source_hashes", "source_hash")).distinct()


def stage_levels(stages: DataFrame, most: int = 1000) -> DataFrame:
    """stage, level: the longest way down to a stage that needs none; stages: stage, needs (a row an edge, null for none). An edge in a cycle, or to a stage that isn't there, is an error."""
    every = written(stages.select("stage").distinct())
    edges = written(stages.where("needs is not null").select("stage", "needs").distinct())
    done = written(every.join(edges.select("stage"), "stage", "left_anti").withColumn("level", F.lit(0)))
    total, before = every.count(), 0
    for level in range(1, most):
        if (now := done.count()) == total:
            return done
        if now == before:
            break
        before = now
        open_ = edges.join(done.select("stage"), "stage", "left_anti")
        blocked = open_.join(done.select(F.col("stage").alias("needs")), "needs", "left_anti").select("stage")
        ready = open_.select("stage").distinct().join(blocked, "stage", "left_anti")
        done = done.union(written(ready.withColumn("level", F.lit(level))))
    raise ValueError("the stages have a cycle, or need one that is missing")


def cyclic(edges: DataFrame) -> DataFrame:
    """node of every cycle, of any length. edges: node, depends_on."""
    return strongly_connected(edges).select("node")


def traversed(files: DataFrame, most_indexes: int = 10_000, most_concepts: int = 100_000) -> DataFrame:
    """path, depth, state of what the index tree reaches from index.md, breadth first: concept, index, or what is wrong with a link (unsafe, broken).

    files: path, content (text; only that of index files is used). A link to a directory
    leads to its index.md. Over a limit it is an error, not a cut.
    """
    base = F.when(F.col("path").contains("/"), F.regexp_replace("path", "[^/]*$", "")).otherwise("")
    raw = files.where(F.col("path").rlike("(^|/)index[.]md$")).select("path", base.alias("base"), F.explode(links(F.col("content"))).alias("link"))
    to = F.regexp_replace(F.when(F.col("link").startswith("/"), F.substring("link", 2, 1 << 20)).otherwise(F.concat("base", F.regexp_replace("link", r"^(\./)+", ""))), "/$", "")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.struct(F.array_join(F.slice(F.split("path", "/"), 1, n), "/").alias("to"), (n < F.size(F.split("path", "/"))).alias("folder")))).alias("x")).select("x.*").distinct()
    edges = raw.select("path", to.alias("to")).distinct().join(folders, "to", "left")
    kind = F.when(redirects_out(F.col("to")), "unsafe").when(F.col("folder"), "index").when(F.col("folder").isNull() | ~F.col("to").endswith(".md") | F.col("to").rlike("(^|/)index[.]md$"), "broken").otherwise("concept")
    edges = written(edges.select("path", F.when(kind == "index", F.concat("to", F.lit("/index.md"))).otherwise(F.col("to")).alias("to"), kind.alias("state")))
    have = files.where(F.col("path").rlike("(^|/)index[.]md$")).select(F.col("path").alias("to"), F.lit(True).alias("there"))
    seen = written(files.where("path = 'index.md'").select("path", F.lit(0).alias("depth"), F.lit("index").alias("state")))
    if seen.isEmpty():
        raise ValueError("there is no index.md")
    front, depth = seen, 0
    while not front.isEmpty():
        depth += 1
        step = edges.join(front.where("state = 'index'").select("path"), "path", "left_semi").join(have, "to", "left")
        step = step.select(F.col("to").alias("path"), F.lit(depth).alias("depth"), F.when((F.col("state") == "index") & F.col("there").isNull(), "broken").otherwise(F.col("state")).alias("state")).distinct()
        front = written(step.join(seen.select("path", "state"), ["path", "state"], "left_anti").select("path", "depth", "state"))
        seen = written(seen.union(front))
        sizes = {r.state: r.n for r in seen.groupBy("state").agg(F.count("*").alias("n")).collect()}
        if sizes.get("index", 0) > most_indexes or sizes.get("concept", 0) > most_concepts:
            raise ValueError("the index tree is over its limits")
    return seen


def stage_order(stages: DataFrame, needs: DataFrame, most: int = 1000) -> DataFrame:
    """stage, place: every stage after all that it needs, from 1, as a walk in declaration order that first goes down to what a stage needs, in the stage's own order, would leave them.

    stages: stage, declared (numbers, none twice); needs: stage, place, needs (numbers; of a
    need told twice the first counts). Without cycles that walk reaches a stage by the least
    of all ways to it, compared place by place, and the ways to a stage are settled once
    those to all its dependents are: a level of dependents a round, at most so many. Sorted
    by their ways with an end after every place, stages stand behind all below them. A cycle,
    an unknown need, or a declaration that stands twice is an error.
    """
    every = written(stages.select("stage", F.col("declared").cast("long").alias("declared")))
    n = every.agg(F.count("*").alias("rows"), F.count_distinct("stage").alias("stages"), F.count_distinct("declared").alias("places")).first()
    if not n.rows == n.stages == n.places:
        raise ValueError("a stage or its place is missing or stands twice")
    edges = written(needs.where("needs is not null").groupBy("stage", "needs").agg(F.min("place").cast("long").alias("place")))
    ends = edges.select("stage").union(edges.select("needs"))
    if not ends.join(every, "stage", "left_anti").isEmpty():
        raise ValueError("a stage needs one that is missing")
    turned = every.select("stage", F.lit(None).cast(edges.schema["stage"].dataType).alias("needs")).union(edges.select(F.col("needs").alias("stage"), F.col("stage").alias("needs")))
    levels = written(every.join(stage_levels(turned, most), "stage"))
    into = written(edges.join(levels.select(F.col("stage").alias("needs"), "level"), "needs"))
    own = lambda level: levels.where(F.col("level") == level).select("stage", F.array("declared").alias("way"))
    placed = written(own(0))
    for level in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        ways = into.where(F.col("level") == level).join(placed, "stage").select(F.col("needs").alias("stage"), F.concat("way", F.array("place")).alias("way"))
        placed = placed.union(written(ways.union(own(level)).groupBy("stage").agg(F.min("way").alias("way"))))
    after = placed.select("stage", F.concat("way", F.array(F.lit((1 << 63) - 1))).alias("way"))
    return numbered(after, [], ["way"], "place").select("stage", "place")


def ancestors(paths: DataFrame, path: str) -> DataFrame:
    """(directory, child) of every directory above every path; '' is the root."""
    parts = F.split(F.col(path), "/")
    rows = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n - 1), "/").alias("directory"), F.element_at(parts, n).alias("child"), (n == F.size(parts)).alias("leaf")))).alias("x"))
    return rows.select("x.*")


def directory_indexes(concepts: DataFrame, normalise: bool = True) -> DataFrame:
    """directory, n_rows, index_text: the index of each directory, its concepts and child directories by lower-case title and path.

    concepts: path, title, description. A directory's rows are gathered, as the file that they become.
    """
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    title = markdown_text(F.when(F.coalesce("title", F.lit("")) == "", name).otherwise(F.col("title")), normalise)
    own = concepts.select(directory.alias("directory"), title.alias("title"), F.element_at(F.split("path", "/"), -1).alias("path"), markdown_text(F.coalesce("description", F.lit("")), normalise).alias("description"))
    folders = ancestors(concepts, "path").where("not leaf").select("directory", "child").distinct()
    rows = own.union(folders.select("directory", directory_title(F.col("child")), F.concat("child", F.lit("/")), F.lit("")))
    line = F.concat(F.lit("* ["), F.col("title"), F.lit("]("), F.col("path"), F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(" - "), F.col("description"))).otherwise(""))
    g = rows.groupBy("directory").agg(F.array_sort(F.collect_list(F.struct(utf16(F.lower("title")).alias("k"), utf16(F.col("path")).alias("p"), line.alias("line")))).alias("rows"))
    head = F.concat(F.lit("<!-- generated; do not edit -->\n# "), directory_title(F.col("directory")), F.lit("\n\n"))
    return g.select("directory", F.size("rows").alias("n_rows"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("index_text"))
