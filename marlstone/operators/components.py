"""Cycles of any length: pointer doubling along chains and rings, colouring of what branches.

Tables of nodes compress to a few bytes a row, so that Spark takes large ones for small and
would send them to the driver and from there to all tasks: their joins are told to shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.stage import written


def jumped(succ: DataFrame, rows: int) -> DataFrame:
    """node, last, least, ended after at least `rows` steps along succ (node, to; a node once).

    Where a chain leaves the nodes of succ, last is its last node and ended is true;
    nodes of a ring, or that lead into one, never end, and least is the smallest node they
    meet. The steps double each time, so that there are log2(rows) of them, two in a job,
    with a row a node.
    """
    inner = succ.select(F.col("node").alias("to"), F.lit(True).alias("_inner")).hint("merge")
    goes = F.coalesce("_inner", F.lit(False))
    now = written(succ.join(inner, "to", "left").select("node", F.when(goes, F.col("to")).otherwise(F.col("node")).alias("last"), F.when(goes, F.least("node", "to")).otherwise(F.col("node")).alias("least"), (~goes).alias("ended")))

    def twice(df: DataFrame) -> DataFrame:
        on = df.select(F.col("node").alias("last"), F.col("last").alias("_last"), F.col("least").alias("_least"), "ended")
        return df.drop("ended").join(on.hint("merge"), "last").select("node", F.col("_last").alias("last"), F.least("least", "_least").alias("least"), "ended")

    for _ in range((max(1, rows).bit_length() + 2) // 2):
        now = written(twice(twice(now)))
    return now


def endless(aliases: DataFrame) -> DataFrame:
    """from_id of every alias whose chain never ends: it is on a cycle, of any length, or leads into one. aliases: from_id, to_id."""
    each = written(aliases.where("from_id is not null and to_id is not null").select("from_id", "to_id").distinct())
    sizes = each.agg(F.count("*").alias("rows"), F.count_distinct("from_id").alias("nodes")).first()
    if sizes.rows == sizes.nodes:
        return jumped(each.select(F.col("from_id").alias("node"), F.col("to_id").alias("to")), sizes.rows).where("not ended").select(F.col("node").alias("from_id"))
    edges = each.select(F.col("from_id").alias("node"), F.col("to_id").alias("depends_on"))  # some alias has several targets
    front = found = written(strongly_connected(edges).select("node"))
    while not front.isEmpty():
        front = written(edges.join(front.select(F.col("node").alias("depends_on")), "depends_on", "left_semi").select("node").distinct().join(found, "node", "left_anti"))
        found = written(found.union(front))
    return found.select(F.col("node").alias("from_id"))


def _contracted(e: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None, DataFrame]:
    """rings (node, root), inner nodes (node, enters, leaves), closed nodes (node), and e with each chain of nodes of one way in and one out as an edge."""
    outs = e.groupBy("node").agg(F.count("*").alias("n_out"), F.max("depends_on").alias("to"))
    ins = e.groupBy(F.col("depends_on").alias("node")).agg(F.count("*").alias("n_in"))
    through = written(outs.join(ins.hint("merge"), "node").where("n_out = 1 and n_in = 1").select("node", "to"))
    rows = through.count()
    if not rows:
        return None, None, None, e
    ends = jumped(through, rows)
    rings, chains = ends.where("not ended").select("node", F.col("least").alias("root")), ends.where("ended").select("node", "last")
    own, others = through.select("node").hint("merge"), through.select(F.col("node").alias("depends_on")).hint("merge")
    enters = e.join(others, "depends_on", "left_semi").join(own, "node", "left_anti").select(F.col("node").alias("enters"), F.col("depends_on").alias("node")).join(chains.hint("merge"), "node").select("last", "enters")
    leaves = through.join(chains.where("node = last").select("node").hint("merge"), "node", "left_semi").select(F.col("node").alias("last"), F.col("to").alias("leaves"))
    spans = written(enters.join(leaves.hint("merge"), "last"))
    inner = written(chains.join(spans.hint("merge"), "last").select("node", "enters", "leaves"))
    rest = e.join(own, "node", "left_anti").join(others, "depends_on", "left_anti").select("node", "depends_on")
    new = rest.union(spans.where("enters <> leaves").select(F.col("enters").alias("node"), F.col("leaves").alias("depends_on"))).distinct()
    return written(rings), inner, spans.where("enters = leaves").select(F.col("enters").alias("node")).distinct(), written(new)


def _coloured(e: DataFrame) -> DataFrame:
    """node, root of one component of each colour: the largest node that reaches a node colours it, and its component is what reaches back to it in its colour."""
    nodes = e.select("node").union(e.select("depends_on")).distinct()
    colour = written(nodes.withColumn("colour", F.col("node")))
    while True:
        told = e.join(colour, "node").groupBy(F.col("depends_on").alias("node")).agg(F.max("colour").alias("told"))
        new = written(colour.join(told, "node", "left").select("node", F.greatest("colour", "told").alias("colour"), (F.col("told") > F.col("colour")).alias("moved")))
        colour = new.select("node", "colour")
        if new.where("moved").isEmpty():
            break
    same = written(e.join(colour, "node").join(colour.select(F.col("node").alias("depends_on"), F.col("colour").alias("_colour")), "depends_on").where("colour = _colour").select("node", "depends_on"))
    front = found = written(colour.where("node = colour"))
    while not front.isEmpty():
        step = same.join(front.select(F.col("node").alias("depends_on"), "colour"), "depends_on").select("node", "colour").distinct()
        front = written(step.join(found.select("node"), "node", "left_anti"))
        found = written(found.union(front))
    return found.select("node", F.col("colour").alias("root"))


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose two nodes have both a way in and a way out."""
    with_out, with_in = e.select(F.col("node").alias("depends_on")).distinct(), e.select(F.col("depends_on").alias("node")).distinct()
    return e.join(with_out.hint("merge"), "depends_on", "left_semi").join(with_in.hint("merge"), "node", "left_semi").select("node", "depends_on")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, root of every node on a cycle; root is the smallest node of its strongly connected component. edges: node, depends_on.

    Chains and rings of any length take a logarithmic number of jobs and a row a node;
    only what still branches after they are contracted and loose ends are trimmed is
    coloured, in as many rounds as it is wide.
    """
    e = written(edges.where("node is not null and depends_on is not null").select("node", "depends_on").distinct())
    loops = e.where("node = depends_on").select("node")
    e = written(e.where("node <> depends_on"))
    found, trail, size = e.select("node", F.col("node").alias("root")).where("false"), [], e.count()
    while size:
        rings, inner, closed, e = _contracted(e)
        if rings is not None:
            found, trail = found.union(rings), [*trail, (inner, closed)]
        e = written(_trimmed(e))
        before, size = size, e.count()
        if size < before:
            continue
        some = _coloured(e)
        found = written(found.union(some))
        e = written(e.join(some.select("node"), "node", "left_anti").join(some.select(F.col("node").alias("depends_on")), "depends_on", "left_anti").select("node", "depends_on"))
        size = e.count()
    for inner, closed in reversed(trail):
        found = written(found.union(closed.join(found.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("root"))))
        at = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        found = written(found.union(inner.join(at("enters").hint("merge"), "enters").join(at("leaves").hint("merge"), "leaves").where("enters_root = leaves_root").select("node", F.col("enters_root").alias("root"))))
    members = found.union(loops.join(found.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("root")))
    sizes = members.groupBy("root").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    kept = members.join(sizes.hint("merge"), "root").join(loops.withColumn("_loop", F.lit(True)).hint("merge"), "node", "left")
    return kept.where("n > 1 or _loop").select("node", F.col("least").alias("root"))
