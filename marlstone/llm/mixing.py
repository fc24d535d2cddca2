"""Mixing by weighted fair queueing, with DataFrame functions only.

Each source's documents are shuffled by a keyed hash of id, size and, where rows repeat,
the number of the copy. A document's virtual finish time is its source's cumulative size
up to and with it, divided by the source's target; a second pass over the source follows
the first, so that a target of up to twice the source's size can be served. The queue is
sorted globally by ranges of the finish time and cut at the total budget.

Targets: sources in code point order, null last, have the weights in turn; the
budget is shared by weight, a target stops at twice its source's size, and the
excess is shared again until none is above (water filling).

No task holds a whole source and none holds the whole queue: cumulative sums run
in (source, bucket of the shuffle), the cut is found on the totals of the ranges, and
only the range that it falls into is summed in order.

A null or empty text has size 0 and takes nothing; a very long one is taken whole or not
at all; null ids count as the empty text in the shuffle; a null source is a source of its
own; an empty table gives an empty result. Repeated rows are documents of their own, each
with a place of its own in the queue; rows equal in source, id and size are
interchangeable. Ties of the finish time go by source and hash. Other columns, whatever
their names, are not looked at (mix) or kept as they are (mixed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, numbered, place, running, stash

WEIGHTS = (3, 1, 2)
#: The budget as a share of all sizes, and the most passes over a source.
BUDGET, PASSES = 1.5, 2
#: Buckets of the shuffle in each source (three hexadecimal digits of the hash), and rows of a range of the queue at about.
BUCKETS, RANGE_ROWS = 4096, 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """src, source_size, target: one row a source. Windows here see a row for each source only."""
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    up = every.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(budget))
    # the share of a unit of weight if just the sources before this one are at their caps
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    later = up.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    open_ = F.when(F.col("cap") / F.col("weight") >= F.col("share"), F.col("share"))
    # sources are capped in this order up to the first that is not
    s = s.withColumn("level", F.first(open_, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("src", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def ranked_copies(d: DataFrame) -> DataFrame:
    """d with copy: rows equal in src, doc_id and size are numbered from 0, in parts by the row's number, so that no task holds all copies of a row."""
    keys = ["src", "_id", "size"]
    d = d.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    if d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return d.withColumn("copy", F.lit(0).cast("long")).drop("_id")
    return running(d.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(BUCKETS))), keys, "part", [F.col("row")], F.lit(1).cast("long"), "copy").withColumn("copy", F.col("copy") - 1).drop("part", "_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES, seed: str = "7") -> DataFrame:
    """doc_id, size, source_size, target, taken and finish (the virtual finish time of the first pass)."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), words(F.col(text_col)).alias("size"))
    return decided(stash(d), weights, budget, passes, seed).drop("row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES, seed: str = "7") -> DataFrame:
    """The mix itself: every row of docs, with all its columns, as often as it is taken."""
    at = [place(docs, c) for c in (id_col, text_col, source_col)]
    keyed = stash(numbered(docs).withColumn("_mk_row", F.monotonically_increasing_id()))
    d = keyed.select(F.col("_mk_row").alias("row"), F.col(f"_mk_{at[0]}").alias("doc_id"), F.col(f"_mk_{at[2]}").alias("src"), words(F.col(f"_mk_{at[1]}")).alias("size"))
    found = decided(stash(d), weights, budget, passes, seed).where("taken > 0").select(F.col("row").alias("_mk_row"), F.expr("cast(taken div size as int)").alias("_mk_times"))
    out = keyed.join(found, "_mk_row").withColumn("_mk_copy", F.explode(F.sequence(F.lit(1), F.col("_mk_times"))))
    return out.select(*[f"_mk_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def decided(d: DataFrame, weights, budget: float, passes: int, seed: str) -> DataFrame:
    """The mix's decision on each row of a written table of row, doc_id, src and size."""
    targets = stash(source_targets(d.groupBy("src").agg(F.sum("size").alias("source_size")), weights, budget, passes))
    limit = (targets.agg(F.sum("source_size")).first()[0] or 0) * budget
    t = targets.select(F.col("src").alias("_src"), "source_size", "target")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string"))
    d = ranked_copies(d).withColumn("at", F.md5(key.cast("binary"))).withColumn("bucket", F.substring("at", 1, 3))
    summed = running(d, ["src"], "bucket", [F.col("at")], F.col("size"), "cum")
    summed = stash(summed.join(t, F.col("src").eqNullSafe(F.col("_src"))).withColumn("finish", F.try_divide(F.col("cum"), F.col("target"))).select("row", "doc_id", "src", "size", "at", "cum", "source_size", "target", "finish"))
    # the queue, sorted by ranges: a written partition holds a range of places, and its number is its rank
    queue = summed.where("size > 0").select("src", "at", "size", F.col("cum"), "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    queue = queue.select("src", "at", "size", "pass", F.try_divide(F.col("cum") + F.col("pass") * F.col("source_size"), F.col("target")).alias("time"))
    line = [F.col("time"), F.col("src").asc_nulls_last(), F.col("at"), F.col("pass")]
    ranges = 1 + passes * summed.where("size > 0").count() // RANGE_ROWS
    queue = stash(queue.repartitionByRange(ranges, *line).withColumn("rank", F.spark_partition_id()))
    totals = queue.groupBy("rank").agg(F.sum("size").alias("n"))  # a row a range
    ahead = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    cut = totals.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("before") + F.col("n") > F.lit(limit)).agg(F.min_by(F.struct("rank", "before"), "rank").alias("c")).first()[0]
    if cut:
        upto = F.sum("size").over(Window.partitionBy("rank").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0))
        edge = queue.where(F.col("rank") == cut["rank"]).withColumn("to", upto + F.lit(cut["before"])).where(F.col("to") <= F.lit(limit)).drop("to")
        queue = queue.where(F.col("rank") < cut["rank"]).union(edge)
    # the last place that is served, under one type for both sides of the comparison
    shape = "struct<time:double,none:boolean,src:string,at:string,pass:int>"
    spot = lambda time, p: F.struct(time, F.col("src").isNull(), F.col("src").cast("string"), F.col("at"), p).cast(shape)
    last = queue.agg(F.max(spot(F.col("time"), F.col("pass")))).first()[0]
    taken = F.lit(0)
    for p in range(passes if last is not None else 0):
        time = F.try_divide(F.col("cum") + p * F.col("source_size"), F.col("target"))
        inside = spot(time, F.lit(p)) <= F.struct(*map(F.lit, last)).cast(shape)
        taken = taken + F.when(inside & (F.col("size") > 0), F.col("size")).otherwise(0)
    return summed.select("row", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "finish")


def op4_weighted_fair_mix(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH b AS (
  SELECT doc_id, source AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         row_number() OVER (PARTITION BY source, doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ) - 1 AS copy FROM documents),
d AS (SELECT *, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS "at" FROM b),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT src, source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
x AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
l AS (SELECT arg_min(share, cap / weight) AS level FROM x WHERE cap / weight >= share),
t AS (SELECT src, source_size, least(cap, coalesce(weight * level, cap)) AS target FROM w, l),
c AS (SELECT d.*, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.src ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src),
q AS (SELECT *, sum(size) OVER (ORDER BY "time", src NULLS LAST, "at", pass ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM (SELECT c.*, pass, CAST(cum + pass * source_size AS DOUBLE) / target AS "time" FROM c, (VALUES (0), (1)) p(pass) WHERE size > 0)),
k AS (SELECT src, "at", sum(size) AS taken FROM q WHERE upto <= (SELECT sum(size) * 1.5::DOUBLE FROM d) GROUP BY src, "at")
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM c LEFT JOIN k ON c."at" = k."at" AND c.src IS NOT DISTINCT FROM k.src
"""
