"""An inverted index over concepts, and top-k search of a table of queries that stops early.

The index is three written tables: postings (a row a term, concept and field; each file
sorted by term), what is known of each term of a mount, and the catalog without texts. Where
all terms that will be asked for are known, it has the postings of these alone. A search reads
no text. Terms of a query go from rare to frequent: the rare ones open candidates, whose
scores bound the last place; a term whose weight and all more frequent ones' together stay
under that bound opens no candidates and only completes the scores of those that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.text import terms
from marlstone.operators.retrieval import LIMITS, WEIGHTS, eligible, normalized
from marlstone.operators.stage import written

#: Postings that a query opens in a mount, for each place of its answer, before the bound is taken.
OPENING = 20
ID = ["mount_id", "concept_id"]


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, mount_id, concept_id, weight
    terms: DataFrame  # term, mount_id, postings, most: how often, and the largest score that it can give
    catalog: DataFrame  # all columns of the concepts but the texts


def vocabulary(queries: DataFrame, normalise: bool = True) -> DataFrame:
    """term: all terms of queries (text)."""
    return queries.select(F.explode(terms(F.col("text"), normalise)).alias("term")).distinct()


def indexed(concepts: DataFrame, normalise: bool = True, asked: DataFrame | None = None) -> Index:
    """The index of concepts (mount_id, concept_id, title, description, tags, body and what eligible() needs); asked: the terms that it will be searched for, if they are known."""
    fields = {"title": F.coalesce("title", F.col("concept_id").cast("string")), "tags": F.array_join("tags", " "), "description": F.col("description"), "body": F.col("body")}

    def weighed(name: str):
        of = F.coalesce(terms(fields[name], normalise), F.array().cast("array<string>"))
        return F.transform(of, lambda t: F.struct(t.alias("term"), F.lit(WEIGHTS[name]).alias("weight")))

    found = [weighed(name) for name in fields]
    rows = concepts.select(*ID, F.explode(F.concat(*found)).alias("_p")).select("_p.term", *ID, "_p.weight")
    if asked is not None:
        rows = rows.join(written(asked.select("term").distinct()), "term", "left_semi")  # written, so that its size is known
    postings = written(rows.sortWithinPartitions("term", *ID))  # where the texts are read: ranges of terms would have them read twice
    by_field = postings.groupBy("term", "mount_id", "weight").agg(F.count("*").alias("n"))
    known = written(by_field.groupBy("term", "mount_id").agg(F.sum("n").alias("postings"), F.sum("weight").alias("most")))
    return Index(postings, known, written(concepts.drop("body", "description", "tags")))


def _places(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "concept_id")
    return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def search_batch(index: Index, mounts: DataFrame, queries: DataFrame, *, mode: str = "wiki-only", minimum_trust: str = "unverified", stale_behavior: str = "warn", today: str = "2026-01-01", limit: int = 20, normalise: bool = True) -> DataFrame:
    """query_id, mount_id, concept_id, title, tier, score, normalized, is_stale, place: for each of queries (query_id, text) what search() gives."""
    if not LIMITS[0] <= limit <= LIMITS[1]:
        raise ValueError("the limit is out of bounds")
    c = eligible(index.catalog, mode=mode, minimum_trust=minimum_trust, stale_behavior=stale_behavior, today=today).join(mounts.select("mount_id", "priority"), "mount_id")
    c = written(c.select(*ID, "title", "tier", "is_stale", "priority"))
    wanted = queries.select("query_id", F.explode(terms(F.col("text"), normalise)).alias("term")).join(index.terms, "term")
    pair = ["query_id", "mount_id"]
    rising = Window.partitionBy(*pair).orderBy("postings", "term").rowsBetween(Window.unboundedPreceding, -1)
    falling = Window.partitionBy(*pair).orderBy(F.desc("postings"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    plan = written(wanted.select(*pair, "term", (F.coalesce(F.sum("postings").over(rising), F.lit(0)) < OPENING * limit).alias("opens"), F.sum("most").over(falling).alias("rest")))

    def scored(some: DataFrame) -> DataFrame:
        met = index.postings.join(some.select("query_id", "mount_id", "term"), ["term", "mount_id"])
        return met.join(c.select(*ID), ID, "left_semi").groupBy("query_id", *ID).agg(F.sum("weight").alias("score"))

    opened = written(scored(plan.where("opens")))
    last = _places(opened, limit, *pair).where(F.col("nth") == limit).select(*pair, F.col("score").alias("bound"))
    plan = written(plan.join(last, pair, "left").withColumn("bound", F.coalesce("bound", F.lit(0))).withColumn("late", ~F.col("opens") & (F.col("rest") < F.col("bound"))))
    known = opened.unionByName(scored(plan.where("not opens and not late"))).groupBy("query_id", *ID).agg(F.sum("score").alias("score"))
    left = plan.groupBy(*pair).agg(F.max("bound").alias("bound"), F.coalesce(F.max(F.when(F.col("late"), F.col("rest"))), F.lit(0)).alias("rest"))
    kept = written(known.join(left, pair).where(F.col("score") + F.col("rest") >= F.col("bound")).select("query_id", *ID, "score"))
    asked = kept.select("query_id", *ID).join(plan.where("late").select(*pair, "term"), pair)
    more = asked.join(index.postings, ["term", *ID]).groupBy("query_id", *ID).agg(F.sum("weight").alias("more"))
    total = kept.join(more, ["query_id", *ID], "left").select("query_id", *ID, (F.col("score") + F.coalesce("more", F.lit(0))).alias("score"))
    best = written(_places(total, limit, *pair).drop("nth"))  # at most `limit` a query and mount
    most = best.groupBy(*pair).agg(F.max("score").alias("_most"))
    rated = normalized(best.join(c, ID), most, pair)
    order = Window.partitionBy("query_id").orderBy(F.desc("normalized"), *ID)
    top = rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    if stale_behavior == "fail":
        top = written(top)
        top = top.join(top.where("is_stale").select("query_id").distinct(), "query_id", "left_anti")
    return top.select("query_id", *ID, "title", "tier", "score", "normalized", "is_stale", "place")
