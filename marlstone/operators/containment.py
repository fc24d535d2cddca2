"""Set-containment joins: who holds every compartment of what, as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.policy import CLASSIFICATIONS, may_read, rank

#: The key of materials without compartments, and that of a compartment that is null; no name begins with a zero.
OPEN, NAMELESS = "\0open", "\0null"


def _names(sets: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(sets, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(NAMELESS))))


def shapes(materials: DataFrame) -> DataFrame:
    """classification, compartments, materials: the distinct demands of materials (classification, compartments) and how many have them."""
    return materials.select("classification", F.array_sort(_names(F.col("compartments"))).alias("compartments")).groupBy("classification", "compartments").agg(F.count("*").alias("materials"))


def readable(principals: DataFrame, demands: DataFrame) -> DataFrame:
    """principals (principal_id, clearance, held) by demands (classification, compartments, and more): the pairs in which the principal may read.

    A demand stands under one compartment, the one that the fewest principals hold, or
    under none; a principal looks under each that it holds and under none. So each pair
    meets once, by equality, and the rest of the set and the clearance are checked on what
    meets. Unknown values deny.
    """
    holding = principals.withColumn("held", _names(F.col("held")))
    keys = holding.withColumn("_key", F.explode(F.concat("held", F.array(F.lit(OPEN)))))
    holders = keys.groupBy("_key").agg(F.count("*").alias("_holders"))
    known = demands.where(F.col("classification").isin(*CLASSIFICATIONS)).withColumn("compartments", _names(F.col("compartments"))).withColumn("_demand", F.monotonically_increasing_id())
    parts = known.select("_demand", F.explode(F.when(F.size("compartments") == 0, F.array(F.lit(OPEN))).otherwise(F.col("compartments"))).alias("_key"))
    rarest = parts.join(holders, "_key").groupBy("_demand").agg(F.min(F.struct("_holders", "_key"))["_key"].alias("_key"), F.count("*").alias("_met"))
    # a compartment that nobody holds leaves a demand with fewer parts than it has: nobody reads it
    by_key = known.join(rarest, "_demand").where(F.col("_met") == F.greatest(F.size("compartments"), F.lit(1))).drop("_demand", "_met")
    met = by_key.join(keys.where(rank(F.col("clearance"), CLASSIFICATIONS).isNotNull()), "_key")
    return met.where(may_read(F.col("clearance"), F.col("held"), F.col("classification"), F.col("compartments"))).drop("_key")


def readable_counts(principals: DataFrame, materials: DataFrame) -> DataFrame:
    """principal_id, readable: how many materials each principal may read, none included. Materials of one demand are counted together."""
    pairs = readable(principals, shapes(materials)).groupBy("principal_id").agg(F.sum("materials").alias("_n"))
    return principals.select("principal_id").join(pairs, "principal_id", "left").select("principal_id", F.coalesce("_n", F.lit(0)).alias("readable"))
