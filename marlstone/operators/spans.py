"""Windows over keys of any size: the rows of a key in ranges, and what each range hands to the next.

A key with very many rows is spread over tasks by ranges of (key, order); a window holds the
rows of one key in one range. The ranges' summaries, a row each, carry the last row, the
first one or the count over the borders. Their number is that of the keys and the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.stage import written

BEFORE = (Window.unboundedPreceding, -1)


def spanned(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df, written in ranges of keys and order, with the number of its range."""
    return written(df.repartitionByRange(*keys, *order).withColumn("_span", F.spark_partition_id()))


def _inner(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_span").orderBy(*order)


def _with(d: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    """d with its range's row of carry."""
    other = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_span"])], *[c for c in carry.columns if c not in (*keys, "_span")])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_span"])]
    return d.join(other, on).drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def _summed(d: DataFrame, keys: list[str], end: Column, carry: Column) -> DataFrame:
    return d.groupBy(*keys, "_span").agg(end.alias("_end")).select(*keys, "_span", carry.alias("_carry"))


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the value of the row before in its key (null for the first)."""
    d = spanned(df.withColumn("_v", value), keys, order)
    ends = _summed(d, keys, F.max_by("_v", F.struct(*order)), F.lag("_end").over(Window.partitionBy(*keys).orderBy("_span")))
    w = _inner(keys, order)
    return _with(d, keys, ends).withColumn(name, F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag("_v").over(w))).drop("_v", "_span", "_carry")


def following(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the value of the row after in its key (null for the last)."""
    d = spanned(df.withColumn("_v", value), keys, order)
    starts = d.groupBy(*keys, "_span").agg(F.min_by("_v", F.struct(*order)).alias("_end"), F.count("*").alias("_rows"))
    starts = starts.select(*keys, "_span", "_rows", F.lead("_end").over(Window.partitionBy(*keys).orderBy("_span")).alias("_carry"))
    w = _inner(keys, order)
    return _with(d, keys, starts).withColumn(name, F.when(F.row_number().over(w) == F.col("_rows"), F.col("_carry")).otherwise(F.lead("_v").over(w))).drop("_v", "_span", "_carry", "_rows")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null up to and with the row in its key."""
    d = spanned(df.withColumn("_v", value), keys, order)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    ends = _summed(d, keys, last, F.last("_end", True).over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(*BEFORE)))
    inside = F.last("_v", True).over(_inner(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return _with(d, keys, ends).withColumn(name, F.coalesce(inside, "_carry")).drop("_v", "_span", "_carry")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the row's number in its key, from 1."""
    d = spanned(df, keys, order)
    ahead = F.coalesce(F.sum("_end").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(*BEFORE)), F.lit(0))
    return _with(d, keys, _summed(d, keys, F.count("*"), ahead)).withColumn(name, (F.row_number().over(_inner(keys, order)) + F.col("_carry")).cast("int")).drop("_span", "_carry")
