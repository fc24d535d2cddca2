"""Semantic versions as comparable structs, and ranges of them as half-open intervals, in columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of a version and of a comparator of a range.
VERSION = r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
COMPARATOR = r"^(\^|~|>=|<=|>|<|=)?v?([0-9]+|[x*])(?:\.([0-9]+|[x*]))?(?:\.([0-9]+|[x*]))?(?:-([0-9A-Za-z.-]+))?$"
PART = "struct<kind:int,digits:int,text:string>"
POINT = f"struct<major:decimal(30,0),minor:decimal(30,0),patch:decimal(30,0),pre:array<{PART}>,after:int>"


def _part(kind: int | Column, digits: int | Column, text: str | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(kind).cast("int").alias("kind"), lit(digits).cast("int").alias("digits"), lit(text).cast("string").alias("text"))


def _pre(text: Column) -> Column:
    """Identifiers of a pre-release: numbers by value before words; none comes after all."""

    def one(x: Column) -> Column:
        plain = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(x.rlike("^[0-9]+$"), _part(0, F.length(plain), plain)).otherwise(_part(1, 0, x))

    return F.when(text == "", F.array(_part(2, 0, ""))).otherwise(F.transform(F.split(text, r"\."), one))


def _least() -> Column:
    """Before every pre-release of its numbers."""
    return F.array(_part(0, -1, ""))


def _point(major: Column, minor: Column, patch: Column, pre: Column, after: int = 0) -> Column:
    number = lambda c: c.cast("decimal(30,0)")
    return F.struct(number(major).alias("major"), number(minor).alias("minor"), number(patch).alias("patch"), pre.alias("pre"), F.lit(after).alias("after"))


def _after(point: Column) -> Column:
    """The place just behind a version."""
    return F.struct(*[point[c].alias(c) for c in ("major", "minor", "patch", "pre")], F.lit(1).alias("after"))


def version_point(v: Column) -> Column:
    """A version as a struct that orders as versions do; null if it is malformed."""
    at = lambda n: F.regexp_extract(v, VERSION, n)
    return F.when(v.rlike(VERSION), _point(at(1), at(2), at(3), _pre(at(4))))


def _interval(c: Column) -> Column:
    """low, high of one comparator: the versions from low up to but without high; null if it is malformed."""
    at = lambda n: F.regexp_extract(c, COMPARATOR, n)
    op = at(1)
    number = [F.when(at(n).rlike("^[0-9]+$"), at(n).cast("decimal(30,0)")) for n in (2, 3, 4)]
    major, minor, patch = (F.coalesce(n, F.lit(0).cast("decimal(30,0)")) for n in number)
    zero, any_major, any_minor, any_patch = F.lit(0), *[n.isNull() for n in number]
    low = _point(major, minor, patch, _pre(at(5)))
    next_ = lambda a, b, c: _point(a, b, c, _least())
    next_major, next_minor, next_patch = next_(major + 1, zero, zero), next_(major, minor + 1, zero), next_(zero, zero, patch + 1)
    open_ = any_minor | any_patch  # 1 or 1.2: any version that begins so
    over = F.when(any_minor, next_major).otherwise(next_minor)
    caret = F.when((major != 0) | any_minor, next_major).when((minor != 0) | any_patch, next_minor).otherwise(next_patch)
    first = _point(zero, zero, zero, _least())
    last = _point(F.lit("9" * 30), zero, zero, _least())
    low_ = F.when(any_major, first).when(op.isin("<", "<="), first).when(op == ">", F.when(open_, over).otherwise(_after(low))).otherwise(low)
    high = (
        F.when(any_major, last).when(op.isin(">", ">="), last).when(op == "^", caret).when(op == "~", over).when(op == "<", low)
        .when(op == "<=", F.when(open_, over).otherwise(_after(low))).otherwise(F.when(open_, over).otherwise(_after(low)))
    )
    return F.when(c.rlike(COMPARATOR), F.struct(low_.cast(POINT).alias("low"), high.cast(POINT).alias("high")))


def range_intervals(wanted: Column) -> Column:
    """A range (comparators, ^, ~, x, ||) as intervals low to high, of which one has to hold a version; null if any comparator is malformed."""

    def alternative(part: Column) -> Column:
        return F.transform(F.filter(F.split(F.trim(part), r"\s+"), lambda x: x != ""), _interval)

    parts = F.transform(F.split(wanted, r"\|\|"), alternative)
    met = F.transform(parts, lambda p: F.struct(F.coalesce(F.array_max(F.transform(p, lambda x: x["low"])), _point(F.lit(0), F.lit(0), F.lit(0), _least()).cast(POINT)).alias("low"), F.coalesce(F.array_min(F.transform(p, lambda x: x["high"])), _point(F.lit("9" * 30), F.lit(0), F.lit(0), _least()).cast(POINT)).alias("high")))
    return F.when(~F.exists(F.flatten(parts), lambda x: x.isNull()), met)


def within(point: Column, intervals: Column) -> Column:
    """Whether a version's point is in one of the intervals; null if either is null."""
    at = point.cast(POINT)
    return F.when(point.isNotNull() & intervals.isNotNull(), F.exists(intervals, lambda i: (i["low"] <= at) & (at < i["high"])))


def version_satisfies(v: Column, wanted: Column) -> Column:
    """Whether a version is in a range; prereleases count; null if either is malformed."""
    return within(version_point(v), range_intervals(wanted))


def with_satisfied(df: DataFrame, version: str, wanted: str, name: str = "ok") -> DataFrame:
    """df with version_satisfies() of a column and one range as name: its intervals are made once and sent to all tasks."""
    intervals = df.sparkSession.range(1).select(range_intervals(F.lit(wanted)).alias("_intervals"))
    return df.crossJoin(F.broadcast(intervals)).withColumn(name, within(version_point(F.col(version)), F.col("_intervals"))).drop("_intervals")
