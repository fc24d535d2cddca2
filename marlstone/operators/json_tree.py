"""JSON documents as trees of VARIANT values, walked level by level: references and changed leaves.

A level is one explode of all documents' values, so that the jobs are as many as the deepest
document is deep, and no document is read by Python. Objects' members have no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.stage import spread, written

# The keys that refer to sources, by what they hold.
REFERENCE_KEYS = {"source_id": "id", "source_ids": "id", "source_hash": "hash", "source_hashes": "hash"}
# In a path with one of these words an array is one value, as its members act together.
ATOMIC_WORDS = ("gate", "approval", "network", "credential", "filesystem", "access", "rights", "permission")
MOST_DEPTH = 100


def kind(value: Column) -> Column:
    """object, array or another type's name; null for none."""
    return F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Za-z]+", 0))


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """keep, pos, key, item of every member of `value`; key is null in arrays."""
    spark = df.sparkSession
    return spark.sql(f"SELECT {', '.join(f'd.{c}' for c in keep)}, x.pos, x.key, x.value AS item FROM {{d}} d, LATERAL variant_explode(d.value) x", d=df)


def text(value: Column) -> Column:
    """A value as JSON without blanks, members by key. A number with an exponent is written out within 1e-6 and 1e21."""
    number = F.try_variant_get(value, "$", "double")
    small = (F.abs(number) >= 1e-6) & (F.abs(number) < 1e21)
    plain = F.regexp_replace(number.cast("string").cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    power = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.0)?E(?=\d)", "e+"), r"(\.0)?E-", "e-")
    return F.when((kind(value) == "double") & small, plain).when((kind(value) == "double") & (number != 0), power).otherwise(F.to_json(value))


def references(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """keys, kind (id, hash), value: each string under a key that refers to sources, or in a list under one, at any depth. JSON that doesn't parse has none."""
    level = written(df.select(*keys, F.try_parse_json(content).alias("value"), F.lit(None).cast("string").alias("held")))
    of = F.create_map(*[F.lit(x) for pair in REFERENCE_KEYS.items() for x in pair])
    found = []
    for _ in range(MOST_DEPTH + 1):
        members = exploded(level, *keys, "held").withColumn("kind", kind(F.col("item")))
        members = written(members.select(*keys, F.coalesce("key", "held").alias("name"), F.col("key").alias("held"), "kind", F.col("item").alias("value")))
        named = members.where((F.col("kind") == "string") & F.col("name").isin(*REFERENCE_KEYS))
        found.append(named.select(*keys, of[F.col("name")].alias("kind"), F.variant_get("value", "$", "string").alias("value")))
        level = members.where(F.col("kind").isin("object", "array")).select(*keys, "value", "held")
        if level.isEmpty():
            break
    else:
        raise ValueError(f"a document is deeper than {MOST_DEPTH}")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _alike(before: Column, after: Column) -> Column:
    numeric = kind(before).isin("bigint", "decimal", "double") & kind(after).isin("bigint", "decimal", "double")
    equal = F.try_variant_get(before, "$", "double") == F.try_variant_get(after, "$", "double")
    exact = kind(before).isin("double") | kind(after).isin("double")
    return F.to_json(before).eqNullSafe(F.to_json(after)) | F.coalesce(numeric & exact & equal, F.lit(False))


def differences(df: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """keys, path, before, after (JSON; null where a side has nothing) of each changed leaf of two JSON texts, a side of null being absent.

    Both sides' members meet by their label: an object's key, @ and the id (or name, or
    metadata's id) of an array's member if all members of both sides have one and no side has
    one twice, else its place if any member is an object. Arrays of plain values and those
    in a path with an atomic word are leaves.
    """
    sides = F.struct(F.try_parse_json(before).alias("before"), F.try_parse_json(after).alias("after")).alias("_v")
    level = written(spread(df).select(*keys, F.monotonically_increasing_id().alias("_row"), F.lit("").alias("path"), sides).select(*keys, "_row", "path", "_v.before", "_v.after"))
    own, found = [*keys, "_row", "path"], []
    for _ in range(MOST_DEPTH + 1):
        changed = level.where(~_alike(F.col("before"), F.col("after"))).withColumn("inner", F.lit(None).cast("string"))
        atomic = F.lower("path").rlike("|".join(ATOMIC_WORDS))
        kinds = F.array(kind(F.col("before")), kind(F.col("after")))
        full = lambda c: (kind(F.col(c)) == "object") & (F.to_json(c) != "{}")
        objects = F.coalesce(full("before"), F.lit(False)) | F.coalesce(full("after"), F.lit(False))
        shape = F.when(objects, "object").when(F.coalesce(F.array_contains(F.array_compact(kinds), "array"), F.lit(False)) & ~atomic, "array").otherwise("leaf")
        changed = written(changed.withColumn("inner", shape))
        sided = changed.where("inner <> 'leaf'").select(*own, "inner", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "before", "after")
        sided = sided.withColumn("value", F.when(F.col("side") == 0, F.col("before")).otherwise(F.col("after"))).where(kind(F.col("value")) == F.col("inner")).drop("before", "after")
        name = F.coalesce(*[F.when(kind(F.try_variant_get("item", p, "variant")).isNotNull(), F.struct(F.when(kind(F.try_variant_get("item", p, "variant")) == "string", F.try_variant_get("item", p, "string")).alias("id"))) for p in ("$.id", "$.name", "$.metadata.id")])["id"]
        members = written(exploded(sided, *own, "inner", "side").withColumns({"_kind": kind(F.col("item")), "_name": F.when(kind(F.col("item")) == "object", name)}))
        facts = members.where("inner = 'array'").groupBy(*own).agg((F.count("*") == F.count_distinct("side", "_name")).alias("_keyed"), F.bool_or(F.col("_kind") == "object").alias("_objects"))
        labelled = members.join(facts, own, "left")
        label = F.when(F.col("inner") == "object", F.col("key")).when(F.col("_keyed"), F.concat(F.lit("@"), "_name")).when(F.col("_objects"), F.col("pos").cast("string"))
        side = lambda n: F.any_value(F.when(F.col("side") == n, F.col("item")), True)
        meeting = labelled.withColumn("_label", label).where("_label is not null").groupBy(*own, "_label").agg(side(0).alias("before"), side(1).alias("after"))
        plain = facts.where("not _keyed and not _objects").select(*own)
        leaves = changed.where("inner = 'leaf'").select(*own, "before", "after").union(changed.join(plain, own, "left_semi").select(*own, "before", "after"))
        found.append(leaves.select(*keys, "path", text(F.col("before")).alias("before"), text(F.col("after")).alias("after")))
        level = written(meeting.select(*keys, "_row", F.concat("path", F.lit("/"), "_label").alias("path"), "before", "after"))
        if level.isEmpty():
            break
    else:
        raise ValueError(f"a document is deeper than {MOST_DEPTH}")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
