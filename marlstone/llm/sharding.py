"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts are a group and share a shard, unless the group is over a
whole shard in some dimension: then it is split into pieces of a quarter of a shard by a
hash of the id and, where the group's ids repeat or are null, of the row's number. A
group over 1/128 of a shard is an item of its own (at most 3 * 128 a shard can exist);
all smaller groups are gathered into 128 items a shard by a hash of the text. So the
packing on the driver has a bounded number of items at any corpus size. Items go in
decreasing order of size, each to the shard where the dot product of its vector with the
residual capacity is highest among the shards with room in every dimension, else among
all. Then items are moved or exchanged between the shards that differ most, as long as
the weighted squares of all dimensions' deviations fall.

A null or empty text has no bytes and no tokens; a very long one is an item of its own; a
null id takes part like any other and gets a slot; an empty table gives an empty result;
repeated rows are rows of their own; ties of slots go by id and text; other columns,
whatever their names, are not looked at (assign) or kept as they are (shard_documents).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, numbered, place, stash

#: Items of small groups for each shard; a group over 1/ITEMS of a shard is its own item.
ITEMS = 128
#: A group over a shard is split into pieces of 1/SPLIT of a shard.
SPLIT = 4
DIMENSIONS = ("_mk_size", "_mk_tokens", "_mk_one")
UNIT = ("_mk_u1", "_mk_u2", "_mk_u3", "_mk_u4")


def pack(vectors: np.ndarray, shards: int, weights=(2.0, 1.0, 1.0)) -> np.ndarray:
    """The shard of each item, by the weighted dot product with the residual capacity (both as shares of a shard)."""
    total = vectors.sum(0)
    share = vectors * shards / np.where(total > 0, total, 1)
    left = np.ones((shards, share.shape[1]))
    out = np.zeros(len(share), np.int64)
    by = np.asarray(weights)
    for i in np.lexsort((np.arange(len(share)), -share.sum(1))):
        fits = (left >= share[i]).all(1)
        gain = left @ (share[i] * by)
        out[i] = int(np.argmax(np.where(fits, gain, -np.inf) if fits.any() else gain))
        left[out[i]] -= share[i]
    return levelled(share, out, shards)


def levelled(share: np.ndarray, out: np.ndarray, shards: int, weights=(8.0, 1.0, 1.0)) -> np.ndarray:
    """The packing after single items have moved, or two have changed places, between the fullest and the emptiest shard of a dimension.

    Each step is the one that lowers the weighted squares of the deviations in all
    dimensions the most, so that none is levelled at the cost of the others.
    """
    full = np.stack([np.bincount(out, share[:, k], shards) for k in range(share.shape[1])], 1)
    by = np.asarray(weights)[: share.shape[1]]
    for _ in range(40 * shards):
        spread = by * (full.max(0) - full.min(0))
        for k in np.argsort(-spread):
            high, low = int(full[:, k].argmax()), int(full[:, k].argmin())
            own, other = np.flatnonzero(out == high), np.flatnonzero(out == low)
            v = share[own][:, None, :] - np.concatenate([np.zeros((1, share.shape[1])), share[other]])[None, :, :]  # what goes over; the first column exchanges nothing
            gain = (2 * by * v * (full[high] - full[low] - v)).sum(2)
            if gain.size and gain.max() > 1e-12:
                i, j = np.unravel_index(int(gain.argmax()), gain.shape)
                full[high] -= v[i, j]
                full[low] += v[i, j]
                out[own[i]] = low
                if j:
                    out[other[j - 1]] = high
                break
        else:
            break
    return out


def measures(row: Column, doc_id: Column, text: Column) -> dict[str, Column]:
    """A row's number, size (UTF-8 bytes plus 8), tokens, rows, CRC and a 128-bit key of the text in two longs, under names of our own."""
    text = F.coalesce(text, F.lit(""))
    digest = F.md5(text.cast("binary"))
    key = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return {"_mk_row": row, "_mk_id": doc_id, "_mk_size": (F.octet_length(text) + 8).cast("long"), "_mk_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"), "_mk_one": F.lit(1).cast("long"), "_mk_crc": F.crc32(text.cast("binary")), "_mk_g1": key(1), "_mk_g2": key(16)}


class Plan:
    """Where each document goes: small tables that depend on the whole corpus, applied to a written table of the measures."""

    def __init__(self, d: DataFrame, shards: int):
        self.shards, spark = shards, d.sparkSession
        total = d.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in DIMENSIONS]).first()
        most = F.greatest(*[F.sum(x) / F.lit(max(total[x] / shards, 1e-9)) for x in DIMENSIONS])
        heavy = d.groupBy("_mk_g1", "_mk_g2").agg(most.alias("most")).where(F.col("most") > 1 / ITEMS)
        pieces = F.when(F.col("most") > 1, F.ceil(F.col("most") * SPLIT)).otherwise(1).cast("long")
        self.heavy = stash(heavy.select(F.col("_mk_g1").alias("_mk_h1"), F.col("_mk_g2").alias("_mk_h2"), pieces.alias("_mk_pieces")))
        # groups whose ids don't tell their rows apart
        copies = self.weighed(d).where("_mk_pieces is not null").groupBy("_mk_h1", "_mk_h2", "_mk_pieces", "_mk_id").agg(F.count("*").alias("n"))
        self.heavy = stash(copies.groupBy("_mk_h1", "_mk_h2", "_mk_pieces").agg((F.max("n") > 1).alias("_mk_again")))
        units = self.units(d).groupBy(*UNIT).agg(*[F.sum(x).alias(x) for x in DIMENSIONS]).orderBy(*UNIT).collect()
        shard = pack(np.array([[r[x] for x in DIMENSIONS] for r in units], float).reshape(-1, 3), shards)
        rows = [(*(r[x] for x in UNIT), int(k)) for r, k in zip(units, shard, strict=True)]
        self.table = spark.createDataFrame(rows, "_mk_v1 long, _mk_v2 long, _mk_v3 long, _mk_v4 long, _mk_shard int")
        self.parts = max(1, total["_mk_one"] // (shards * 1000))
        before = Window.partitionBy("_mk_shard").orderBy("_mk_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.sharded(d).groupBy("_mk_shard", "_mk_part").agg(F.count("*").alias("n"))
        self.offsets = stash(counts.select(F.col("_mk_shard").alias("_mk_s"), F.col("_mk_part").alias("_mk_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mk_offset")))

    def weighed(self, d: DataFrame) -> DataFrame:
        # at most 3 * ITEMS * shards groups are heavy, whatever the corpus, so that the table can be sent to every task
        return d.join(F.broadcast(self.heavy), (F.col("_mk_g1") == F.col("_mk_h1")) & (F.col("_mk_g2") == F.col("_mk_h2")), "left")

    def units(self, d: DataFrame) -> DataFrame:
        """The packing item of each row (a large group's key and piece, or a bucket of small groups), and the hash that tells rows apart."""
        d = self.weighed(d)
        light = F.col("_mk_pieces").isNull()
        own = F.xxhash64("_mk_id", "_mk_g1", "_mk_g2", F.when(F.col("_mk_again"), F.col("_mk_row")))
        return d.withColumn("_mk_own", own).withColumns({
            "_mk_u1": F.when(light, 0).otherwise(F.col("_mk_g1")), "_mk_u2": F.when(light, 0).otherwise(F.col("_mk_g2")),
            "_mk_u3": F.when(light, -1).otherwise(F.pmod(F.xxhash64(F.col("_mk_own"), F.lit(1)), F.col("_mk_pieces"))), "_mk_u4": F.when(light, F.pmod(F.xxhash64("_mk_g1", "_mk_g2"), F.lit(ITEMS * self.shards))).otherwise(-1),
        })

    def sharded(self, d: DataFrame) -> DataFrame:
        on = [F.col(u) == F.col(v) for u, v in zip(UNIT, ("_mk_v1", "_mk_v2", "_mk_v3", "_mk_v4"), strict=True)]
        return self.units(d).join(F.broadcast(self.table), on).withColumn("_mk_part", F.pmod(F.xxhash64(F.col("_mk_own"), F.lit(2)), F.lit(self.parts)))

    def slotted(self, d: DataFrame) -> DataFrame:
        """d with _mk_shard and _mk_slot; each window holds the thousand or so rows of a part of a shard."""
        inner = Window.partitionBy("_mk_shard", "_mk_part").orderBy("_mk_id", "_mk_crc", "_mk_g1", "_mk_g2")
        placed = self.sharded(d).withColumn("_mk_at", F.row_number().over(inner))
        placed = placed.join(self.offsets, (F.col("_mk_shard") == F.col("_mk_s")) & (F.col("_mk_part") == F.col("_mk_p")))
        return placed.withColumn("_mk_slot", (F.col("_mk_offset") + F.col("_mk_at") - 1).cast("long"))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot (gapless from 0 in each shard)."""
    own = measures(F.monotonically_increasing_id(), F.col(id_col), F.col(text_col))
    d = stash(docs.select(*[c.alias(k) for k, c in own.items()]))
    found = Plan(d, shards).slotted(d)
    return found.select(F.col("_mk_id").alias("doc_id"), F.col("_mk_size").alias("size"), F.col("_mk_tokens").alias("tokens"), F.col("_mk_crc").alias("text_crc32"), F.col("_mk_shard").alias("shard"), F.col("_mk_slot").alias("slot"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, then shard and slot (which replace columns of these names)."""
    doc_id, text = (F.col(f"_mk_{place(docs, c)}") for c in (id_col, text_col))
    own = measures(F.monotonically_increasing_id(), doc_id, text)
    keyed = stash(numbered(docs).withColumns(own))
    found = Plan(keyed.select(*own), shards).slotted(keyed)
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in ("shard", "slot")]
    return found.select(*[f"_mk_{i}" for i in keep], "_mk_shard", "_mk_slot").toDF(*[docs.columns[i] for i in keep], "shard", "slot")


def op8_vector_packed_shards(spark, sf_dir: str) -> DataFrame:
    found = assign(documents(spark, sf_dir), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
