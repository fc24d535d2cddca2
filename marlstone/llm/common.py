"""What the operators share: the shared folder, written tables, prefix sums, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a batch of rows to Python.
BATCH_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster has to name one, as no other folder is seen by all its machines."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: lineage ends here, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner removes it
            return


def place(df: DataFrame, name: str) -> int:
    """The place of a column: the first of that name, else the first that differs in case only."""
    low = [c.lower() for c in df.columns]
    return df.columns.index(name) if name in df.columns else low.index(name.lower())


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as no column of df has them, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by their places (_mk_0, _mk_1, ...), whatever they were called."""
    return df.toDF(*[f"_mk_{i}" for i in range(len(df.columns))])


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of BATCH_BYTES at about, unless the session says otherwise: a batch of thousands of long texts would stand in the JVM and in Python at once."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text has remainder 1 by 3; an id of null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value up to and with the row, in the order of (bucket, order) in each key.

    No task holds a whole key: the window runs in (key, bucket), and the buckets'
    totals, a row each, give the offsets. bucket has to be non-decreasing in the order.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])], F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_offset"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, bucket])]
    return df.withColumn("_in", F.sum(value).over(inner)).join(offsets, on).withColumn(name, F.col("_in") + F.col("_offset")).drop("_in", "_offset", *[f"_k{i}" for i in range(len(keys) + 1)])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node it reaches.

    Alternates the large-star and small-star steps of the public MapReduce
    algorithm; minima are combined before the shuffle, and the joins back are
    equi-joins that AQE splits where one node has very many edges.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    before = None
    for _ in range(most):
        both = e.select("v", "m").union(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("least"))
        large = both.where("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m")).distinct()
        down = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(down, "v").select(F.col("m").alias("v"), F.col("least").alias("m")).where("v <> m").union(down.select("v", F.col("least").alias("m"))).distinct()
        e = stash(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    return e.groupBy("v").agg(F.min("m").alias("root")).select(F.col("v").alias("node"), "root").union(e.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column | None = None, columns=("doc_id", "text"), most_bytes: int = 1 << 20) -> DataFrame:
    """At most per_class documents of label 0 and of label 1, the first by a hash of the id, with y (the label).

    The ids are chosen on the labels alone; they are few (2 * per_class), so that they
    can be sent to every task and the documents are read once. A text over most_bytes is
    not learned from. An id with both labels counts as 1; of the rows of an id the one
    with the least text (then the least other columns) is learned from, so that the
    sample has at most 2 * per_class rows however often an id repeats.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.where(where) if where is not None else known
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    picked = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]).withColumnRenamed("doc_id", "_id"))
    names = list(dict.fromkeys(("doc_id", *columns)))
    rows = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).select(*names).join(ids, F.col("doc_id") == F.col("_id"))
    rest = ["text", *[c for c in names if c not in ("doc_id", "text")]]
    one = rows.groupBy("_id", "y").agg(F.min(F.struct("doc_id", *rest)).alias("_row"))
    return one.select(*[F.col(f"_row.{c}").alias(c) for c in names], "y")


def rolled_sample(docs: DataFrame, about: int, total: int, seed: int) -> DataFrame:
    """About so many of docs' total rows, by a hash of id and text: equal ones count once, and there are never more than twice as many."""
    text = F.xxhash64("text")
    roll = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1 << 30))
    some = docs.withColumns({"_mk_roll": roll, "_mk_hash": text}).where(F.col("_mk_roll") < F.lit(int(min(1.0, about / max(1, total)) * (1 << 30))))
    return some.dropDuplicates(["doc_id", "_mk_hash"]).orderBy("_mk_roll", "doc_id").limit(2 * about).drop("_mk_roll", "_mk_hash")
