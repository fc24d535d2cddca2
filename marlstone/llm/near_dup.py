"""Near-duplicates by SuperMinHash (Ertl 2017): signatures, banding, verification, union-find.

A text's set holds the distinct shingles of its words (A-Z lower-cased, runs of
anything but space and \\x09-\\x0D); a text with fewer words than a shingle has
its whole sequence as its one element; one without words has an empty set and
links with nothing. Texts link if their sets' Jaccard similarity reaches the
threshold, confirmed on the full sets; groups are the connected components.

Work stays linear in the size of a group: equal sets are one class from the
start; a bucket's members are first held against a few of its members (pivots),
and only buckets whose members are still in different components are compared
in full, in pairs of blocks of bounded size; there a pair is read in the first of the
buckets that it shares, and only if its signatures leave it possible (with sigmas None,
every pair that the sizes leave possible). A bucket of more than WIDE blocks is not
compared as such: its members are dealt out by the rarest shingles of each, so many that
two similar sets must share one of them (prefix filtering, which is exact), so that texts
that are all nearly but not quite similar meet only where they share something rare.

Nodes are classes of equal sets with numbers of their own, and a row is told apart by a
hash of its id and text, so that ids of any type may repeat or be null. A null id takes
part; component_id is the smallest id that is not null, and null where all are null; a row
is kept if its id is the component's. Rows of equal id and text are returned as often as
they come (``survivors`` keeps one of them). Null, empty and blank texts have an empty
set; a very long one is read whole, a chunk of its own. An empty table gives an empty
result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, documents, in_batches, numbered, place, stash
from .textkit import BASE, BLANKS, Words, chunks, mix, windows

#: Hash functions of a signature.
SLOTS = 100
#: Shingles of a bucket's members that are compared in full in one task: twice this at about.
BLOCK_SHINGLES = 300_000
#: Blocks of a bucket beyond which its members are dealt out by their rarest shingles; counters of how often shingles occur.
WIDE, COUNTERS = 32, 1 << 20
#: Of a pair at the threshold, so many standard deviations fewer slots may agree before it is left out unread.
SIGMAS = 5.0


def bands_for(threshold: float, slots: int = SLOTS, miss: float = 2e-5) -> int:
    """Rows of a band: the most that leave a pair at the threshold unseen with a probability under miss."""
    return max(r for r in (1, 2, 4, 5, 10) if (1 - threshold**r) ** (slots // r) < miss or r == 1)


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a set of 64-bit elements, as 64-bit values; two agree in a slot with the sets' similarity.

    Round j gives each element the slot at place j of its own random permutation,
    with the value j plus a fraction; once every slot is below the next round's
    values, later rounds can change nothing and are left out.
    """
    n = len(elements)
    best = np.full(slots, np.inf)
    order, rows, past = None, np.arange(n), []
    for j in range(slots):
        r = mix(elements ^ np.uint64((BASE * (2 * j + 1)) & ((1 << 64) - 1)))
        swap = (j + ((r & np.uint64(0xFFFFF)) * np.uint64(slots - j) >> np.uint64(20))).astype(np.int64)
        value = j + (r >> np.uint64(20)) * (1 / (1 << 44))
        if j == 0:
            slot = swap
            past = swap
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
                order[rows, past], order[:, 0] = 0, past
            slot = order[rows, swap]
            order[rows, swap] = order[:, j]
            order[:, j] = slot
        np.minimum.at(best, slot, value)
        if best.max() < j + 1:
            break
    return best.view(np.uint64)


def sets(column, shingle: int, cache: dict | None = None) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text."""
    cache = {} if cache is None else cache
    for lo, hi, data, at in chunks(column):
        words = Words(data, at, BLANKS, lower=True)
        h = words.hash(cache)
        grams, where = windows(h, words.text, shingle)
        ends = np.searchsorted(words.text[where], np.arange(hi - lo), "right")
        begin = 0
        for i in range(hi - lo):
            if words.counts[i] >= shingle:
                yield np.unique(grams[begin : ends[i]])
            elif words.counts[i]:
                few = h[words.first[i] : words.first[i + 1]]
                whole = np.uint64(len(few))
                for x in few:
                    whole = mix(np.array([whole * np.uint64(BASE) + x]))[0]
                yield np.array([whole])
            else:
                yield np.zeros(0, np.uint64)
            begin = ends[i]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """A hash of 120 bits of a row's id and text, in two longs."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("\x01")), F.lit("\x00"), F.coalesce(text, F.lit("\x01"))).cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def signatures(rows: DataFrame, shingle: int, band: int) -> DataFrame:
    """doc_id, k1, k2 of rows that have these and text, then n_shingles, two 64-bit fingerprints of the set, a key for each band, and a byte of each slot."""
    names = ["doc_id", "k1", "k2", "n_shingles", "fp1", "fp2", "bands", "sketch"]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        odd = np.arange(1, SLOTS // band + 1, dtype=np.uint64)
        for b in batches:
            sizes, one, two, keys, sketch = [], [], [], [], []
            for s in sets(b.column(3), shingle):
                sizes.append(len(s))
                one.append(np.add.reduce(mix(s)) if len(s) else np.uint64(0))
                two.append(np.add.reduce(mix(s ^ np.uint64(BASE))) if len(s) else np.uint64(0))
                if len(s):
                    sig, key = super_minhash(s).reshape(-1, band), odd
                    for k in range(band):
                        key = mix(key * np.uint64(BASE) + sig[:, k])
                    keys.append(key.view(np.int64))
                    sketch.append((mix(sig.ravel()) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    keys.append(np.zeros(0, np.int64))
                    sketch.append(b"")
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            found = [pa.array(sizes, pa.int64()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)], lists, pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], *found], names)

    return in_batches(rows.select("doc_id", "k1", "k2", "text"), run, schema)


def similar(x: np.ndarray, y: np.ndarray, percent: float) -> bool:
    """100 * size of the intersection >= percent * size of the union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            same = [similar(x, y, percent) for x, y in zip(sets(b.column(2), shingle), sets(b.column(3), shingle), strict=True)]
            keep = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return in_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def compared(members: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: float, sigmas: float | None = SIGMAS) -> DataFrame:
    """Edges that join the components (root) of each bucket (key): members in different ones are compared.

    A bucket is dealt out by blocks, and each pair of blocks is a group. Members known
    to be connected are not compared. With sigmas None no pair is left out on its
    signatures, only on its sets' sizes.
    """
    least = -1.0 if sigmas is None else SLOTS * percent / 100 - sigmas * (SLOTS * percent / 100 * (1 - percent / 100)) ** 0.5
    names = ("key", "lo", "hi", "node", "root", "block", "n_shingles")

    def group(t: pa.Table, cache: dict) -> list[tuple[int, int]]:
        key, lo, hi, ids, root, block, size = (t.column(n).to_numpy().copy() for n in names)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        at, known, edges = next(iter(np.flatnonzero(bands[0] == key[0]).tolist()), 0), {}, []  # 0: dealt by a shingle

        def of(i: int) -> np.ndarray:
            if i not in known:
                known[i] = next(sets(t.column("text").slice(i, 1), shingle, cache))
            return known[i]

        for i in range(1, len(ids)):
            j = np.flatnonzero(root[:i] != root[i])
            j = j if lo[0] == hi[0] else j[block[j] != block[i]]
            j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
            if len(j) and at:
                j = j[~(bands[j, :at] == bands[i, :at]).any(1)]  # else another bucket's pair
            if len(j):
                j = j[(sketch[j] == sketch[i]).sum(1) >= least]
            for k in j.tolist():
                if root[k] != root[i] and similar(of(i), of(k), percent):
                    root[root == root[k]] = root[i]
                    edges.append((int(ids[i]), int(ids[k])))
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch waits for the next batch."""
        np.seterr(over="ignore")
        cache: dict = {}
        rest: list[pa.RecordBatch] = []

        def edges(t: pa.Table, last: bool) -> tuple[list, list]:
            of = np.stack([t.column(n).to_numpy() for n in names[:3]], 1)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist(), *([len(of)] if last else [])]
            return [e for a, b in zip(cuts, cuts[1:], strict=False) if b > a + 1 for e in group(t.slice(a, b - a), cache)], t.slice(cuts[-1]).combine_chunks().to_batches()

        out: list[tuple[int, int]] = []
        for b in batches:
            found, rest = edges(pa.Table.from_batches([*rest, b]), last=False)
            out += found
        if rest:
            out += edges(pa.Table.from_batches(rest), last=True)[0]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    known = classes.select("node", "n_shingles", "bands", "sketch").join(members.select("node").distinct(), "node", "left_semi")
    rows = members.join(known.select("node", "n_shingles"), "node")
    size = rows.groupBy("key").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = rows.join(size, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = dealt.join(known, "node").join(texts, "node")
    full = full.select(*names, "bands", "sketch", "text").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return in_batches(full, run, "a long, b long")


def prefixed(texts: DataFrame, shingle: int, percent: float) -> DataFrame:
    """node, key: the rarest shingles of each set, as many as it takes for two similar sets to share one.

    The order needs no exact counts, only to be the same everywhere: shingles are ordered
    by a table of COUNTERS sums, whose size doesn't depend on the data, and by their hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for s in sets(b.column(0), shingle):
                n += np.bincount((s & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["at", "n"])

    often = np.zeros(COUNTERS, np.int64)
    for r in in_batches(texts.select("text"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        often[r.at] = r.n
    rank = often.argsort(kind="stable").argsort(kind="stable").astype(np.int32)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            nodes, keys = [], []
            for node, s in zip(b.column(0).to_pylist(), sets(b.column(1), shingle), strict=True):
                k = len(s) - -int(-percent * len(s) // 100) + 1
                first = s[np.lexsort((s, rank[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))][:k]
                nodes.append(np.full(len(first), node))
                keys.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (nodes, keys)], ["node", "key"])

    return in_batches(texts.select("node", "text"), rarest, "node long, key long")


def narrowed(rest: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: float, wide: int) -> DataFrame:
    """rest (key, node, root) with the buckets of more than wide blocks dealt out anew, by rare shingles that more than one member has."""
    sizes = rest.join(classes.select("node", "n_shingles"), "node").groupBy("key").agg(F.sum("n_shingles").alias("n"))
    large = stash(sizes.where(F.col("n") > wide * BLOCK_SHINGLES).select("key"))
    if large.isEmpty():
        return rest
    members = stash(rest.join(large, "key", "left_semi").select("node", "root").distinct())
    keys = stash(prefixed(texts.join(members.select("node"), "node", "left_semi"), shingle, percent))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    anew = keys.join(shared, "key", "left_semi").join(members, "node").select("key", "node", "root")
    return stash(rest.join(large, "key", "left_anti").select("key", "node", "root").union(anew))


def joined_roots(edges: DataFrame) -> DataFrame:
    return stash(components(edges).withColumnsRenamed({"root": "top"}))


def linked(classes: DataFrame, rows: DataFrame, shingle: int, percent: float, sigmas: float | None, wide: int = WIDE) -> DataFrame:
    """node, root of every class that links with another. Each round works on the components that the last one left."""
    keys = classes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    members = stash(keys.join(buckets, "key").select("key", "node", "lo", "hi"))
    wanted = classes.select("node", F.col("picked.k1").alias("k1"), F.col("picked.k2").alias("k2")).join(members.select("node").distinct(), "node", "left_semi")
    texts = stash(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]))

    def against(pairs: DataFrame) -> DataFrame:
        return stash(confirmed(pairs.where("a <> b").distinct(), texts, shingle, percent))

    edges = against(members.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")))
    roots = joined_roots(edges).select("node", F.col("top").alias("root"))
    for full_check in (False, True):
        placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        still = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        rest = stash(placed.join(still, "key", "left_semi"))
        if rest.isEmpty():
            break
        if full_check:
            more = stash(compared(narrowed(rest, classes, texts, shingle, percent, wide), classes, texts, shingle, percent, sigmas))
        else:  # the member with the most links is the likeliest centre of its bucket
            degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
            hubs = rest.join(degree, "node", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("links", F.lit(0)), "node")).getField("node").alias("b"), F.max(F.struct(F.col("node") == F.col("root"), F.xxhash64("node"), F.col("node"))).getField("node").alias("c"))
            more = against(rest.join(hubs, "key").select(F.col("node").alias("a"), F.explode(F.array("b", "c")).alias("b")))
        # the new links join components, of which there are few: they alone are walked again
        top = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        lifted = more.join(top("a"), "a", "left").join(top("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
        tops = joined_roots(lifted)
        moved = roots.join(tops.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        fresh = tops.join(roots.select("node"), "node", "left_anti").select("node", F.col("top").alias("root"))
        roots = stash(moved.union(fresh))
    return roots


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, sigmas: float | None) -> tuple[DataFrame, DataFrame]:
    """The rows as doc_id, k1, k2 and text; and each row's doc_id, k1, k2, n_shingles, root (null without a set) and component_id."""
    percent, band = round(threshold * 100, 6), bands_for(threshold)
    key = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), key[0].alias("k1"), key[1].alias("k2"), F.col(text_col).alias("text"))
    sig = stash(signatures(rows, shingle, band))
    full = sig.where("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles")
    classes = full.agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("picked"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()))
    roots = linked(classes, rows, shingle, percent, sigmas)
    named = stash(classes.select("node", "fp1", "fp2", "n_shingles", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp1", "fp2", F.col("n_shingles").alias("n"), "root", "component_id")
    found = sig.join(named, (sig.fp1 == named.fp1) & (sig.fp2 == named.fp2) & (sig.n_shingles == named.n), "left")
    component = F.when(named.root.isNull(), sig.doc_id).otherwise(named.component_id)
    return rows, found.select(sig.doc_id, sig.k1, sig.k2, sig.n_shingles, named.root, component.alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, sigmas: float | None = SIGMAS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id the document reaches), kept (it is that document)."""
    found = grouped(docs, id_col, text_col, shingle, threshold, sigmas)[1]
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, sigmas: float | None = SIGMAS) -> DataFrame:
    """The rows of docs, with all their columns, without near-duplicates: of each group the one of the smallest id (a null one only without others), of rows of equal id and text one."""
    found = stash(grouped(docs, id_col, text_col, shingle, threshold, sigmas)[1])
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("k1").alias("k1"), F.col("k2").alias("k2"))
    first = found.where("root is not null").groupBy("root").agg(F.min(rank).alias("r")).select(F.col("r.k1").alias("_mk_k1"), F.col("r.k2").alias("_mk_k2"))
    kept = first.union(found.where("root is null").select("k1", "k2").distinct())
    key = row_key(F.col(f"_mk_{place(docs, id_col)}"), F.col(f"_mk_{place(docs, text_col)}"))
    keyed = numbered(docs).withColumns({"_mk_k1": key[0], "_mk_k2": key[1]})
    out = keyed.dropDuplicates(["_mk_k1", "_mk_k2"]).join(kept, ["_mk_k1", "_mk_k2"], "left_semi")  # copies of a row meet before the shuffle
    return out.select(*[f"_mk_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op10_superminhash_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=3, threshold=0.85)
