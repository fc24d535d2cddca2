"""Hard negatives by inner product, over an index of one-dimensional distance keys.

A vector x gets one more component, sqrt(M**2 - |x|**2) with M the largest norm, an anchor
a zero: all vectors then lie on one sphere, and the higher the inner product of x with the
anchor, the smaller their distance. Pivots are the means of a bounded sample. The index
holds each vector under (its nearest pivot, the distance to it), sorted and cut into pages
of at most PAGE rows. A row at key k is at least |d - k| from an anchor that is d from the
pivot, so that a search within radius r reads the pages whose keys meet [d - r, d + r]. Each
round widens the radius by the best rows found so far and reads the pages of the new annuli
only; it ends when no unread page can hold a better row. Scores are integers and exact.

Anchors' positives are their first rows of the same label, a search without bounds of score.
Their negatives are a search of other labels with a band of scores a positive, whose
nearest and farthest useful distance follow from the band.

Anchors travel in blocks to shards of consecutive pages; a shard's task keeps its pages and
one block at a time, and gives the best few rows of each anchor. Which pages a block needs
is decided on their key ranges. Pages are sent once a slab of SLAB blocks.

Rows with a null id, label, vector, or a null or non-finite component take no part; vectors
of different length are compared as if the shorter ended in zeros, and an empty vector is
one of zeros. Rows that repeat an id are rows of their own, an anchor is only not its own
positive; ties go by id. An empty table, no anchor, no positive or no row within a band
gives no row. Where squared norms reach 2**51, scores are computed with whole numbers of any
size (slowly); vectors whose squared norm reaches 2**62 take no part, as their scores need
not fit a long. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_batches, numbered, place, stash

#: Rows of a page: a power of two, as a score and a place in a page share one number.
PAGE = 2048
#: Anchors of a block; blocks of a slab.
BLOCK, SLAB = 256, 64
#: Rows of the sample that pivots and first radii come from; pivots at most.
SAMPLE, PIVOTS = 4096, 32
#: Share of the sample's bound that the first round reads.
FIRST = 0.85
EXACT, LOWEST = 1 << 51, -(1 << 62)
#: Squared norms under this leave every score within a long.
LIMIT = float(1 << 62)

ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS "rank", s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


def integers(column, scale: float) -> list[np.ndarray]:
    return [np.floor(scale * np.asarray(x, np.float64)) for x in column.to_pylist()]


def stacked(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Space:
    """What all tasks know: the width, the largest squared norm, the pivots, the sample."""

    def __init__(self, width: int, most: int, largest: float):
        self.width, self.most = width, most
        self.kind = np.dtype("i2" if largest < 1 << 15 else "i4" if largest < 1 << 31 else "f8")
        self.exact = most < EXACT  # else whole numbers of any size
        self.slack = 1e-6 * (1 + float(most) ** 0.5)
        self.end = 2 * float(most) ** 0.5 + 2 * self.slack

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, float(self.most) - (x * x).sum(1))
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def with_sample(self, ids, labels, x: np.ndarray) -> Space:
        self.ids, self.labels, self.sample = ids, labels, x
        lifted, r = self.lifted(x), np.random.default_rng(5)
        n = max(1, min(PIVOTS, len(x) // 64))
        self.pivots = lifted[r.permutation(len(x))[:n]]
        for _ in range(8):
            home = distances(lifted, self.pivots).argmin(1)
            self.pivots = np.stack([lifted[home == i].mean(0) if (home == i).any() else p for i, p in enumerate(self.pivots)])
        return self

    def pack(self, x: np.ndarray) -> bytes:
        return x.astype(self.kind).tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.width).astype(np.float64)

    def scores(self, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (a @ x.T).astype(np.int64)
        whole = np.vectorize(int, otypes=[object])
        return whole(a).dot(whole(x).T) if a.size and x.size else np.zeros((len(a), len(x)), object)

    def far(self, norms: np.ndarray, scores) -> np.ndarray:
        """The distance that a score means to an anchor of a squared norm."""
        return np.sqrt(np.maximum(0.0, norms + float(self.most) - 2.0 * np.asarray(scores, np.float64)))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


def usable(rows: DataFrame, scale: float) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + F.pow(x.cast("double") * scale, 2))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).where(square < LIMIT)


def space(rows: DataFrame, scale: float) -> Space | None:
    """The space of the rows (vec_id, label, embedding); None where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = integers(batch["embedding"], scale)
            if found:
                square = max(sum(int(c) ** 2 for c in v) if len(v) and np.abs(v).max() >= 1 << 20 else int(v @ v) for v in found)
                yield pa.RecordBatch.from_pydict({"width": [max(map(len, found))], "square": [str(square)], "largest": [max([float(np.abs(v).max(initial=0)) for v in found])]})

    met = in_batches(rows.select("embedding"), run, "width long, square string, largest double")
    one = met.agg(F.max("width").alias("width"), F.max("largest").alias("largest"), F.max(F.struct(F.length("square"), "square")).alias("square")).first()
    if one.width is None:
        return None
    known = Space(max(1, one.width), int(one.square["square"]), one.largest)
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(29)), "vec_id", "label").limit(SAMPLE).toArrow()
    return known.with_sample(np.array(some["vec_id"].to_pylist(), np.int64), np.array(some["label"].to_pylist(), np.int64), stacked(integers(some["embedding"], scale), known.width))


PAGES = "shard long, page long, pivot int, low double, high double, size int, anchors int, ids binary, rows binary, labels binary, chosen binary, codes binary"


def index(rows: DataFrame, known: Space, scale: float, shard_rows: int) -> DataFrame:
    """The written pages, sorted by (pivot, distance). rows: vec_id, label, embedding, chosen (an anchor)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = stacked(integers(batch["embedding"], scale), known.width)
            far = distances(known.lifted(x), known.pivots)
            home = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["vec_id"], batch["label"], batch["chosen"], pa.array(home, pa.int32()), pa.array(far[np.arange(len(x)), home]), pa.array([known.pack(v) for v in x], pa.binary())],
                ["row", "vec_id", "label", "chosen", "pivot", "key", "code"],
            )

    numbers = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), "chosen", "embedding")
    keys = in_batches(numbers, keyed, "row long, vec_id long, label long, chosen boolean, pivot int, key double, code binary")
    ranged = keys.repartitionByRange("pivot", "key", "row").sortWithinPartitions("pivot", "key", "row").withColumn("task", F.spark_partition_id())

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, shard, filled, held = 0, 0, 0, []

        def out() -> pa.RecordBatch:
            nonlocal page, shard, filled, held
            order = sorted(range(len(held)), key=lambda i: held[i]["vec_id"])  # ties of a score go by place, then
            kept = [held[i] for i in order]
            at = kept[0]["task"] << 32
            made = {"shard": [at | shard], "page": [at | page], "pivot": [kept[0]["pivot"]], "low": [min(x["key"] for x in kept)], "high": [max(x["key"] for x in kept)], "size": [len(kept)], "anchors": [sum(x["chosen"] for x in kept)]}
            made |= {name: [np.array([x[of] for x in kept], np.int64).tobytes()] for name, of in (("ids", "vec_id"), ("rows", "row"), ("labels", "label"))}
            made |= {"chosen": [np.array([x["chosen"] for x in kept], np.bool_).tobytes()], "codes": [b"".join(x["code"] for x in kept)]}
            page, filled, held = page + 1, filled + len(kept), []
            if filled >= shard_rows:
                shard, filled = shard + 1, 0
            return pa.RecordBatch.from_pydict(made, SCHEMA)

        for batch in batches:
            for x in batch.to_pylist():
                if held and (len(held) == PAGE or held[0]["pivot"] != x["pivot"]):
                    yield out()
                held.append(x)
        if held:
            yield out()

    pages = stash(in_batches(ranged, paged, PAGES))
    size = pages.agg((F.max(F.shiftright("page", 32)) + 1).alias("tasks"), F.sum("size").alias("rows")).first()
    together = max(1, shard_rows * size.tasks // size.rows)  # tasks of few rows share a shard
    return pages.withColumn("shard", F.floor(F.shiftright("shard", 32) / together)) if together > 1 else pages


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
SCHEMA = pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in PAGES.split(", ")])
ANCHORS = "anchor long, vec_id long, label long, pivot int, key double, code binary, norm double, before double, radius double, highs array<long>, lows array<long>"


def anchors_of(pages: DataFrame, known: Space, want: int) -> DataFrame:
    """The anchors of the pages, each with the radius within which the sample has `want` rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                chosen = np.frombuffer(x["chosen"], np.bool_)
                ids, labels, rows = (np.frombuffer(x[c], np.int64)[chosen] for c in ("ids", "labels", "rows"))
                a = known.unpack(x["codes"])[chosen]
                if not len(ids):
                    continue
                norm = (a * a).sum(1)
                near = np.sort(known.far(norm[:, None], np.where((known.labels == labels[:, None]) & (known.ids != ids[:, None]), (a @ known.sample.T), -np.inf)), 1)
                bound = near[:, want - 1] if near.shape[1] >= want else np.full(len(ids), np.inf)
                n, far = len(ids), distances(np.concatenate([a, np.zeros((len(a), 1))], 1), known.pivots)
                yield pa.RecordBatch.from_pydict({
                    "anchor": rows, "vec_id": ids, "label": labels, "pivot": far.argmin(1).astype(np.int32), "key": far.min(1), "code": [known.pack(v) for v in a], "norm": norm,
                    "before": np.full(n, -1.0), "radius": np.where(np.isfinite(bound), FIRST * bound, known.end), "highs": [[1 << 62]] * n, "lows": [[-(1 << 62)]] * n,
                })

    return in_batches(pages.where("anchors > 0").select("ids", "labels", "rows", "chosen", "codes"), run, ANCHORS)


def packed(anchors: DataFrame, known: Space) -> DataFrame:
    """Blocks of neighbouring anchors, with the key interval that each needs of every pivot."""
    sorted_ = anchors.repartitionByRange("pivot", "key", "anchor").sortWithinPartitions("pivot", "key", "anchor").withColumn("task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, n
            a = known.unpack(b"".join(x["code"] for x in held))
            far = distances(np.concatenate([a, np.zeros((len(a), 1))], 1), known.pivots)
            radius = np.array([x["radius"] for x in held])[:, None] + known.slack
            spans = [{"pivot": i, "low": float(x), "high": float(y)} for i, (x, y) in enumerate(zip((far - radius).min(0), (far + radius).max(0), strict=True))]
            flat = {c: np.array([x[c] for x in held], np.float64).tobytes() for c in ("before", "radius")} | {c: np.array([x[c] for x in held], np.int64).tobytes() for c in ("highs", "lows", "anchor", "label")}
            made = pa.RecordBatch.from_pylist([{"block": held[0]["task"] << 32 | n, "spans": spans, "codes": b"".join(x["code"] for x in held), **flat}], BLOCKS)
            held, n = [], n + 1
            return made

        for batch in batches:
            for x in batch.to_pylist():
                held.append(x)
                if len(held) == BLOCK:
                    yield out()
        if held:
            yield out()

    return stash(in_batches(sorted_, run, "block long, spans array<struct<pivot:int,low:double,high:double>>, codes binary, before binary, radius binary, highs binary, lows binary, anchor binary, label binary"))


BLOCKS = pa.schema([("block", pa.int64()), ("spans", pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))), *[(x, pa.binary()) for x in ("codes", "before", "radius", "highs", "lows", "anchor", "label")]])


def scan(pages: DataFrame, blocks: DataFrame, known: Space, want: int, same: bool) -> DataFrame:
    """The first `want` rows of each anchor and band among the pages that its annulus meets and its last one didn't: anchor, band, score, vec_id."""
    slabs = max(1, -(-blocks.count() // SLAB))
    spans = blocks.select("block", F.inline("spans"))
    runs = pages.groupBy("shard", "pivot").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    needs = spans.join(runs.withColumnRenamed("pivot", "_pivot"), F.expr("pivot = _pivot AND low <= _high AND high >= _low")).select("shard", "block").distinct()
    slab = F.pmod(F.xxhash64("block"), F.lit(slabs)).cast("int")
    sent = needs.join(blocks.drop("spans"), "block").select("shard", slab.alias("slab"), F.col("block").alias("page"), *[c for c in BLOCKS.names if c not in ("block", "spans")])
    copies = pages.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).select("shard", "slab", "page", "pivot", "low", "high", "ids", "rows", "labels", F.col("codes").alias("page_codes"))
    both = copies.unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition("shard", "slab").sortWithinPartitions("shard", "slab", F.col("ids").isNull(), "page")

    def best(block: dict, held: list[dict]) -> list[tuple]:
        a, at = known.unpack(block["codes"]), np.frombuffer(block["anchor"], np.int64)
        label, before, radius = np.frombuffer(block["label"], np.int64), *(np.frombuffer(block[c]) for c in ("before", "radius"))
        highs, lows = (np.frombuffer(block[c], np.int64).reshape(len(a), -1) for c in ("highs", "lows"))
        norm = (a * a).sum(1)
        far = distances(np.concatenate([a, np.zeros((len(a), 1))], 1), known.pivots)
        start = known.far(norm, np.where(highs >= lows, highs, -(1 << 62)).max(1)) if not same else np.zeros(len(a))
        found: list[list[tuple]] = [[] for _ in range(highs.shape[1])]
        limit = np.full(highs.shape, LOWEST, np.int64 if known.exact else object)
        for page in held:
            d = far[:, page["pivot"]]
            gap = np.maximum(np.maximum(page["low"] - d, d - page["high"]), 0)  # no row of the page is nearer
            now = (gap <= radius + known.slack) & ~((gap <= before + known.slack) & (before >= 0)) & (d + page["high"] + known.slack >= start)
            some = np.flatnonzero(now)
            if not len(some):
                continue
            ids, rows, labels, x = page["made"]
            score = known.scores(a[some], x)
            right = (labels == label[some][:, None]) == same
            if same:
                right &= rows != at[some][:, None]
            order = score * PAGE + np.arange(PAGE - 1, PAGE - 1 - len(ids), -1)  # the score first, then the smaller id
            for band in range(highs.shape[1]):
                ok = right & (order > limit[some, band][:, None])
                if not same:
                    ok &= (score <= highs[some, band][:, None]) & (score >= lows[some, band][:, None])
                i, j = np.nonzero(ok)
                if not len(i):
                    continue
                value = order[i, j]
                sort = np.lexsort((-value, i)) if known.exact else np.array(sorted(range(len(i)), key=lambda n: (i[n], -value[n])))
                i, j, value = i[sort], j[sort], value[sort]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                first = nth < want
                found[band] += [(int(at[some[p]]), band, int(score[p, q]), int(ids[q])) for p, q in zip(i[first], j[first], strict=True)]
                full = nth == want - 1
                # rows of a later page with this very score may have a smaller id: they pass, too
                limit[some[i[full]], band] = np.maximum(limit[some[i[full]], band], value[full] // PAGE * PAGE - 1)
        out = []
        for rows_ in found:
            rows_.sort(key=lambda r: (r[0], -r[2], r[3]))
            n, last = 0, None
            for r in rows_:
                n, last = (n + 1, last) if r[0] == last else (1, r[0])
                if n <= want:
                    out.append(r)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if key != (x["shard"], x["slab"]):
                    key, held = (x["shard"], x["slab"]), []
                if x["ids"] is not None:
                    x["made"] = (*(np.frombuffer(x[c], np.int64) for c in ("ids", "rows", "labels")), known.unpack(x["page_codes"]))
                    held.append(x)
                elif rows := best(x, held):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "band", "score", "vec_id"])

    return in_batches(dealt, run, "anchor long, band int, score long, vec_id long")


def search(pages: DataFrame, anchors: DataFrame, known: Space, want: int, same: bool) -> DataFrame:
    """The first `want` rows of each anchor and band: anchor, band, nth, score, vec_id. Radii grow until each anchor is certified."""
    found = None
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id")
    square = float(known.most)

    def far(score):
        return F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + square - 2 * score))

    while True:
        blocks = packed(anchors, known)
        new = scan(pages, blocks, known, want, same)
        if found is not None:
            new = new.unionByName(found.drop("nth"))
        found = stash(new.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= want))
        kth = found.where(F.col("nth") == want).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("band", F.col("score").cast("double")))).alias("kth"))
        # how far each band still has to be read: to its last row, else to its end
        bands = F.transform(F.arrays_zip("highs", "lows"), lambda b, i: F.when(b["highs"] < b["lows"], F.lit(-1.0)).otherwise(F.least(F.coalesce(far(F.try_element_at("kth", i)), F.lit(known.end)), far(b["lows"]), F.lit(known.end))))
        state = anchors.join(kth, "anchor", "left").withColumn("need", F.array_max(bands)).drop("kth")
        open_ = stash(state.where((F.col("need") > F.col("radius")) & (F.col("radius") < known.end)).withColumn("before", F.col("radius")).withColumn("radius", F.col("need")).drop("need"))
        if open_.isEmpty():
            return found
        anchors = open_


def banded(anchors: DataFrame, positives: DataFrame, known: Space, count: int, want: int, low: int, high: int) -> DataFrame:
    """The anchors with a band of scores for each positive, and a first radius by the sample."""
    each = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                given = [y["score"] for y in x.pop("given")]
                highs = [high * p // 100 for p in given] + [-1] * (count - len(given))
                lows = [-(-low * p // 100) for p in given] + [1] * (count - len(given))
                a, norm = known.unpack(x["code"]), np.array([x["norm"]])
                score = np.sort((a @ known.sample[known.labels != x["label"]].T)[0])[::-1]
                needs, starts = [], []
                for h, w in zip(highs, lows, strict=True):
                    if h < w:
                        continue
                    inside = score[(score <= h) & (score >= w)]
                    starts.append(float(known.far(norm, h)[0]))
                    needs.append(float(known.far(norm, inside[want - 1] if len(inside) >= want else w)[0]))
                if needs:
                    radius = min(starts) + FIRST * (max(needs) - min(starts))
                    out.append(x | {"before": -1.0, "radius": min(radius, known.end), "highs": highs, "lows": lows})
            yield pa.RecordBatch.from_pylist(out, WITH_BANDS)

    return in_batches(anchors.join(each, "anchor"), run, ANCHORS)


WITH_BANDS = pa.schema([(x.split()[0], KINDS.get(x.split()[1], pa.list_(pa.int64()))) for x in ANCHORS.split(", ")])


def mine(vectors: DataFrame, chosen: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    Anchors are the rows that `chosen` says. An anchor's positives are its first rows of
    the same label; a positive's negatives the first rows of other labels whose score is
    between low and high percent of the positive's.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale).withColumn("chosen", F.coalesce(chosen, F.lit(False))).select("vec_id", "label", "embedding", "chosen")
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    known = space(rows.select("vec_id", "label", "embedding"), scale)
    if known is None:
        return spark.createDataFrame([], names)
    pages = index(rows, known, scale, max(4096, min(65536, rows.count() // 64)))
    anchors = stash(anchors_of(pages, known, positives))
    near = search(pages, anchors, known, positives, True)
    bands = stash(banded(anchors, near, known, positives, negatives, low, high))
    hard = search(pages, bands, known, negatives, False).select("anchor", F.col("band").alias("_band"), F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", (F.col("nth") - 1).alias("_band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    of = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return hard.join(pairs, ["anchor", "_band"]).join(of, "anchor").select([F.col(x.split()[0]).cast(x.split()[1]) for x in names.split(", ")])


def vectors_of(df: DataFrame) -> DataFrame:
    """vec_id, embedding and label of a table, whatever else it has."""
    rows = numbered(df)
    return rows.select([F.col(rows.columns[place(df, c)]).alias(c) for c in ("vec_id", "embedding", "label")])


def op13_distance_key_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 50 == 0)
