"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A hash rolls over the seven bytes before each place of the UTF-8 text; where it falls under
2**(32 - k), a chunk ends (about every 2**k bytes: the block size). k is the smallest for
which the text's length lets expect at most MOST chunks, lessened while there are under a
quarter of MOST. A chunk gives a symbol of twelve bits, written as two letters. The
fingerprint `k:symbols:symbols` has the chunks of block sizes 2**k and 2**(k + 1), 2 * MOST
and MOST at most: in texts that repeat themselves the last chunk is all that is left. Two
fingerprints compare where they have a block size in common: the likeness is
1 - d / (m + n) for signatures of m and n symbols and d insertions and deletions between
them, and 0 where no block size is common.

A null text counts as the empty one, whose fingerprint is `0::`; two empty texts are alike by
1, an empty and another one by 0. Very long texts are read whole, in blocks of a mebibyte.
Documents follow each other by doc_id, null ids last; rows of one id follow by a hash of
their texts, and rows repeated in id and text by no stated order (their rows of the result
are the same in any). The last document is followed by the first, a single one by itself.
An empty table gives an empty result. Columns other than doc_id and text, whatever their
names, are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, numbered, place, stash

#: Chunks that a text's length lets expect, at most.
MOST = 64
#: Bytes that the rolling hash looks back on, the place's own included.
LOOK = 7
FACTOR, SPREAD, MASK = 0x6F4F2A35, 0x9E3779B1, 0xFFFFFFFF
BLOCK = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SYMBOLS = [x + y for x in LETTERS for y in LETTERS]

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolled(data: bytes, start: int, end: int) -> np.ndarray:
    """The rolling hash at the places start to end of data."""
    before = max(0, start - LOOK + 1)
    part = np.frombuffer(data, np.uint8, end - before, before).astype(np.uint32)
    part = np.concatenate([np.zeros(LOOK - 1 - (start - before), np.uint32), part])
    n, total = end - start, np.zeros(end - start, np.uint32)
    for j in range(LOOK):  # Horner's rule from the oldest byte on; arithmetic is modulo 2**32
        total = total * np.uint32(FACTOR) + part[j : j + n] + np.uint32(1)
    return total * np.uint32(SPREAD)


def ends(data: bytes, k: int) -> tuple[list[int], list[int]]:
    """The places after which chunks end at block sizes 2**k and 2**(k + 1): the first 2 * MOST - 1 and MOST - 1."""
    fine, wide = [], []
    for start in range(0, len(data), BLOCK):
        v = rolled(data, start, min(len(data), start + BLOCK))
        low = np.flatnonzero(v <= MASK >> k)
        fine += (low[: 2 * MOST - 1 - len(fine)] + start + 1).tolist()
        wide += (low[v[low] <= MASK >> k + 1][: MOST - 1 - len(wide)] + start + 1).tolist()
        if len(fine) == 2 * MOST - 1 and len(wide) == MOST - 1:
            break
    return fine, wide


def symbols(data: bytes, places: list[int]) -> str:
    """Two letters for each chunk of data between places; what is left after the last is a chunk, too."""
    whole, start, out = memoryview(data), 0, []
    for end in places if places and places[-1] == len(data) else [*places, len(data)]:
        out.append(SYMBOLS[(zlib.crc32(whole[start:end]) * SPREAD & MASK) >> 20])
        start = end
    return "".join(out) if data else ""


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    k = max(0, (len(data) - 1) // MOST).bit_length()
    fine, wide = ends(data, k)
    while k and len(fine) < MOST // 4:
        k -= 1
        fine, wide = ends(data, k)
    return f"{k}:{symbols(data, fine)}:{symbols(data, wide)}"


def common(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, a bit of one number for each place of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def likeness(one: str, two: str) -> float:
    """How alike two fingerprints are, 0 to 1."""
    if one == two:
        return 1.0
    (k, *a), (j, *b) = ((int(x[0]), *x[1:]) for x in (one.split(":"), two.split(":")))
    if abs(k - j) > 1:
        return 0.0
    a, b = a[max(0, j - k)], b[max(0, k - j)]
    a, b = ([x[i : i + 2] for i in range(0, len(x), 2)] for x in (a, b))
    return 2 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def judged(text: str, own: str, following: str, its: str) -> tuple:
    new = edited(text, following)
    print_ = fingerprint(new)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), own, print_, likeness(own, print_), likeness(own, its)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each document."""
    rows = numbered(docs)
    named = rows.select(rows.columns[place(docs, "doc_id")], rows.columns[place(docs, "text")]).toDF("doc_id", "text")
    kinds = f"doc_id {named.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in texts], pa.int64()), pa.array([fingerprint(x) for x in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return in_batches(named, run, kinds)


def beside_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document.

    The texts are sorted once, by ranges; a task meets each document's successor as its
    next row. The first and the last document of each task are written with their texts
    and meet in a second step, a pair for each task.
    """
    rows = numbered(docs)
    named = rows.select(rows.columns[place(docs, "doc_id")], rows.columns[place(docs, "text")]).toDF("doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("_row").asc()]
    ranged = named.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("task"))
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(x, pa.string()) for x in names[2:5]], *[(x, pa.float64()) for x in names[5:]], ("task", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, task = None, None
        for batch in batches:
            out = []
            for doc_id, text, at in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["task"].to_pylist(), strict=True):
                text = text or ""
                own = fingerprint(text)
                if last is None:
                    task = at
                    out.append((doc_id, None, None, own, None, None, None, task, "first", text))
                else:
                    out.append((last[0], *judged(last[1], last[2], text, own), task, None, None))
                last = (doc_id, text, own)
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in out], kinds)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, (last[0], None, None, last[2], None, None, None, task, "last", last[1]), strict=True))], kinds)

    found = stash(in_batches(ranged, run, f"{RESULT}, task int, edge string, text string"))
    tasks = sorted(x.task for x in found.where("edge = 'first'").select("task").collect())  # as many as the sort has tasks
    follows = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, following int")
    lasts = found.where("edge = 'last'").select("doc_id", "text", "fingerprint", "task").join(follows, "task")
    firsts = found.where("edge = 'first'").select(F.col("task").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(x["doc_id"], *judged(x["text"], x["fingerprint"], x["next_text"], x["next_print"])) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([kinds.field(x) for x in names]))

    met = in_batches(lasts.join(firsts, "following"), meet, RESULT)
    return found.where("edge IS NULL").select(*names).union(met)


def op11_context_triggered_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(documents(spark, sf_dir))
