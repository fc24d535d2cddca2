"""Language by nearest centroid: TF-IDF vectors of letter n-grams, several centroids a language, cosine.

Letters are lower-cased; every run of anything else is one boundary mark. N-grams of
one to three places are hashed into DIM dimensions, weighted by log(1 + count) times
the inverse document frequency, which is counted over all documents that may be
learned from, and normalised. The centroids of a language are those of spherical
k-means on a bounded sample of its documents. A document is as far from a language
as from its nearest centroid; beyond the language's radius (learned from the
sample's own distances) the prediction is marked as rejected.

A text that is null, empty or without a letter is ``und`` with score 0, and so is every
text if nothing can be learned; very long texts are read whole, in a block of their own;
repeated rows are returned as often as they come and learned from once; null ids stay null
and count as the empty text in the split; of equally near centroids the first in the
languages' order counts; an empty table gives an empty result; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, held_out, in_batches
from .textkit import CHUNK_BYTES

DIM = 4096
#: Centroids of a language; documents that they are fitted on, over all languages, and of each language at least; languages at most; rows of a dense block.
CENTROIDS, FIT_DOCUMENTS, LEAST_DOCUMENTS, MOST_LANGUAGES, BLOCK_ROWS = 4, 2000, 50, 1000, 256
#: Radius of a language: this quantile of its sample's distances, and so much of the way from there to 1.
QUANTILE, SLACK = 0.995, 0.25


def letters(cp: np.ndarray, table: dict) -> np.ndarray:
    """Which code points are letters."""
    if "low" not in table:
        table["low"] = np.array([chr(i).isalpha() for i in range(0x3000)])
    out = np.zeros(len(cp), bool)
    low = cp < 0x3000
    out[low] = table["low"][cp[low]]
    if not low.all():
        high = cp[~low]
        some, back = np.unique(high, return_inverse=True)
        out[~low] = np.array([chr(i).isalpha() for i in some.tolist()])[back]
    return out


def counts(texts: list[str | None], table: dict) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIM counts of hashed n-grams, number of letters) of a few texts."""
    low = [" " + (t or "").lower() + " " for t in texts]
    n = len(low)
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(n), [len(t) for t in low])
    is_letter = letters(cp, table)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the mark of a run is the place after its letter
    at = np.flatnonzero(is_letter)
    keep[at[np.concatenate([[True], text[at][1:] != text[at][:-1]])] - 1 if len(at) else at] = True  # and, before a text's first letter, the place before it
    c = np.where(is_letter, cp, np.uint32(32))[keep]
    text, some = text[keep], is_letter[keep]
    sums = np.bincount(text[some], minlength=n)
    out = np.zeros(n * DIM, np.int64)
    h = np.zeros(len(c), np.uint32)
    for k in range(3):
        size = len(c) - k
        if size <= 0:
            break
        h = h[:size] * np.uint32(0x01000193) + c[k:] * np.uint32(0x9E3779B1) + np.uint32(k)
        d = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        d = (d ^ (d >> np.uint32(13))) & np.uint32(DIM - 1)
        own = text[:size] == text[k:]
        out += np.bincount((text[:size] * DIM + d)[own], minlength=n * DIM)
    return out.reshape(n, DIM), sums


def blocks(column) -> Iterator[tuple[int, list[str | None]]]:
    """A few texts at a time, by number and by bytes."""
    part, size, lo = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py()
        part.append(t)
        size += len(t or "")
        if len(part) >= BLOCK_ROWS or size >= CHUNK_BYTES:
            yield lo, part
            part, size, lo = [], 0, i + 1
    if part:
        yield lo, part


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count, dtype=np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and of those with each dimension, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total, df = {}, 0, np.zeros(DIM, np.int64)
        for b in batches:
            for _, part in blocks(b.column(0)):
                c, n = counts(part, table)
                df += (c[n > 0] > 0).sum(0)
                total += int((n > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[total], df]))], ["dim", "n"])

    rows = in_batches(docs.select("text"), run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r.dim + 1] = r.n
    return int(out[0]), out[1:]


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the start is the first row and then, each time, the row farthest from those chosen."""
    chosen = [0]
    near = v @ v[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        sums = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """The model learned from the rows where learn holds and the language is known; None if there are none."""
    known = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r.lang: r.n for r in known.where("text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the column is something else")
    total, df = frequencies(known)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    each = max(LEAST_DOCUMENTS, FIT_DOCUMENTS // len(sizes))
    part = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, 2 * each / n))])
    roll = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # equal rows count once, and of a language the first by the roll are taken, so that its number has a bound
    some = known.withColumns({"roll": roll, "hash": F.xxhash64("text")}).where("text is not null").where(F.col("roll") < part[F.col("lang")]).dropDuplicates(["lang", "doc_id", "hash"])
    sample = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("roll", "doc_id", "hash"))).where(F.col("place") <= each).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for b in batches:
            for lo, texts in blocks(b.column(2)):
                c, n = counts(texts, table)
                keep = n > 0
                blobs = pa.array([row.tobytes() for row in vectors(c[keep], idf).astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(k).slice(lo, len(texts)).filter(pa.array(keep)) for k in (0, 1)] + [blobs], ["doc_id", "lang", "v"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sorted(in_batches(sample, run, f"doc_id {kind}, lang string, v binary").collect(), key=lambda r: (r.lang, str(r.doc_id), bytes(r.v)))
    langs, at, centroids, radius = [], [], [], []
    for lang in sorted({r.lang for r in rows}):
        v = np.array([np.frombuffer(r.v, np.float16) for r in rows if r.lang == lang], np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        c = clustered(v, CENTROIDS)
        far = float(np.quantile(1 - (v @ c.T).max(1), QUANTILE))
        at += [len(langs)] * len(c)
        langs.append(lang)
        centroids.append(c)
        radius.append(far + SLACK * (1 - far))
    return {"langs": langs, "at": np.array(at), "centroids": np.concatenate(centroids).astype(np.float32), "idf": idf, "radius": np.array(radius)} if langs else None


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid), rejected (farther than the language's radius)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for b in batches:
            names, scores, far = [], [], []
            for _, part in blocks(b.column(1)):
                c, n = counts(part, table)
                if model is None:
                    names += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    far += [True] * len(part)
                    continue
                near = vectors(c, model["idf"]) @ model["centroids"].T
                best = near.argmax(1)
                cos = np.clip(near[np.arange(len(part)), best], 0, 1).astype(float)
                own = model["at"][best]
                names += [model["langs"][k] if some else "und" for k, some in zip(own.tolist(), n > 0, strict=True)]
                scores += np.where(n > 0, cos, 0.0).tolist()
                far += ((n == 0) | (1 - cos > model["radius"][own])).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op2_nearest_centroid_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
