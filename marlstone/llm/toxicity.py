"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (a run of 0-9, a-z and anything beyond ASCII, lower-cased) is the mean of the
embeddings of its character n-grams of three to six, its edges marked, and of itself; all
are hashed into one table. A window of ``WINDOW`` words is the mean of its words and
goes into a softmax of two classes; a document is as toxic as its most toxic window,
so that a long text does not dilute a few words. The embeddings start along the
smoothed log-odds of their n-grams' documents and are trained, together with the
softmax, on each document's most toxic window, of both labels; n-grams are dropped at
random on the way, so that each carries weight and a misspelling, which shares some of
them, is still seen. Those of fewer than ``LEAST_DOCUMENTS`` documents, or as frequent
in either label as chance has it, stay 0. The
score is calibrated on a held-back fifth of the sample.

Texts that are null or have no word get the score of an empty bag; without documents
of both labels every score is 0; repeated rows are returned as often as they come;
null ids stay null; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, in_batches, labelled_sample
from .textkit import CHUNK_BYTES, NOT_ALNUM, chunks, mix, prefix

BUCKETS, WIDTH, WINDOW, SIZES = 1 << 18, 8, 12, (3, 4, 5, 6)
#: Labelled documents of each class that are learned from at most, and their largest size in bytes.
FIT_PER_CLASS, FIT_BYTES = 1500, 1 << 15
#: Steps on the most toxic windows; share of n-grams dropped in a step; documents that an n-gram is in at least; standard deviations from chance.
STEPS, DROP, LEAST_DOCUMENTS, LEAST_SIGMAS = 60, 0.3, 3, 3.0
#: A score from which on a document is predicted toxic.
THRESHOLD = 0.7


def marked(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of lower-cased code points, blank where not in a word, with a blank before and after every text; and the texts' offsets."""
    for lo, hi, data, at in chunks(column, limit):
        raw = data.tobytes()
        low = [" " + raw[s:e].decode("utf-8", "replace").lower() + " " for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where((cp > 127) | ~NOT_ALNUM[np.minimum(cp, 127)], cp, np.uint32(32))
        yield lo, hi, cp, np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64)


def subwords(data: np.ndarray, at: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text of each word, the buckets of all n-grams, the word of each, and the words' own hashes."""
    sums, down = prefix(data, cache)
    inside = np.concatenate([[0], np.cumsum(data != 32)])
    some = data != 32
    start, end = np.flatnonzero(some[1:] & ~some[:-1]) + 1, np.flatnonzero(some[:-1] & ~some[1:]) + 1
    word_at = np.zeros(len(data) + 1, np.int32)
    word_at[start] = 1
    word_at = np.cumsum(word_at) - 1
    own = mix((sums[end] - sums[start]) * down[start])
    buckets, of = [(own & np.uint64(BUCKETS - 1)).astype(np.int64)], [np.arange(len(start))]
    for n in SIZES:
        size = len(data) - n + 1
        if size <= 0:
            continue
        good = np.flatnonzero(inside[n - 1 : n - 1 + size] - inside[1 : 1 + size] == n - 2)
        h = mix((sums[good + n] - sums[good]) * down[good] + np.uint64(n))
        buckets.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
        of.append(word_at[good + 1])
    return np.searchsorted(at, start, "right") - 1, np.concatenate(buckets), np.concatenate(of), own


def window_means(s: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each word, the mean of s over the window that begins with it (shorter at a text's end, over WINDOW all the same where the text is longer)."""
    counts = np.bincount(text, minlength=n)
    last = np.cumsum(counts)[text]
    begin = np.minimum(np.arange(len(s)), np.maximum(last - WINDOW, last - counts[text]))
    end = np.minimum(begin + WINDOW, last)
    sums = np.concatenate([[0.0], np.cumsum(s, dtype=np.float64)])
    return (sums[end] - sums[begin]) / np.maximum(end - begin, 1)


def most_toxic(s: np.ndarray, text: np.ndarray, n: int, none: float = 0.0) -> np.ndarray:
    """The largest window mean of each text; none for a text without words."""
    out = np.full(n, none)
    if len(s):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        out[text[first]] = np.maximum.reduceat(window_means(s, text, n), first)
    return out


def train(texts: list[str], y: np.ndarray, seed: int = 3) -> dict | None:
    """The learned table as one logit a bucket, the bias and the calibration; None without both labels."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    cache: dict = {}
    seen: dict[int, int] = {}
    grams, words, docs = [], [], []
    for lo, _, data, at in marked(pa.array(texts, pa.string()), 1 << 18):
        w, bucket, of, own = subwords(data, at, cache)
        order = np.argsort(of, kind="stable")
        bucket, ends = bucket[order], np.cumsum(np.bincount(of, minlength=len(own)))
        some, first, back = np.unique(own, return_index=True, return_inverse=True)
        ids = np.empty(len(some), np.int64)
        for i, (h, f) in enumerate(zip(some.tolist(), first.tolist(), strict=True)):
            if h not in seen:
                seen[h] = len(grams)
                grams.append(bucket[ends[f - 1] if f else 0 : ends[f]].astype(np.int32))
            ids[i] = seen[h]
        words.append(ids[back])
        docs.append(w + lo)
    word, doc, n = np.concatenate(words), np.concatenate(docs), len(texts)
    flat, length = np.concatenate(grams), np.array([len(g) for g in grams])
    grams, n_words = None, len(grams)
    begin = np.concatenate([[0], np.cumsum(length)])[:-1]
    held = rng.random(n) < 0.2
    distinct = np.unique(doc * n_words + word)
    d, w = distinct // n_words, distinct % n_words
    n1, n0 = max(1, (y[~held] == 1).sum()), max(1, (y[~held] == 0).sum())
    c1, c0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    cuts = np.searchsorted(d, np.arange(n + 1))
    for i in np.flatnonzero(~held):  # one document's n-grams at a time
        k = length[own := w[cuts[i] : cuts[i + 1]]]
        inside = np.unique(flat[np.repeat(begin[own], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)])
        (c1 if y[i] == 1 else c0)[inside] += 1
    chance = (c1 + c0) * n1 / (n1 + n0)
    known = np.flatnonzero((c1 + c0 >= LEAST_DOCUMENTS) & (np.abs(c1 - chance) >= LEAST_SIGMAS * np.sqrt(np.maximum(chance * n0 / (n1 + n0), 1e-9))))
    rows = len(known)  # the other buckets stay 0 and out of the training
    row_of = np.full(BUCKETS, -1, np.int32)
    row_of[known] = np.arange(rows)
    odds = np.log((c1[known] / n1 + 2 / n1) / (c0[known] / n0 + 2 / n1))
    table, out, bias = rng.normal(0, 0.02, (rows, WIDTH)), rng.normal(0, 0.2, (WIDTH, 2)), np.zeros(2)
    table[:, 0], out[0] = odds, (-1, 1)
    flat = row_of[flat]
    some = flat >= 0
    of_gram, flat = np.repeat(np.arange(len(length), dtype=np.int32), length)[some], flat[some]
    few = np.bincount(of_gram, minlength=len(length))
    begin = np.concatenate([[0], np.cumsum(few)])[:-1]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, out, bias)]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def scalars() -> np.ndarray:
        t = table @ (out[:, 1] - out[:, 0])
        return np.bincount(of_gram, t[flat], len(length)) / length

    counts, opens = np.bincount(doc, minlength=n), np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    for step in range(1, STEPS + 1):
        m = window_means(scalars()[word], doc, n)
        best = np.flatnonzero(m == np.repeat(np.maximum.reduceat(m, opens), np.diff(np.append(opens, len(m)))))
        top = best[np.flatnonzero(np.concatenate([[True], doc[best][1:] != doc[best][:-1]]))]
        last = np.cumsum(counts)[doc[top]]
        start = np.minimum(top, np.maximum(last - WINDOW, last - counts[doc[top]]))
        k = np.minimum(WINDOW, last - start)
        at = np.repeat(start, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        d, w = doc[at], word[at]
        own = ~held[d]
        d, w = d[own], w[own]
        used, back = np.unique(w, return_inverse=True)
        k = few[used]
        g = flat[np.repeat(begin[used], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        of = np.repeat(np.arange(len(used)), k)
        stay = rng.random(len(g)) >= DROP
        g, of = g[stay], of[stay]
        k = length[used] * (1 - DROP)
        vec = np.stack([np.bincount(of, table[g, c], len(used)) for c in range(WIDTH)], 1) / k[:, None]
        size = np.maximum(np.bincount(d, minlength=n), 1)
        bag = np.stack([np.bincount(d, vec[back, c], n) for c in range(WIDTH)], 1) / size[:, None]
        z = bag @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= (weight * ~held)[:, None]
        d_bag = p @ out.T / size[:, None]
        d_vec = np.stack([np.bincount(back, d_bag[d, c], len(used)) for c in range(WIDTH)], 1) / k[:, None]
        d_table = np.stack([np.bincount(g, d_vec[of, c], rows) for c in range(WIDTH)], 1)
        for param, grad, (a, b), rate in zip((table, out, bias), (d_table, bag.T @ p + 1e-4 * out, p.sum(0)), state, (0.05, 0.05, 0.05), strict=True):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.98
            b += 0.02 * grad * grad
            param -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-9)
    s = scalars()[word]
    z = most_toxic(s, doc, n) + bias[1] - bias[0]
    use = held if len(set(y[held].tolist())) == 2 else np.ones(n, bool)
    slope, shift = calibrated(z[use], y[use])
    logit = np.zeros(BUCKETS, np.float32)
    logit[known] = table @ (out[:, 1] - out[:, 0])
    return {"logit": logit, "bias": float(bias[1] - bias[0]), "slope": slope, "shift": shift}


def calibrated(z: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Slope (over 0) and shift of a logistic curve through (z, y), both labels counting alike."""
    scale = max(float(z.std()), 1e-6)
    x, a, b = (z - z.mean()) / scale, 1.0, 0.0
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(a * x + b))) - target) * w
        a, b = max(a - 4 * float((e * x).sum()), 1e-3), b - 4 * float(e.sum())
    return a / scale, b - a * float(z.mean()) / scale


def fit(docs: DataFrame, labels: DataFrame, where=None, per_class: int = FIT_PER_CLASS) -> dict | None:
    sample = labelled_sample(docs, labels, "toxic", per_class, where, most_bytes=FIT_BYTES).select("doc_id", "text", "y")
    rows = sorted(((r.doc_id, r.text or "", r.y) for r in sample.collect()), key=lambda r: (r[0], r[1]))
    rows = [r for i, r in enumerate(rows) if not i or r != rows[i - 1]]
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64)) if rows else None


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        cache: dict = {}
        for b in batches:
            out = np.zeros(b.num_rows)
            if model is not None:
                for lo, hi, data, at in marked(b.column(1)):
                    w, bucket, of, own = subwords(data, at, cache)
                    s = np.bincount(of, model["logit"][bucket], len(own)) / np.maximum(np.bincount(of, minlength=len(own)), 1)
                    z = most_toxic(s, w, hi - lo) + model["bias"]
                    out[lo:hi] = 1 / (1 + np.exp(-np.clip(model["slope"] * z + model["shift"], -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, fit(docs, labels, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
