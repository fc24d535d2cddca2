"""Quality by co-training: a text-content view and a page-metadata view teach each other.

The text view sees hashed byte trigrams of the whole text, log-scaled and normalised, and
statistics of its wording (shares of byte classes, repeated lines and words). The page
view sees what is known about the page: source and language (hashed), declared length and
its ratio to the real one, number and length of lines. A logistic classifier for each
view starts from the same labelled sample; in each round each view gives its most
confident documents of an unlabelled sample, with its label, to the other view's training
set. After each round both views are calibrated on a held-back fifth of the labelled
sample, and the sum of the two calibrated logits, calibrated once more, has a loss there;
the round of the least loss is what scores every document, and after PATIENCE rounds
without a gain the exchange ends. So a round counts only if it helps; fewer than
LEAST_HELD held-back rows can't tell, and the last round counts.

Samples are bounded and chosen by hashes: LABELLED documents a class (of at most 1 MB) by
the id, and POOL unlabelled ones of any length by id and text; the scores cover all
documents. A null or empty text has no trigrams, a null source or language or length is a
value of its own; very long texts are read whole, a chunk of their own; without labels of
both kinds every score is 1 and everything is kept; an empty table gives an empty result;
repeated rows are scored and returned as often as they come; null ids stay null; a score
of just LEAST_SCORE is kept. Other columns, whatever their names, are not looked at
(score) or kept as they are (accepted).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, free, in_batches, labelled_sample, numbered, place, rolled_sample
from .line_rules import per_span, copies
from .textkit import BLANKS, Words, chunks, mix, one_hash, span_hash
from .toxicity import calibrated

GRAMS, CONTENT = 1024, 10
SOURCE_DIM, LANG_DIM, LENGTH_DIM, LAYOUT = 64, 16, 24, 4
TEXT_DIM, PAGE_DIM = GRAMS + CONTENT, SOURCE_DIM + LANG_DIM + LENGTH_DIM + LAYOUT
#: Labelled documents of each class, unlabelled documents at about, rounds at most, documents a view gives away in a round and class, rounds without a gain that end the exchange, and held-back documents that can tell.
LABELLED, POOL, ROUNDS, GIVEN, PATIENCE, LEAST_HELD = 600, 1500, 6, 40, 2, 30
#: Documents with a score under this are rejected.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def views(batch: pa.RecordBatch, cache: dict) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, text view, page view) of a batch of COLUMNS, a block at a time."""
    names = [pc.fill_null(batch.column(i).cast(pa.string()), "\0none").to_pylist() for i in (2, 3)]
    declared = pc.fill_null(batch.column(4).cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
    hashed = cache.setdefault("names", {})
    for lo, hi, data, at in chunks(batch.column(1), most_rows=1024):
        n = hi - lo
        text = np.repeat(np.arange(n), np.diff(at))
        out = np.zeros((n, TEXT_DIM), np.float32)
        grams = out[:, :GRAMS]
        if len(data) > 2:
            d = data.astype(np.uint32)
            h = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA6B)) ^ (d[2:] * np.uint32(0xC2B2AE35))
            h = ((h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> np.uint32(22)
            own = text[:-2] == text[2:]
            grams += np.log1p(np.bincount((text[:-2] * GRAMS + h)[own], minlength=n * GRAMS).reshape(n, GRAMS))
            grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        page = np.zeros((n, PAGE_DIM), np.float32)
        for j, (dim, first) in enumerate(((SOURCE_DIM, 0), (LANG_DIM, SOURCE_DIM))):
            for i in range(n):
                name = names[j][lo + i]
                if name not in hashed:
                    if len(hashed) > 100_000:
                        hashed.clear()
                    hashed[name] = one_hash(name + ".")
                page[i, first + hashed[name] % dim] = 1
        w = Words(data, at, BLANKS, lower=False)
        wh = w.hash(cache)
        size, words = np.maximum(np.diff(at), 1), np.maximum(w.counts, 1)
        share = lambda flags: per_span(flags, at[:-1], at[1:]) / size
        line_end = np.flatnonzero(data == 10)
        lines = per_span(data == 10, at[:-1], at[1:]) + 1
        starts = np.concatenate([at[:-1], line_end + 1])
        order = np.argsort(starts, kind="stable")
        owner = np.concatenate([np.arange(n), text[line_end]])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = np.append(starts[1:] - 1, len(data))
        last = np.append(owner[1:] != owner[:-1], True)
        ends[last] = at[1:][owner[last]]
        full = ends > starts
        again, _ = copies(span_hash(data, starts[full], ends[full], cache) ^ mix(owner[full].astype(np.uint64) + np.uint64(1)))
        stutter = np.zeros(len(wh), bool)
        stutter[1:] = (wh[1:] == wh[:-1]) & (w.text[1:] == w.text[:-1])
        seen, _ = copies(wh ^ mix(w.text.astype(np.uint64) + np.uint64(7)))
        content = (
            share((data >= 65) & (data <= 90)), share((data >= 97) & (data <= 122)), share((data >= 48) & (data <= 57)), share((data > 32) & (data < 48)) + share(data == 124), share(data == 33), share(data >= 128),
            np.bincount(owner[full][again], minlength=n) / lines, np.bincount(w.text[stutter], minlength=n) / words, np.bincount(w.text[seen], minlength=n) / words, size / words / 30,
        )
        for j, column in enumerate(content):
            out[:, GRAMS + j] = 3 * np.minimum(column, 1)
        length = declared[lo:hi]
        k = SOURCE_DIM + LANG_DIM
        page[np.arange(n), k + np.minimum(np.log2(np.maximum(length, 0) + 1).astype(int), LENGTH_DIM - 2) + (length >= 0)] = 1  # the first place: not declared
        for j, column in enumerate((np.log1p(np.maximum(length, 0)) / 10, np.log1p(np.maximum(length, 0) / size), np.log1p(lines) / 5, np.log1p(size / lines) / 5)):
            page[:, k + LENGTH_DIM + j] = np.minimum(column, 3)
        yield lo, hi, out, page


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias; both labels count alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, steps + 1):
        g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) - y) * weight) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-9)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + np.float32(w[-1])


def co_train(seen: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, given: int = GIVEN, seed: int = 5) -> dict | None:
    """The two views' weights and calibrations after the round of the least loss on the held-back rows, that round, and all losses. seen and pool: text view and page view of the same documents."""
    if len(set(y.tolist())) < 2:
        return None
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    x, labels = [v[~held] for v in seen], [y[~held], y[~held]]
    left = np.ones(len(pool[0]), bool)
    use = held if held.any() else np.ones(len(y), bool)
    by = np.where(y[use] == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum()))
    best, losses = None, []
    for turn in range(rounds + 1):
        w = [logistic(x[k], labels[k]) for k in (0, 1)]
        z = [logits(seen[k][use], w[k]).astype(float) for k in (0, 1)]
        curve = [calibrated(z[k], y[use]) for k in (0, 1)]
        both = sum(a * s + b for s, (a, b) in zip(z, curve, strict=True))
        last = calibrated(both, y[use])
        losses.append(float((np.logaddexp(0, -(2 * y[use] - 1) * (last[0] * both + last[1])) * by).sum()))
        if best is None or losses[-1] < losses[best["round"]] or use.sum() < LEAST_HELD:
            best = {"weights": [v.astype(np.float32) for v in w], "curves": [*curve, last], "round": turn}
        if turn - best["round"] >= PATIENCE or not left.any():
            break
        for k in (0, 1):
            if not left.any():
                break
            z = np.where(left, logits(pool[k], w[k]), np.nan)
            order = np.argsort(z)[: left.sum()]
            low, high = order[:given][z[order[:given]] < 0], order[::-1][:given][z[order[::-1][:given]] > 0]
            picked = np.concatenate([low, high]).astype(int)
            x[1 - k] = np.concatenate([x[1 - k], pool[1 - k][picked]])
            labels[1 - k] = np.concatenate([labels[1 - k], np.repeat([0, 1], [len(low), len(high)])])
            left[picked] = False
    return best | {"losses": losses}


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Co-training on LABELLED documents a class of labels.quality and about POOL others."""
    sample = labelled_sample(docs, labels, "quality", LABELLED, columns=COLUMNS).select(*COLUMNS, "y")
    pool = rolled_sample(docs.select(*COLUMNS), POOL, docs.count(), 13).withColumn("y", F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        cache: dict = {}
        for b in batches:
            for lo, hi, t, p in views(b, cache):
                blobs = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (t.astype(np.float16), p.astype(np.float16))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(5).slice(lo, hi - lo), *blobs], ["doc_id", "y", "t", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = [r for part in (sample, pool) for r in in_batches(part, run, f"doc_id {kind}, y int, t binary, p binary").collect()]
    known = {r.doc_id for r in rows if r.y >= 0}
    rows.sort(key=lambda r: (r.y, str(r.doc_id), bytes(r.t)))
    back = lambda chosen: [np.array([np.frombuffer(r[k], np.float16) for r in chosen], np.float32).reshape(len(chosen), dim) for k, dim in (("t", TEXT_DIM), ("p", PAGE_DIM))]
    seen = [r for r in rows if r.y >= 0]
    return co_train(back(seen), np.array([r.y for r in seen], np.int64), back([r for r in rows if r.y < 0 and r.doc_id not in known]))


def judged(docs: DataFrame, model: dict | None) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names, which no column of docs has: the probabilities of good quality by both views, by the text and by the page."""
    n, at = len(docs.columns), [place(docs, c) for c in COLUMNS]
    frame = numbered(docs)
    made = [*frame.columns, "_mk_score", "_mk_text", "_mk_page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        cache: dict = {}
        curve = lambda z, c: 1 / (1 + np.exp(-np.clip(c[0] * z + c[1], -40, 40)))
        for b in batches:
            found = np.ones((3, b.num_rows))
            if model is not None:
                for lo, hi, t, p in views(pa.RecordBatch.from_arrays([b.column(i) for i in at], list(COLUMNS)), cache):
                    z = [logits(v, w).astype(float) for v, w in zip((t, p), model["weights"], strict=True)]
                    c = model["curves"]
                    found[1, lo:hi], found[2, lo:hi] = curve(z[0], c[0]), curve(z[1], c[1])
                    found[0, lo:hi] = curve(sum(a * s + d for s, (a, d) in zip(z, c[:2], strict=True)), c[2])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], *[pa.array(x) for x in found]], made)

    schema = StructType([*frame.schema.fields, *[StructField(c, DoubleType()) for c in ("_mk_score", "_mk_text", "_mk_page")]])
    names = free(docs, "score", "text_score", "page_score")
    return in_batches(frame, run, schema).toDF(*docs.columns, *names), names


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, text_score, page_score (probabilities of good quality) and kept of every document."""
    found, names = judged(docs.select(*COLUMNS), model)
    return found.select("doc_id", *names, (F.col(names[0]) >= LEAST_SCORE).alias("kept"))


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""
    frame = numbered(docs).withColumnsRenamed({f"_mk_{place(docs, c)}": c for c in COLUMNS})
    found, names = judged(frame, model)
    return found.where(F.col(names[0]) >= LEAST_SCORE).select(*frame.columns).toDF(*docs.columns)


def op1_cotrained_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
