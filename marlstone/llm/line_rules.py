"""Quality rules by line labelling: a linear-chain CRF marks each line content or boilerplate.

The chain's weights are learned in numpy by maximum likelihood (forward-backward)
on the lines of a bounded sample of labelled documents, whose lines carry the
document's label, and on as many sequences spliced from stretches of good and bad
ones, from which it learns where labels change; Viterbi decoding then labels the lines of every whole text, and a
document is kept if the share of its words in content lines reaches ``SHARE`` and
the base rules hold.

A null or empty text has no words and no lines and fails the base rules; a very long one
is decoded whole, a chunk of its own, and learned from in FIT_LINES lines spread over it; a
table without labels of both kinds leaves all lines content, so that the base rules alone
decide; of equally likely labels a line takes boilerplate, and a share of just SHARE is
kept; an empty table gives an empty result; repeated rows are returned as often as they
come and learned from once; null ids stay null; columns other than doc_id and text,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_batches, labelled_sample
from .textkit import BLANKS, Words, chunks, mix, span_hash, windows

#: Labelled documents of each class that the chain is fitted on, at most, lines of each of them that it learns from (spread evenly over the text), and steps of the fit.
FIT_PER_CLASS, FIT_LINES, FIT_STEPS = 500, 600, 150
#: Lines of a stretch between two changes of label that the chain learns from, on average.
STRETCH = 5
#: The least share of words in content lines.
SHARE = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
FEATURES = ("one", "words", "symbols", "upper", "digits", "stops", "bangs", "pipes", "ends", "copy", "stutter", "repeats", "length", "first", "last")


def per_span(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[start]


def copies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: equal to an earlier one; equal to any other one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    earlier, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:][same]] = True
    other[order[1:][same]] = True
    other[order[:-1][same]] = True
    return earlier, other


def measured(column, cache: dict) -> Iterator[tuple[int, int, dict, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: rows, the base counts, and of each line with a word its text, words and features."""
    for lo, hi, data, at in chunks(column):
        n = hi - lo
        w = Words(data, at, BLANKS, lower=False)
        h = w.hash(cache)
        lead = (data & 0xC0) != 0x80
        base = {"n_words": w.counts, "word_chars": np.bincount(w.text, per_span(lead, w.start, w.end), n), "n_symbols": per_span(SYMBOLS[data], at[:-1], at[1:])}
        # a line begins at the start of a text and after each \n
        breaks = np.flatnonzero(data == 10) + 1
        text_of = np.searchsorted(at, breaks - 1, "right") - 1
        start = np.concatenate([at[:-1], breaks])
        text = np.concatenate([np.arange(n), text_of])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        final = np.ones(len(start), bool)
        final[:-1] = text[1:] != text[:-1]
        end[final] = at[1:][text[final]]
        words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
        some = words > 0
        start, end, text, words = start[some], end[some], text[some], words[some]
        salt = mix(text.astype(np.uint64) + np.uint64(1))
        copy, _ = copies(span_hash(data, start, end, cache) ^ salt)
        base["n_dup_lines"] = np.bincount(text[copy], minlength=n)
        grams, where = windows(h, w.text, 3)
        _, often = copies(grams ^ mix(w.text[where].astype(np.uint64) + np.uint64(1)))
        again = np.zeros(len(h) + 2, bool)
        for k in range(3):
            again[where[often] + k] = True
        again = again[: len(h)]
        base["n_repeat_words"] = np.bincount(w.text[again], minlength=n)
        f = np.zeros((len(start), len(FEATURES)), np.float32)
        if len(start):
            size = np.maximum(end - start, 1)
            a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
            upper = (data >= 65) & (data <= 90)
            letters = per_span(upper | ((data >= 97) & (data <= 122)), start, end)
            stutter = np.zeros(len(h), bool)
            stutter[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
            tail = w.end[b - 1] - 1
            f[:, 0] = 1
            f[:, 1] = np.log1p(words) / 5
            f[:, 2] = np.minimum(1, 3 * per_span(SYMBOLS[data], start, end) / size)
            f[:, 3] = per_span(upper, start, end) / np.maximum(letters, 1)
            f[:, 4] = per_span((data >= 48) & (data <= 57), start, end) / size
            f[:, 5] = np.minimum(1, per_span(STOPS[data], start, end) / words)
            f[:, 6] = np.minimum(1, per_span(data == 33, start, end) / words)
            f[:, 7] = np.minimum(1, per_span(data == 124, start, end) / words)
            f[:, 8] = STOPS[data[tail]]
            f[:, 9] = copy
            f[:, 10] = per_span(stutter, a, b) / words
            f[:, 11] = per_span(again, a, b) / words
            f[:, 12] = np.minimum(2, size / words / 8)
            f[1:, 13] = text[1:] != text[:-1]
            f[0, 13] = 1
            f[:-1, 14] = text[1:] != text[:-1]
            f[-1, 14] = 1
        yield lo, hi, base, text, words, f


def steps_of(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, its first line, and the texts by falling number of lines."""
    lines = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(lines)])[:-1]
    return lines, first, np.argsort(-lines, kind="stable")


def viterbi(score: np.ndarray, move: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The likeliest label (0, 1) of each line; all texts advance together, a line at a time."""
    lines, first, order = steps_of(text, n)
    label = np.zeros(len(score), np.int8)
    if not len(score):
        return label
    back = np.zeros((len(score), 2), np.int8)
    active = np.searchsorted(-lines[order], -np.arange(lines.max()), "left")
    best = score[first[order[: active[0]]]]
    ends = {}
    for t in range(1, lines.max()):
        k = active[t]
        if k < len(best):
            ends[t] = best[k:]
            best = best[:k]
        at = first[order[:k]] + t
        through = best[:, :, None] + move
        back[at] = through.argmax(1)
        best = through.max(1) + score[at]
    ends[lines.max()] = best
    final = np.zeros((active[0], 2))
    hi = active[0]
    for t in sorted(ends):
        final[hi - len(ends[t]) : hi] = ends[t]
        hi -= len(ends[t])
    now = final.argmax(1).astype(np.int8)
    for t in range(lines.max() - 1, -1, -1):
        k = active[t]
        at = first[order[:k]] + t
        label[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return label


def spliced(sequences: list[np.ndarray], labels: list[int], seed: int = 17) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sequences, and as many more that change between stretches of documents of both labels, with a label a line.

    A document's lines all have its label; what the chain has to know of changes it learns
    from stretches of STRETCH lines on average, one after the other as they stand in their
    documents, of a good and a bad one by turns.
    """
    r = np.random.default_rng(seed)
    both = [[s for s, y in zip(sequences, labels, strict=True) if y == k and len(s)] for k in (0, 1)]
    out, marks = list(sequences), [np.full(len(s), y) for s, y in zip(sequences, labels, strict=True)]
    if not all(both):
        return out, marks
    for _ in range(len(sequences)):
        pair, at, now, parts, given = [x[r.integers(len(x))] for x in both], [0, 0], int(r.integers(2)), [], []
        for _ in range(int(r.integers(2, 7))):
            stretch = pair[now][at[now] : at[now] + 1 + int(r.geometric(1 / STRETCH))]
            at[now] += len(stretch)
            parts.append(stretch)
            given.append(np.full(len(stretch), now))
            now = 1 - now
        whole = np.concatenate(parts)
        whole[:, -2:] = 0  # first and last
        whole[0, -2] = whole[-1, -1] = 1
        out.append(whole)
        marks.append(np.concatenate(given))
    return out, marks


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = FIT_STEPS, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(features x 2 emission weights, 2 x 2 transition weights) of the chain, by Adam on the likelihood; labels: one a line."""
    parts = [(s[k : k + 200], y[k : k + 200]) for s, y in zip(sequences, labels, strict=True) for k in range(0, len(s), 200)]  # so that few long texts don't set the number of rounds
    sequences, labels = [s for s, _ in parts], [y for _, y in parts]
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    x, y = np.concatenate([sequences[i] for i in order]), np.concatenate([labels[i] for i in order])
    lines = np.array([len(sequences[i]) for i in order])
    first = np.concatenate([[0], np.cumsum(lines)])[:-1]
    active = np.searchsorted(-lines, -np.arange(lines.max()), "left")
    n, weight = len(x), np.repeat(1 / lines, lines)[:, None]
    emit, move = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    m = [np.zeros_like(emit), np.zeros_like(move)]
    v = [np.zeros_like(emit), np.zeros_like(move)]
    same = np.zeros((2, 2))
    for i, s in enumerate(order):
        np.add.at(same, (labels[s][:-1], labels[s][1:]), 1 / lines[i])
    for step in range(1, steps + 1):
        score = x @ emit
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, lines.max()):
            at = first[: active[t]] + t
            ahead[at] += np.logaddexp.reduce(ahead[at - 1][:, :, None] + move, axis=1)
        pairs = np.zeros((2, 2))
        total = np.repeat(np.logaddexp.reduce(ahead[first + lines - 1], axis=1), lines)
        for t in range(lines.max() - 1, 0, -1):
            at = first[: active[t]] + t
            out = score[at] + behind[at]
            behind[at - 1] = np.logaddexp.reduce(move + out[:, None, :], axis=2)
            pairs += (np.exp(ahead[at - 1][:, :, None] + move + out[:, None, :] - total[at][:, None, None]) * weight[at][:, :, None]).sum(0)
        p = np.exp(ahead + behind - total[:, None])
        p[np.arange(n), y] -= 1
        grads = [x.T @ (p * weight) / len(order) + decay * emit, (pairs - same) / len(order) + decay * move]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
        change = [0.2 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8) for i in (0, 1)]
        emit, move = emit - change[0], move - change[1]
    return emit, move


def fit_chain(docs: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS) -> tuple[np.ndarray, np.ndarray] | None:
    """The chain learned from labels.quality; None without documents of both labels."""
    sample = labelled_sample(docs, labels, "quality", per_class)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        cache: dict = {}
        for b in batches:
            found = [b""] * b.num_rows
            for lo, hi, _, text, _, f in measured(b.column(1), cache):
                ends = np.searchsorted(text, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    own = f[ends[i] : ends[i + 1]]
                    if len(own) > FIT_LINES:  # stretches of 100 lines, so that neighbours stay neighbours
                        begin = np.linspace(0, len(own) - 100, FIT_LINES // 100).astype(int)
                        own = np.concatenate([own[k : k + 100] for k in begin])
                    found[lo + i] = own.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x or b"" for x in found], pa.binary()), b.column(2)], ["doc_id", "f", "y"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(in_batches(sample.select("doc_id", "text", "y"), lines, f"doc_id {kind}, f binary, y int").collect(), key=lambda r: (str(r.doc_id), bytes(r.f)))
    if len({r.y for r in rows if r.f}) < 2:
        return None
    return fit(*spliced([np.frombuffer(r.f, np.float32).astype(np.float64).reshape(-1, len(FEATURES)) for r in rows], [r.y for r in rows]))


def label_lines(docs: DataFrame, chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, n_lines and content_words of every whole text."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "content_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        cache: dict = {}
        for b in batches:
            parts = {k: [] for k in names}
            for lo, hi, base, text, words, f in measured(b.column(1), cache):
                n = hi - lo
                content = np.ones(len(text), bool) if chain is None else viterbi(f @ chain[0], chain[1], text, n) == 1
                base["n_lines"] = np.bincount(text, minlength=n)
                base["content_words"] = np.bincount(text[content], words[content], n)
                for k in names:
                    parts[k].append(np.asarray(base[k]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate(parts[k]) if parts[k] else np.zeros(0, np.int64)) for k in names]], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, ", ".join([f"doc_id {kind}", *[f"{k} long" for k in names]]))


def verdicts(labelled: DataFrame, share: float = SHARE) -> DataFrame:
    """labelled with content_share, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    part = F.when(F.col("n_words") > 0, F.col("content_words") / F.col("n_words")).otherwise(0.0)
    return labelled.withColumn("content_share", part).withColumn("base_failed", failed).withColumn("kept", ~failed & (part >= share))


def rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The base counts, content_share, base_failed and kept of every document."""
    chain = fit_chain(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return verdicts(label_lines(docs, chain, id_col, text_col), share)


def op6_line_crf_rules(spark, sf_dir: str) -> DataFrame:
    found = rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
