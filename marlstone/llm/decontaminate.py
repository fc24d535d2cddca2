"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, the document
frequencies being counted over all documents; very common words weigh nothing. A
randomised SVD of the passages, whose products are summed over partitions, gives the
latent space. Windows of every document are projected into it and compared with all
passages by cosine (the benchmark is a stated query set, taken in blocks of bounded
size, several in one pass; one pass counts the words of all). A candidate is a leak if the longest common subsequence of its words with the
passage, near the window, covers LEAST_LCS of the passage, and if the answer is there:
the item's own answer where the benchmark has that column, else half of the passage's
rare words.

A null or empty text holds nothing; a very long one is read whole, a chunk of its own; an
item without words is not looked for; an empty benchmark leaves every document clean, and
an empty table gives an empty result; repeated rows are judged and returned as often as
they come; null ids stay null; of equally good items all are named, and the shares are
the best one's. Other columns, whatever their names, come along in ``flagged``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free, in_batches, numbered, place
from .textkit import NOT_ALNUM, Words, chunks

#: Words of a passage and of a window, step of the windows, rank of the space and what is drawn beyond it.
PASSAGE, WINDOW, STEP, RANK, EXTRA = 48, 32, 16, 128, 16
#: Words in more than this share of documents weigh nothing; yet each passage keeps LEAST_RARE words, its rarest.
COMMON_SHARE, COMMON_LEAST, LEAST_RARE = 0.02, 20, 4
LEAST_COSINE, LEAST_LCS, LEAST_ANSWER = 0.33, 0.6, 0.5
#: Bytes of benchmark text that share a latent space, blocks that one pass of Python over the corpus holds, and words that one pass counts.
BLOCK_BYTES, BLOCKS_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 4, 1 << 22


def hashed(column) -> list[np.ndarray]:
    """The word hashes of each text (runs of 0-9, a-z and anything beyond ASCII, A-Z lower-cased)."""
    cache: dict = {}
    out = []
    for lo, hi, data, at in chunks(column):
        w = Words(data, at, NOT_ALNUM, lower=True)
        h = w.hash(cache)
        out += [h[w.first[i] : w.first[i + 1]] for i in range(hi - lo)]
    return out


def passages(ids: list, texts: list, answers: list | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item, words, answer's words) of each passage: an item's words in turn, a short rest with the one before it."""
    out = []
    said = hashed(pa.array(answers, pa.string())) if answers else [np.zeros(0, np.uint64)] * len(texts)
    for item, words, answer in zip(ids, hashed(pa.array(texts, pa.string())), said, strict=True):
        n = max(1, round(len(words) / PASSAGE))
        for part in np.array_split(words, n) if len(words) else []:
            out.append((item, part, answer))
    return out


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each word of the sorted vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        cache, size, total = {}, len(vocabulary), 0
        df = np.zeros(size, np.int64)
        for b in batches:
            total += b.num_rows
            for _, _, data, at in chunks(b.column(0)):
                w = Words(data, at, NOT_ALNUM, lower=True)
                h = w.hash(cache)
                i = np.minimum(np.searchsorted(vocabulary, h), size - 1)
                ok = vocabulary[i] == h
                df += np.bincount(np.unique(w.text[ok] * size + i[ok]) % size, minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], ["word", "n"])

    rows = in_batches(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        df[r.word] = r.n
    return int(df[-1]), df[:-1]


def summed(spark, rows: list[tuple[list[int], list[float]]], right: np.ndarray, gram: bool) -> np.ndarray:
    """A'(A R), or with gram (A R)'(A R), of the sparse rows A, partition by partition."""
    data = spark.createDataFrame([(list(map(int, c)), list(map(float, v))) for c, v in rows], "c array<int>, v array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((right.shape[1] if gram else right.shape[0], right.shape[1]))
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = np.asarray(v) @ right[c]
                if gram:
                    out += np.outer(y, y)
                else:
                    np.add.at(out, c, np.outer(v, y))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

    parts = data.repartition(min(8, 1 + len(rows) // 256)).mapInArrow(run, "part binary").collect()
    return sum(np.frombuffer(r.part).reshape(-1, right.shape[1]) for r in parts)


def randomised_svd(spark, rows, width: int, rank: int = RANK, seed: int = 1) -> np.ndarray:
    """The leading right singular vectors (width x rank) of the sparse rows, by one power round."""
    size = min(rank + EXTRA, width, len(rows))
    q = np.random.default_rng(seed).normal(size=(width, size))
    for _ in range(2):
        q = np.linalg.qr(summed(spark, rows, q, gram=False))[0]
    values, u = np.linalg.eigh(summed(spark, rows, q, gram=True))
    best = np.argsort(-values)[:rank]
    return q @ u[:, best[values[best] > 1e-9]]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def counted(docs: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each word, of a vocabulary of any size: a pass over the corpus for each WORDS_AT_ONCE words, so mostly one."""
    parts = [frequencies(docs, words[k : k + WORDS_AT_ONCE]) for k in range(0, len(words), WORDS_AT_ONCE)]
    return parts[0][0], np.concatenate([df for _, df in parts])


def prepared(spark, items: list[tuple[int, np.ndarray, np.ndarray]], total: int, words: np.ndarray, counts: np.ndarray) -> dict:
    """Vocabulary, word vectors, passage vectors and rare words of a block of passages, by the counts of the whole benchmark's words."""
    vocabulary = np.unique(np.concatenate([w for _, w, _ in items]))
    df = counts[np.searchsorted(words, vocabulary)]
    idf = np.log((1 + total) / (1 + df)) + 1
    rare = df <= max(COMMON_LEAST, COMMON_SHARE * total)
    for _, words, _ in items:
        own = np.unique(np.searchsorted(vocabulary, words))
        if rare[own].sum() < LEAST_RARE:
            rare[own[np.lexsort((own, df[own]))][:LEAST_RARE]] = True
    vocabulary, idf = vocabulary[rare], idf[rare]
    rows, keys = [], []
    for _, words, _ in items:
        i = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        c, n = np.unique(i[vocabulary[i] == words], return_counts=True)
        v = n * idf[c]
        rows.append((c, v / np.linalg.norm(v)))
        keys.append(c)
    right = randomised_svd(spark, rows, len(vocabulary))
    vectors = (idf[:, None] * right).astype(np.float32)
    latent = np.stack([v @ right[c] for c, v in rows]).astype(np.float32)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return {"vocabulary": vocabulary, "vectors": vectors, "latent": latent, "items": [i for i, _, _ in items], "words": [w.tolist() for _, w, _ in items], "rare": [set(vocabulary[k].tolist()) for k in keys], "answers": [set(a.tolist()) for _, _, a in items]}


def candidates(w: Words, h: np.ndarray, model: dict) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, passage, first word, word after the last, cosine) of each window near a passage, by text and passage."""
    vocabulary = model["vocabulary"]
    i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[i] == h)
    if not len(at):
        return
    sums = np.zeros((len(at) + 1, model["vectors"].shape[1]))
    np.cumsum(model["vectors"][i[at]], axis=0, out=sums[1:])
    each = np.maximum(1, -(-(w.counts - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(w.n_texts), each)
    start = w.first[text] + STEP * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
    end = np.minimum(start + WINDOW, w.first[text + 1])
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    some = np.flatnonzero(hi > lo)
    found = []
    for k in range(0, len(some), 512):
        part = some[k : k + 512]
        v = (sums[hi[part]] - sums[lo[part]]).astype(np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        cos = v @ model["latent"].T
        r, p = np.nonzero(cos >= LEAST_COSINE)
        found += zip(text[part[r]].tolist(), p.tolist(), start[part[r]].tolist(), end[part[r]].tolist(), cos[r, p].tolist(), strict=True)
    found.sort()
    yield from found


def leaks(w: Words, h: np.ndarray, model: dict) -> dict[int, dict[int, tuple[float, float]]]:
    """By text, the items that it holds, with cosine and share of the longest common subsequence."""
    out: dict[int, dict] = {}
    regions: list[list] = []
    for text, p, start, end, cos in candidates(w, h, model):
        n = len(model["words"][p])
        lo, hi = max(int(w.first[text]), start - n), min(int(w.first[text + 1]), end + n)
        if regions and regions[-1][:2] == [text, p] and lo <= regions[-1][3]:
            regions[-1][3:] = [hi, max(cos, regions[-1][4])]
        else:
            regions.append([text, p, lo, hi, cos])
    for text, p, lo, hi, cos in regions:
        near, want = h[lo:hi].tolist(), model["words"][p]
        here = set(near)
        answer = model["answers"][p]
        if not (answer <= here if answer else len(model["rare"][p] & here) >= LEAST_ANSWER * len(model["rare"][p])):
            continue
        share = common_subsequence(want, near) / len(want)
        if share >= LEAST_LCS:
            item = model["items"][p]
            own = out.setdefault(text, {})
            own[item] = max(own.get(item, (0.0, 0.0)), (share, cos))
    return out


def blocks(bench: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> Iterator[list]:
    """The benchmark's passages in blocks of about BLOCK_BYTES of text."""
    b = bench.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    size = b.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = 1 + size // BLOCK_BYTES
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)) == k).select(id_col, text_col, *([answer_col] if answer_col else [])).distinct().collect()
        rows.sort(key=lambda r: (r[0], r[1]))
        found = passages([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows] if answer_col else None)
        if found:
            yield found


def flagged(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names, which no column of docs has: the items found (sorted), and share and cosine of the best one (else null)."""
    spark, n, at_text = docs.sparkSession, len(docs.columns), place(docs, text_col)
    answer = "answer" if "answer" in bench.columns else None
    texts = numbered(docs).select(F.col(f"_mk_{at_text}").alias("text"))
    none = F.lit(None).cast("double")
    found = numbered(docs).withColumns({"_mk_items": F.array().cast(f"array<{bench.schema[item_col].dataType.simpleString()}>"), "_mk_share": none, "_mk_cosine": none})
    words = np.zeros(0, np.uint64)
    for block in blocks(bench, item_col, item_text_col, answer):
        words = np.union1d(words, np.concatenate([w for _, w, _ in block]))
    total, counts = counted(texts, words) if len(words) else (0, words)
    waiting: list[dict] = []

    def searched(found: DataFrame, models: list[dict]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            cache: dict = {}
            for b in batches:
                before = [b.column(n + k).to_pylist() for k in range(3)]
                for lo, _, data, at in chunks(b.column(at_text)):
                    w = Words(data, at, NOT_ALNUM, lower=True)
                    h = w.hash(cache)
                    for model in models:
                        for text, own in leaks(w, h, model).items():
                            share, cos = max(own.values())
                            before[0][lo + text] = sorted({*before[0][lo + text], *own})
                            if before[1][lo + text] is None or share > before[1][lo + text]:
                                before[1][lo + text], before[2][lo + text] = share, cos
                columns = [*[b.column(k) for k in range(n)], pa.array(before[0], b.schema.field(n).type), pa.array(before[1], pa.float64()), pa.array(before[2], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

        return in_batches(found, run, found.schema)

    for block in blocks(bench, item_col, item_text_col, answer):
        waiting.append(prepared(spark, block, total, words, counts))
        if len(waiting) == BLOCKS_AT_ONCE:
            found, waiting = searched(found, waiting), []
    found = searched(found, waiting) if waiting else found
    names = free(docs, "item_ids", "lcs_share", "cosine")
    return found.toDF(*docs.columns, *names), names


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_ids, lcs_share and cosine of every document."""
    return flagged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bench, "text", item_col, item_text_col)[0].drop("text")


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of the benchmark."""
    found, (items, *_) = flagged(numbered(docs), bench, f"_mk_{place(docs, text_col)}")
    return found.where(F.size(items) == 0).select(*[f"_mk_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op3_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_ids", "lcs_share", (F.size("item_ids") > 0).alias("contaminated"), (F.size("item_ids") == 0).alias("kept"))
