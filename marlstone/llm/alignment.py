"""Alignment of two tokenizers' tokens by the byte offsets at which both end one.

Texts are read twice, as batches. The first reading counts the pairs of linked tokens, the
second looks the counts up and gives each document its sums and groups; between them stands
the table of pairs alone, a row for two ids ever linked, so that neither texts nor tokens are
shuffled. The PAIRS most frequent pairs are sent to all tasks; links of other pairs leave a
document as rows and meet their counts by a join.

Both tokenizers always split before a single space between two letters, digits or
punctuation marks (checked on the vocabulary of the pieces; else texts stay whole), so the
tokens of a text are those of its parts in a row, and those of parts in a row are tokenised at
once. Each distinct part of a batch is tokenised and aligned once and counts as often as it
occurs; the tokens of the FREQUENT most frequent short parts of some sampled texts are sent
to all tasks and only looked up (which saves time and changes no result).

In a batch, all ends of tokens of either side stand on one line of bytes. Each end of either
side is a link, of the two tokens that cover the bytes before it, so that links need no pairs
within a group; the running count of the common ends is the group.

A text that is null or empty, or whose tokens' bytes of either side aren't a space and the
text, has no tokens: zeros and an empty string. Very long texts without such spaces are one
part. Rows that repeat an id or a text, or have a null id, are rows of their own; ties of the
highest count all count as highest. An empty table gives an empty result. Columns other
than doc_id and text, whatever their names, are not looked at.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, documents, in_batches, numbered, place, rolled_sample, stash

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts whose tokens are sent to all tasks, at most, the bytes of each, at most, and the documents they are counted in.
FREQUENT, SHORT, SAMPLED = 1 << 18, 64, 4096
#: Pairs sent to all tasks, at most.
PAIRS = 1 << 20
#: Before a single space between letters, digits or punctuation of any script.
BREAK = r"(?<=[\p{L}\p{N}\p{P}])(?= [\p{L}\p{N}\p{P}])"
INNER = np.array([i < 128 and unicodedata.category(chr(i))[0] in "LNP" for i in range(256)])
#: Ids are under 2**SHIFT; a pair is a * 2**SHIFT + b.
SHIFT = 24
#: Bytes of texts whose parts are told apart together, and of parts tokenised at once.
GATHERED, JOINED = BATCH_BYTES // 2, 2048
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@cache
def byte_bpe(path: str):
    """A function from texts to lists of ids, and each id's bytes; special tokens' strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    words = found.get_vocab()
    table = [b""] * (max(words.values()) + 1)
    for word, i in words.items():
        table[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
    return lambda texts: [x.ids for x in found.encode_batch_fast(texts, add_special_tokens=False)], table


@cache
def pieces(path: str):
    """The same of a model of pieces, which puts a space before the text."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(p[3:5], 16)]) if found.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, found.id_to_piece(i)) for i in range(found.vocab_size()))]
    return lambda texts: found.encode([x[1:] for x in texts], num_threads=1), table


def breakable(path: str) -> bool:
    """Whether no piece has a space behind another character."""
    return not any(b" " in x.lstrip(b" ") for x in pieces(path)[1])


def layout(x: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of the strings, and their bytes with four zeros behind them."""
    edges = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    return edges, np.concatenate([np.frombuffer(x.buffers()[2], np.uint8)[: edges[-1]], np.zeros(4, np.uint8)])


def cut_anew(x: pa.StringArray, edges: np.ndarray) -> pa.StringArray:
    """The strings between other offsets of the same bytes."""
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), x.buffers()[2])


def inner(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter, digit or punctuation mark begins at these places of UTF-8 bytes."""
    lead = data[at].astype(np.int64)
    out, wide = INNER[lead], np.flatnonzero(lead > 127)
    lead, (x, y, z) = lead[wide], ((data[at[wide] + i] & 63).astype(np.int64) for i in (1, 2, 3))
    points = np.where(lead < 0xE0, (lead & 31) << 6 | x, np.where(lead < 0xF0, (lead & 15) << 12 | x << 6 | y, (lead & 7) << 18 | x << 12 | y << 6 | z))
    kinds, which = np.unique(points, return_inverse=True)
    out[wide] = np.array([unicodedata.category(chr(i))[0] in "LNP" for i in kinds], bool)[which]
    return out


def before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the character begins that ends at these places."""
    at = at - 1
    for _ in range(3):
        at = at - ((data[at] & 0xC0) == 0x80)
    return at


def parts_in(texts: pa.StringArray, whole: bool) -> tuple[pa.StringArray, np.ndarray]:
    """The parts of a space and each text, none empty, in a row, and the place of each text's first (and of the end)."""
    full = pc.binary_join_element_wise("", texts, " ")
    starts, data = layout(full)
    edges = starts
    if not whole:
        at = np.flatnonzero(data == 32)
        at = at[inner(data, at + 1)]
        begins = np.zeros(len(data), bool)
        begins[at[inner(data, before(data, at))]] = begins[starts] = True
        edges = np.flatnonzero(begins)
    return cut_anew(full, edges), np.searchsorted(edges, starts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the values in each stretch; a stretch may be empty."""
    return np.diff(np.concatenate([[0], np.cumsum(values.astype(np.int64))])[starts])


def stretches(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of the stretches at, in a row."""
    n = np.diff(starts)[at]
    return np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def encoded(load, path: str, parts: pa.StringArray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all parts, where each part's begin, and whether their bytes are the part's (else it has no ids). joint: which parts can stand behind another; these come first."""
    encode, table = load(path)
    edges, _ = layout(parts)
    block = edges[:-1] // JOINED
    head = np.ones(len(parts), bool)
    head[1:] = (block[1:] != block[:-1]) | ~joint[1:]
    good = np.ones(len(parts), bool)

    def spelt(some: pa.StringArray) -> tuple[list, list[bool]]:
        texts = some.to_pylist()
        lists = encode(texts)
        return lists, [b"".join([table[i] for i in x]) == t.encode() for x, t in zip(lists, texts, strict=True)]

    heads = np.flatnonzero(head)
    lists, right = spelt(cut_anew(parts, edges[np.append(heads, len(parts))]))
    if not all(right):  # what isn't right as a whole goes part by part
        wrong = stretches(np.append(heads, len(parts)), np.flatnonzero(~np.array(right)))
        alone, right_alone = spelt(parts.take(pa.array(wrong)))
        good[wrong] = right_alone
        found = [(h, x) for h, x, r in zip(heads, lists, right, strict=True) if r] + [(h, x if r else []) for h, x, r in zip(wrong, alone, right_alone, strict=True)]
        lists = [x for _, x in sorted(found, key=lambda x: x[0])]
    ids = np.fromiter(chain.from_iterable(lists), np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes(load, path)[ids])])
    edges = np.concatenate([[0], np.cumsum(np.diff(edges) * good)])
    starts = np.searchsorted(ends, edges)
    if not np.array_equal(ends[np.minimum(starts, len(ends) - 1)], edges):
        if not joint.any():
            raise RuntimeError("tokens don't end with their part")
        return encoded(load, path, parts, np.zeros(len(parts), bool))
    return ids, starts, good


@cache
def sizes(load, path: str) -> np.ndarray:
    """The number of bytes of each id."""
    return np.array([len(x) for x in load(path)[1]], np.int64)


class Memo(NamedTuple):
    """Parts whose tokens are known: of each side the ids in a row, and where each part's begin."""

    parts: pa.StringArray
    sides: list[tuple[np.ndarray, np.ndarray]]


class Found(NamedTuple):
    """Distinct parts, in an order of their own, rank the new places of those given."""

    rank: np.ndarray
    good: np.ndarray  # whether a part's tokens have its bytes; else it has none
    ids: list[np.ndarray]  # of each side, in a row
    n: list[np.ndarray]  # tokens of each part
    ends: list[np.ndarray]  # where each token ends
    part: np.ndarray  # of each link
    pair: np.ndarray
    common: np.ndarray  # where both sides end
    n_groups: np.ndarray


def matched(given: pa.StringArray, paths: list[str], whole: bool, memo: Memo | None) -> Found:
    """Distinct parts tokenised, or looked up, and aligned."""
    at = np.full(len(given), -1) if memo is None else pc.fill_null(pc.index_in(given, value_set=memo.parts), -1).to_numpy(zero_copy_only=False)
    edges, data = layout(given)
    joint = np.zeros(len(given), bool) if whole else inner(data, edges[:-1] + 1) & inner(data, before(data, edges[1:]))
    order = np.argsort(np.where(at >= 0, 2, ~joint), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    new = int((at < 0).sum())
    known, parts = at[order[new:]], given.take(pa.array(order[:new]))
    ids, n, good = [], [], np.ones(len(order), bool)
    for i, (load, path) in enumerate(zip((byte_bpe, pieces), paths, strict=True)):
        own, starts, right = encoded(load, path, parts, joint[order[:new]]) if new else (np.zeros(0, np.int64), np.zeros(1, np.int64), np.ones(0, bool))
        counts = np.diff(starts)
        if len(known):
            its, begins = memo.sides[i]
            own, counts = np.concatenate([own, its[stretches(begins, known)]]), np.concatenate([counts, np.diff(begins)[known]])
        good[:new] &= right
        ids.append(own)
        n.append(counts)
    ids = [x[np.repeat(good, c)] for x, c in zip(ids, n, strict=True)]
    n = [c * good for c in n]
    ends = [np.cumsum(sizes(load, path)[x]) for load, path, x in zip((byte_bpe, pieces), paths, ids, strict=True)]
    line = np.sort(np.concatenate(ends), kind="stable")
    common = line[1:][line[1:] == line[:-1]]
    line = line[np.append(line[1:] != line[:-1], True)[: len(line)]]
    until = np.cumsum(np.diff(edges)[order] * good)
    a, b = (x[np.searchsorted(e, line)] for x, e in zip(ids, ends, strict=True))
    per = np.diff(np.concatenate([[0], np.searchsorted(line, until, "right")]))
    return Found(rank, good, ids, n, ends, np.repeat(np.arange(len(order)), per), a << SHIFT | b, common, np.diff(np.concatenate([[0], np.searchsorted(common, until, "right")])))


@cache
def signed(most: int) -> pa.StringArray:
    """The ids under most behind each sign."""
    return pa.array([f"{sign}{i}" for sign in ";|," for i in range(most)], pa.string())


def shown(x: Found) -> pa.StringArray:
    """The groups of each part as text, a semicolon before each."""
    group = [np.searchsorted(x.common, e) for e in x.ends]
    number = np.concatenate([group[0] * 2, group[1] * 2 + 1])
    order = np.argsort(number, kind="stable")
    ids, number = np.concatenate(x.ids)[order], number[order]
    first = np.append(True, number[1:] != number[:-1])[: len(number)]
    most = int(ids.max(initial=0)) + 1
    most = 1 << most.bit_length()
    texts = signed(most).take(pa.array(np.where(first, number % 2, 2) * most + ids))
    return cut_anew(texts, layout(texts)[0][np.concatenate([[0], np.cumsum(x.n[0] + x.n[1])])]) if len(ids) else pa.array([""] * len(x.good))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, as many at once as make GATHERED bytes."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if held and (batch is None or sum(x.nbytes for x in held) >= GATHERED):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []


class Texts(NamedTuple):
    """A batch's texts that aren't null or empty."""

    there: np.ndarray  # which of the batch's rows
    index: np.ndarray  # the part at each place
    first: np.ndarray  # the place of each text's first part
    fine: np.ndarray  # whether all its parts have tokens
    found: Found


def read(texts: pa.StringArray, paths: list[str], whole: bool, memo: Memo | None) -> Texts | None:
    there = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    if not there.true_count:
        return None
    parts, first = parts_in(texts.filter(there), whole)
    each = parts.dictionary_encode()
    found = matched(each.dictionary, paths, whole, memo)
    index = found.rank[each.indices.to_numpy()]
    return Texts(np.flatnonzero(there.to_numpy(zero_copy_only=False)), index, first, sums(~found.good[index], first) == 0, found)


def parts_of(text, whole: bool):
    """The parts of a space and the text; no text, no parts."""
    full = F.concat(F.lit(" "), text)
    return F.when(F.length(text) > 0, F.array(full) if whole else F.split(full, BREAK))


def often(base: DataFrame, total: int, paths: list[str], whole: bool) -> Memo | None:
    """The tokens of the most frequent short parts of some texts."""
    some = rolled_sample(base.where(F.octet_length("text") <= 1 << 20), SAMPLED, total, 12)
    counted = some.select(F.explode(parts_of(F.col("text"), whole)).alias("part")).where(F.octet_length("part") <= SHORT).groupBy("part").agg(F.count("*").alias("times"))
    few = stash(counted.orderBy(F.desc("times"), "part").limit(FREQUENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            x = matched(batch["part"], paths, whole, None)
            sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(i)) for i, n in zip(x.ids, x.n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["part"], *[s.take(pa.array(x.rank)) for s in sides]], ["part", "a", "b"])

    rows = in_batches(few.select("part"), run, "part string, a array<long>, b array<long>").where("size(a) > 0").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    part, a, b = (rows[c].combine_chunks() for c in ("part", "a", "b"))
    part, a, b = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (part, a, b))
    return Memo(part.cast(pa.string()), [(x.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))])) for x in (a, b)])


def counted_pairs(base: DataFrame, paths: list[str], whole: bool, memo) -> DataFrame:
    """pair, count of all links, and best: 1 where no pair of its b has a higher count, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            if x := read(batch["text"], paths, whole, memo.value):
                times = np.bincount(x.index, np.repeat(x.fine, np.diff(x.first)), len(x.found.good))
                pair = pa.array(x.found.pair).dictionary_encode()
                count = np.bincount(pair.indices.to_numpy(), times[x.found.part], len(pair.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pair.dictionary, pa.array(count)], ["pair", "count"])

    pairs = in_batches(base.select("text"), run, "pair long, count long").where("count > 0").groupBy("pair").agg(F.sum("count").alias("count"))
    pairs = stash(pairs.withColumn("b", F.col("pair") % (1 << SHIFT)))
    highest = F.broadcast(pairs.groupBy("b").agg(F.max("count").alias("highest")))  # a row an id of the vocabulary, at most
    return stash(pairs.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")))


def summed(base: DataFrame, paths: list[str], whole: bool, memo, frequent) -> DataFrame:
    """doc_id, SUMS over the frequent pairs, groups, rare (a place a link of another pair) of each document."""
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = frequent.value
        for batch in gathered(batches):
            rows = batch.num_rows
            x = read(batch["text"], paths, whole, memo.value)
            values = {c: np.zeros(rows, np.int64) for c in SUMS}
            groups, rare = pa.array([""] * rows, pa.string()), pa.array([[]] * rows, pa.list_(pa.int64()))
            if x:
                found = x.found
                pair = pa.array(found.pair).dictionary_encode()
                asked = pair.dictionary.to_numpy()
                at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
                hit = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
                link = pair.indices.to_numpy()
                links = np.concatenate([[0], np.cumsum(np.bincount(found.part, minlength=len(found.good)))])
                own = [*found.n, found.n_groups, np.diff(links), *(sums(np.where(hit, y[at] if len(keys) else 0, 0)[link], links) for y in (best, count))]
                for c, y in zip(SUMS, own, strict=True):
                    values[c][x.there] = sums(y[x.index], x.first) * x.fine
                groups = joined(shown(found), x, rows)
                if not hit.all():
                    miss = ~hit[link]
                    begins = np.concatenate([[0], np.cumsum(miss)])[links]
                    place = x.index[np.repeat(x.fine, np.diff(x.first))]
                    n = np.zeros(rows, np.int64)
                    n[x.there] = sums(np.diff(begins)[x.index], x.first) * x.fine
                    rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(found.pair[miss][stretches(begins, place)]))
            out = pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(values[c]) for c in SUMS], groups, rare], ["doc_id", *SUMS, "groups", "rare"])
            block = layout(groups)[0][1:] // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), rows]
            yield from (out.slice(i, j - i) for i, j in zip(cuts, cuts[1:]))

    return in_batches(base, run, f"doc_id {kind}, {', '.join(f'{c} long' for c in SUMS)}, groups string, rare array<long>")


def joined(parts: pa.StringArray, x: Texts, rows: int) -> pa.StringArray:
    """The groups of each row: those of its parts in a row, without the first sign."""
    begin = pc.utf8_slice_codeunits(parts, 1)
    first, lengths = x.first[:-1], np.diff(x.first)
    index = x.index.copy()
    index[first] += len(parts)
    index = index[np.repeat(x.fine, lengths)]
    each = pa.concat_arrays([parts, begin]).take(pa.array(index))
    n = np.zeros(rows, np.int64)
    n[x.there] = lengths * x.fine
    return cut_anew(each, layout(each)[0][np.concatenate([[0], np.cumsum(n)])])


def cut_off(counts: DataFrame, column: str, most: int) -> int:
    """A count that at most `most` rows reach: from a histogram with eight steps a doubling."""
    steps = counts.groupBy(F.floor(F.log2(column) * 8).alias("step")).agg(F.min(column).alias("least"), F.count("*").alias("rows")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for x in steps:
        total += x.rows
        if total > most:
            break
        least = x.least
    return least


def aligned(docs: DataFrame, folder: str = FOLDER, kept: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (as text) of each document. kept: what to keep of the groups."""
    rows = numbered(docs)
    base = rows.select(F.col(rows.columns[place(docs, "doc_id")]).alias("doc_id"), F.col(rows.columns[place(docs, "text")]).alias("text"))
    paths = [f"{folder}/{BYTE_BPE}", f"{folder}/{PIECES}"]
    whole = not breakable(paths[1])
    context = docs.sparkSession.sparkContext
    there = base.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows")).agg(F.count("*").alias("tasks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    memo = context.broadcast(often(base, there.rows, paths, whole))
    if 2 * there.tasks <= context.defaultParallelism:  # a file of one row group would be one task
        most = max(context.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        base = base.withColumn("row", F.monotonically_increasing_id()).repartition(most, "row").drop("row")
    pairs = counted_pairs(base, paths, whole, memo)
    least = cut_off(pairs, "count", PAIRS)
    frequent = pairs.where(F.col("count") >= least).orderBy("pair").toArrow()
    found = summed(base, paths, whole, memo, context.broadcast([frequent[c].to_numpy() for c in ("pair", "count", "best")]))
    found = found.withColumn("groups", kept(F.col("groups")))
    others = pairs.where(F.col("count") < least)
    if others.isEmpty():
        return found.drop("rare")
    found = stash(found.withColumn("row", F.monotonically_increasing_id()))
    more = found.select("row", F.explode("rare").alias("pair")).join(others, "pair").groupBy("row").agg(F.sum("best").alias("_best"), F.sum("count").alias("_count"))
    both = found.drop("rare").join(more, "row", "left")
    full = {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_count", F.lit(0))}
    return both.withColumns(full).select("doc_id", *SUMS, "groups")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(documents(spark, sf_dir), kept=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256)))
    return found.withColumnRenamed("groups", "groups_sha256")
