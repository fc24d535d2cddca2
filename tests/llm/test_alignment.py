"""Token alignment against a plain version that tokenises whole texts and compares all byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.llm import alignment as al
from marlstone.llm.queries import queries

SF = "/root/testdata/sf0.001"
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def plain(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{al.FOLDER}/{al.BYTE_BPE}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{al.FOLDER}/{al.PIECES}")
    bytes_of = al.byte_bpe(f"{al.FOLDER}/{al.BYTE_BPE}")[1]
    made, counts = [], Counter()
    for text in texts:
        made.append(None)
        if not text:
            continue
        want = (" " + text).encode()
        left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
        if b"".join(bytes_of[i] for i in left) != want or b"".join(raw) != want:
            continue
        sides = []
        for ids, sizes in ((left, [len(bytes_of[i]) for i in left]), (right, [len(x) for x in raw])):
            at, spans = 0, []
            for i, n in zip(ids, sizes, strict=True):
                spans.append((at, at + n, i))
                at += n
            sides.append(spans)
        cuts = sorted({x[1] for x in sides[0]} & {x[1] for x in sides[1]})
        groups, at = [], [0, 0]
        for cut in cuts:
            groups.append([[], []])
            for n, spans in enumerate(sides):
                while at[n] < len(spans) and spans[at[n]][1] <= cut:
                    groups[-1][n].append(spans[at[n]][2])
                    at[n] += 1
        pairs, j = [], 0
        for s, e, i in sides[0]:
            while sides[1][j][1] <= s:
                j += 1
            n = j
            while n < len(sides[1]) and sides[1][n][0] < e:
                pairs.append((i, sides[1][n][2]))
                n += 1
        counts.update(pairs)
        made[-1] = (len(left), len(right), groups, pairs)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for x in made:
        if x is None:
            out.append((0,) * 6 + ("",))
        else:
            shown = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in x[2])
            out.append((x[0], x[1], len(x[2]), len(x[3]), sum(counts[y] == best[y[1]] for y in x[3]), sum(counts[y] for y in x[3]), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def got(spark, df):
    found = al.aligned(df).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)))
    return sorted(((x.doc_id, *(x[c] for c in NAMES), x.sha) for x in found.collect()), key=repr)


def test_query_is_the_plain_version(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    found = queries()["op12_token_alignment"](spark, SF)
    assert found.columns == ["doc_id", *NAMES, "groups_sha256"] and all(k == "bigint" for _, k in found.dtypes[:-1])
    assert sorted(map(tuple, found.collect())) == sorted((d, *x) for d, x in zip(t["doc_id"], plain(t["text"]), strict=True))


ODD = ["a▁b and so on", "x <|endoftext|> y </s> <unk> <s>", "tail  ", "  two  spaces ", "tab\tand\nlines \n end", "漢字 かな 漢字", "é combining ́x", "«quoted» — dash … 12 345", "only▁", " ", "a", "no break space wide", "don't we'll I'm", "\x00 nul", "same words same words", "a b c d e f g"]


def test_odd_rows(spark, make, odd):
    rows = [*odd, *[(100 + i, t) for i, t in enumerate(ODD)]]
    want = sorted(((d, *x) for (d, _), x in zip(rows, plain([t for _, t in rows]), strict=True)), key=repr)
    assert got(spark, make(rows).repartition(3)) == want
    assert al.aligned(make([])).collect() == []
    assert got(spark, make([(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("few", [1, 30])
def test_rare_parts_and_pairs_by_shuffle(spark, make, monkeypatch, few):
    """With few parts and pairs sent to all tasks, the others take the joins, with the same rows."""
    r = random.Random(few)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß.,'") for _ in range(r.randint(1, 12))) for _ in range(120)] + ["x" * 90, "▁mark"]
    rows = [(i, r.choice([" ", " ", "  ", "\n"]).join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(150)]
    monkeypatch.setattr(al, "FREQUENT", few)
    monkeypatch.setattr(al, "PAIRS", few)
    assert got(spark, make(rows, extra=False)) == sorted(((d, *x) for (d, _), x in zip(rows, plain([t for _, t in rows]), strict=True)), key=repr)


def test_no_row_carries_a_long_part(spark, make, monkeypatch):
    """A part of any length goes by a key of at most 64 bytes; a digest that stands as a text is another part."""
    from marlstone.llm import common

    lines = "line\n" * 3000
    digest = hashlib.sha256((" " + lines).encode()).hexdigest()
    rows = [(1, lines), (2, "a b"), (3, lines), (4, digest), (5, f"a {digest}"), (6, lines + " a b")]
    longest = []

    def stash(df):
        out = common.stash(df)
        if "part" in out.columns:
            longest.append(out.agg(F.max(F.octet_length("part"))).first()[0])
        return out

    monkeypatch.setattr(al, "stash", stash)
    assert got(spark, make(rows, extra=False)) == sorted(((d, *x) for (d, _), x in zip(rows, plain([t for _, t in rows]), strict=True)), key=repr)
    assert longest and max(longest) <= al.SHORT


def test_parts_joined_are_the_whole(spark, monkeypatch):
    """Splitting before tokenising changes nothing: whole texts give the same tokens as their parts."""
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pydict()["text"][:300]
    import regex

    assert al.breakable(f"{al.FOLDER}/{al.PIECES}")
    for load, path in ((al.byte_bpe, al.BYTE_BPE), (al.pieces, al.PIECES)):
        encode, _ = load(f"{al.FOLDER}/{path}")
        for text in [*t, *ODD]:
            parts = regex.split(r"(?<=[\p{L}\p{N}\p{P}])(?= [\p{L}\p{N}\p{P}])", " " + text, flags=regex.V1)
            assert "".join(parts) == " " + text
            assert [i for x in encode(parts) for i in x] == encode([" " + text])[0]


def test_neither_texts_nor_parts_are_kept_or_shuffled(spark, make, monkeypatch):
    """Between the two readings stand pairs of ids alone, and the documents leave the second without an exchange."""
    from marlstone.llm import common

    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice("aeinst") for _ in range(r.randint(2, 9))) for _ in range(60))) for i in range(200)]
    kept = []

    def stash(df):
        out = common.stash(df)
        kept.append((sorted(out.columns), out.count()))
        return out

    monkeypatch.setattr(al, "stash", stash)
    monkeypatch.setattr(al, "FREQUENT", 100)
    docs = make(rows, extra=False).repartition(2 * spark.sparkContext.defaultParallelism)
    found = al.aligned(docs)
    pairs = len({tuple(p) for x in rows for p in zip(*linked(x[1]))})
    assert kept and all(n <= max(100, pairs) for _, n in kept)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the test's own repartition
    assert sorted(map(tuple, found.drop("groups").collect())) == sorted((d, *x[:-1]) for (d, _), x in zip(rows, plain([t for _, t in rows]), strict=True))


def linked(text):
    """The ids of both sides that cover the bytes before each end."""
    found = []
    for load, path in ((al.byte_bpe, al.BYTE_BPE), (al.pieces, al.PIECES)):
        encode, table = load(f"{al.FOLDER}/{path}")
        ids = encode([" " + text])[0]
        found.append([i for i in ids for _ in table[i]])
    return found


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_parts_of_a_batch_tokenised_at_once(most, monkeypatch):
    """Parts joined, or cut off one by one where a whole isn't right, have the tokens that each has alone; looked up ones too."""
    import numpy as np
    import pyarrow as pa
    import regex

    monkeypatch.setattr(al, "JOINED", most)
    texts = [*ODD, "one ▁two three four ▁ five", "ünder çédille 漢字 ende", "😀 emoji 😀", "a" * 300 + " b", "x  y", "ab  cd", "a ́b"]
    parts, first = al.parts_in(pa.array(texts), False)
    want = [regex.split(r"(?<=[\p{L}\p{N}\p{P}])(?= [\p{L}\p{N}\p{P}])", " " + t, flags=regex.V1) for t in texts]
    assert [parts[i:j].to_pylist() for i, j in zip(first, first[1:])] == want
    paths = [f"{al.FOLDER}/{al.BYTE_BPE}", f"{al.FOLDER}/{al.PIECES}"]
    given = parts.unique()
    found = al.matched(given, paths, False, None)
    alone = [al.matched(given.slice(i, 1).take(pa.array([0])), paths, False, None) for i in range(len(given))]
    assert [bool(found.good[k]) for k in found.rank] == [bool(x.good[0]) for x in alone] and not found.good.all()
    for side in (0, 1):
        starts = np.concatenate([[0], np.cumsum(found.n[side])])
        assert [found.ids[side][starts[k] : starts[k + 1]].tolist() for k in found.rank] == [x.ids[side].tolist() for x in alone]
    some = [i for i in range(0, len(given), 2) if alone[i].good[0]]
    memo = al.Memo(given.take(pa.array(some)), [(np.concatenate([alone[i].ids[s] for i in some]), np.concatenate([[0], np.cumsum([len(alone[i].ids[s]) for i in some])])) for s in (0, 1)])
    again = al.matched(given, paths, False, memo)
    texts_of = [al.shown(x) for x in (found, again)]
    assert [texts_of[0][int(k)].as_py() for k in found.rank] == [texts_of[1][int(k)].as_py() for k in again.rank]


def test_one_row_group_is_many_tasks(spark, make, monkeypatch):
    """Rows that lie in one task are dealt out before they are tokenised."""
    docs = make([(i, f"text {i} of some words") for i in range(400)], extra=False).coalesce(1)
    assert al.aligned(docs).select(F.spark_partition_id()).distinct().count() > 1
