"""Decontamination, mixing, sharding, quotations, the pipeline and what they share."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontaminate, mixing, near_dup, quotes, sharding
from marlstone.llm.common import running
from marlstone.llm.queries import queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water filling, the long way."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        out = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 2 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixing_targets_and_takes(make, odd):
    r = random.Random(3)
    rows = [(1000 + i, "w " * r.randrange(0, 60), None, r.choice(["a", "b", "c", "hot", "hot", "hot", None])) for i in range(600)] + [(5000, "w " * 900, None, "tiny")] + [(*x, None, "a") for x in odd]
    found = mixing.mix(make(rows))
    got = found.collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((x.doc_id, x["size"]) for x in got) == Counter((d, size(t)) for d, t, *_ in rows)
    source = defaultdict(int)
    for d, t, _, s in rows:
        source[s] += size(t)
    want = targets(source)
    assert sorted({round(x.target, 6) for x in got}) == sorted({round(v, 6) for v in want.values()})
    assert all(x.taken in (0, x["size"], 2 * x["size"]) for x in got)
    taken = defaultdict(int)
    for x in got:
        taken[round(x.target, 6)] += x.taken
    for s, t in want.items():
        longest = max(size(x[1]) for x in rows if x[3] == s)
        assert abs(taken[round(t, 6)] - t) <= max(2 * longest, 60)
    assert sum(x.taken for x in got) <= 1.5 * sum(source.values())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(make(rows).repartition(7)).collect()))


def test_mixing_is_its_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, queries()["op4_weighted_fair_mix"](spark, SF).collect())) == sorted(c.sql(mixing.ORACLE_SQL).fetchall())


def test_mixing_of_repeated_and_null_ids(spark, make, tmp_path):
    """Every row has a place of its own: the takes are the SQL's, and the stage writes the words that the mix takes."""
    r = random.Random(6)
    rows = [(None, "w " * r.randrange(1, 40), None, "a") for _ in range(300)] + [(7, "same text of seven words in all", None, "b")] * 400 + [(i % 20, "w " * r.randrange(1, 40), None, r.choice("abc")) for i in range(300)]
    docs = make(rows, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    order = lambda x: sorted(x, key=repr)
    found = [tuple(x) for x in queries()["op4_weighted_fair_mix"](spark, str(tmp_path)).collect()]
    assert order(found) == order(c.sql(mixing.ORACLE_SQL).fetchall())
    source = Counter()
    for _, t, _, s in rows:
        source[s] += len(t.split())
    for s, t in targets(source).items():
        assert abs(sum(x[4] for x in found if abs(x[3] - t) < 1e-6) - t) <= 80, s
    written = corpus_pipeline.mixing_stage(spark, docs.repartition(6), "")
    assert sum(len(x.text.split()) for x in written.collect()) == sum(x[4] for x in found)


def test_mixing_without_words(make):
    assert mixing.mix(make([])).collect() == []
    assert [x.taken for x in mixing.mix(make([(1, None), (2, " ")])).collect()] == [0, 0]


def test_running_sums(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"), F.floor(F.col("id") / 37).alias("b"))
    got = {x.id: x.s for x in running(df, ["k"], "b", [F.col("id")], F.col("id"), "s").collect()}
    assert all(got[i] == sum(j for j in range(i + 1) if j % 3 == i % 3) for i in range(1000))


def check_shards(rows, got, shards=24):
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return slots


def test_sharding(spark, make, odd):
    r = random.Random(5)
    rows = [(i, "t" * r.randrange(10, 4000)) for i in range(2000)]
    rows += [(3000 + i, "hot copy " * 100) for i in range(1000)] + [(5000 + i, "small group") for i in range(20)]  # a third of all rows are copies of one text
    got = sharding.assign(make(rows), 24).collect()
    slots = check_shards(rows, got)
    total = Counter()
    for x in got:
        total[x.shard] += x["size"]
    assert max(total.values()) < 1.03 * sum(total.values()) / 24 and min(total.values()) > 0.97 * sum(total.values()) / 24
    assert max(map(len, slots.values())) < 1.1 * len(rows) / 24
    assert len({x.shard for x in got if x.doc_id >= 5000}) == 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.assign(make(rows).repartition(5), 24).collect()))
    check_shards(odd, sharding.assign(make(odd), 24).collect())
    assert sharding.assign(make([]), 24).collect() == []
    whole = sharding.shard_documents(make(odd), 3)
    assert whole.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and whole.columns.count("shard") == 1 and whole.count() == len(odd)


@pytest.mark.parametrize("doc_id", [7, None])
def test_sharding_of_repeated_and_null_ids(make, doc_id):
    """Half of all rows are one row over and over: bytes and rows are near equal all the same."""
    r = random.Random(5)
    rows = [(doc_id, "one row over and over " * 12)] * 3000 + [(10_000 + i, "t" * r.randrange(100, 400)) for i in range(3000)]
    got = sharding.assign(make(rows), 24).collect()
    slots = check_shards(rows, got)
    total = Counter()
    for x in got:
        total[x.shard] += x["size"]
    mean = sum(total.values()) / 24
    assert max(total.values()) < 1.03 * mean and min(total.values()) > 0.97 * mean
    assert max(map(len, slots.values())) < 1.1 * len(rows) / 24 and min(map(len, slots.values())) > 0.9 * len(rows) / 24


def test_levelling_keeps_all_dimensions(spark):
    got = sharding.assign(spark.read.parquet(f"{SF}/documents.parquet"), 24).collect()
    for value, most in ((lambda x: x["size"], 0.002), (lambda x: x.tokens, 0.02), (lambda x: 1, 0.03)):
        total = Counter()
        for x in got:
            total[x.shard] += value(x)
        mean = sum(total.values()) / 24
        assert max(abs(v - mean) for v in total.values()) <= most * mean


def test_equal_texts_of_the_tables_share_a_shard(spark):
    """No text of sf0.01 is over a shard, so that none has two."""
    got, mean = queries()["op8_vector_packed_shards"](spark, SF).collect(), 0
    by, size = defaultdict(set), Counter()
    for x in got:
        by[x.text_crc32].add(x.shard)
        size[x.text_crc32] += x["size"]
    mean = sum(size.values()) / 24
    assert max(size.values()) <= mean and max(map(len, by.values())) == 1
    assert max(size.values()) > mean / 4


def test_sharding_by_brute_force(spark, make):
    """The operator's packing against its rule, followed plainly: every group whole or, over a shard, in pieces."""
    r = random.Random(8)
    texts = [" ".join("xyz"[: r.randrange(1, 4)] for _ in range(r.randrange(1, 200))) for _ in range(400)]
    rows = [(i, texts[min(int(r.paretovariate(0.7)), 399)]) for i in range(3000)]
    got = sharding.assign(make(rows), 6).collect()
    by = defaultdict(set)
    for x, t in ((x, dict(rows)[x.doc_id]) for x in got):
        by[t].add(x.shard)
    weight, total = defaultdict(lambda: np.zeros(3)), np.zeros(3)
    for _, t in rows:
        v = np.array([len(t) + 8, len(t.split()), 1])
        weight[t] += v
        total += v
    assert all(len(s) == 1 for t, s in by.items() if (weight[t] * 6 <= total).all()) and max(map(len, by.values())) > 1


def test_packing_goes_by_the_dot_product():
    v = np.array([[6, 1, 1], [6, 1, 1], [1, 6, 1], [1, 6, 1]], float)
    out = sharding.pack(v, 2, weights=(1, 1, 1))
    assert sorted(Counter(out.tolist()).values()) == [2, 2] and out[0] != out[1] and out[2] != out[3]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(spark, make, odd):
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)] + ["the", "of"] * 600
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {i: text(r.randrange(18, 130)) for i in range(25)}
    rows, want = [], {}
    for d in range(300):
        t = text(r.randrange(5, 400))
        if d % 6 == 0:
            part, at = list(items[d % 25]), r.randrange(len(t))
            if d % 12 == 0:  # a paraphrase: some words replaced, some left out
                part = [w if r.random() > 0.12 else r.choice(vocabulary) for w in part if r.random() > 0.08]
            t[at:at] = part
            want[100 + d] = d % 25
        rows.append((100 + d, " ".join(t)))
    b = bench(spark, [*((i, " ".join(w).upper()) for i, w in items.items()), (90, None), (91, "  "), (None, "x y"), (0, " ".join(items[0]).upper())])
    got = decontaminate.contaminated(make(rows + odd), b).collect()
    assert len(got) == len(rows) + len(odd)
    found = {x.doc_id: x.item_ids for x in got if x.item_ids}
    assert found == {d: [i] for d, i in want.items()}
    assert all(0 < x.lcs_share <= 1 for x in got if x.item_ids)


@pytest.mark.parametrize(("replaced", "least"), [(0.0, 1.0), (0.1, 1.0), (0.2, 0.95)])
def test_recall_of_paraphrases_by_rate(spark, make, replaced, least):
    """Passages of which a share of the words is replaced, and a third of that share left out, in documents of other words."""
    r = random.Random(int(100 * replaced))
    word = lambda: f"v{int(8000 ** r.random())}"
    items = [[word() for _ in range(r.randrange(40, 60))] for _ in range(60)]
    rows = []
    for d in range(300):
        t = [word() for _ in range(r.randrange(100, 300))]
        if d < 120:
            t[50:50] = [x if r.random() >= replaced else word() for x in items[d // 2] if r.random() >= replaced / 3]
        rows.append((d, " ".join(t)))
    got = {x.doc_id: x.item_ids for x in decontaminate.contaminated(make(rows), bench(spark, [(i, " ".join(w)) for i, w in enumerate(items)])).collect()}
    assert np.mean([got[d] == [d // 2] for d in range(120)]) >= least and not any(got[d] for d in range(120, 300))


def test_a_benchmark_of_many_blocks(spark, make, monkeypatch):
    """Blocks of a few items, several in a pass, words counted in parts: the same leaks as in one."""
    r = random.Random(12)
    word = lambda: f"v{int(8000 ** r.random())}"
    items = [[word() for _ in range(r.randrange(20, 90))] for _ in range(40)]
    rows = [(d, " ".join([word() for _ in range(60)] + (items[d % 40] if d % 2 else []) + (items[(d + 7) % 40] if d % 6 == 5 else []) + [word() for _ in range(60)])) for d in range(120)]
    b = bench(spark, [(i, " ".join(w)) for i, w in enumerate(items)])
    want = {d: sorted({d % 40} | ({(d + 7) % 40} if d % 6 == 5 else set())) if d % 2 else [] for d in range(120)}
    for size, at_once, words in ((1 << 20, 4, 1 << 22), (2000, 3, 500)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", at_once)
        monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", words)
        assert {x.doc_id: x.item_ids for x in decontaminate.contaminated(make(rows), b).collect()} == want


CLASHES = ("item_ids", "cosine", "lcs_share", "_t", "_mk_score", "_mk_row", "_mk_k1", "_mk_text", "row", "at", "taken", "src", "key", "node", "root", "k1", "page_score", "_score", "a.b")


def test_stages_carry_clashing_columns(spark, make, tmp_path):
    """Every stage keeps extra columns as they are, whatever they are called, on rows of repeated and null ids too."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    r = random.Random(2)
    rows = [(i if i % 5 else None, " ".join(f"w{r.randrange(900)}" for _ in range(r.randrange(30, 90))), "en", r.choice("ab")) for i in range(60)]
    docs = make(rows + rows[:7])
    docs = docs.toDF(*docs.columns).withColumns({c: F.xxhash64("text") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == [c for c in docs.columns if name != "sharding" or c != "shard"][: len(docs.columns)] or name == "sharding"
        got = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
        at = [out.columns.index(c) for c in ("text", *CLASHES)]
        assert got.count() > 0 and got.where(" or ".join(f"c{i} <> xxhash64(c{at[0]})" for i in at[1:])).isEmpty()


def test_decontamination_answers_and_empty(spark, make):
    words = " ".join(f"q{i}" for i in range(20))
    b = spark.createDataFrame([(1, words, "forty two")], "item_id long, text string, answer string")
    got = decontaminate.contaminated(make([(1, words), (2, words + " forty two")]), b).collect()
    assert {x.doc_id: x.item_ids for x in got} == {1: [], 2: [1]}
    assert [x.item_ids for x in decontaminate.contaminated(make([(1, words)]), bench(spark, [])).collect()] == [[]]
    assert decontaminate.contaminated(make([]), b).collect() == []


def test_copies_of_a_common_passage_at_every_offset(spark, make):
    """Passages whose words over 2 % of documents hold keep few weighted words; no alignment with the windows loses a copy."""
    r = random.Random(5)
    items = {i: [f"p{i}w{j}" for j in range(48)] for i in range(12)}
    other = lambda n: [f"h{r.randrange(30000)}" for _ in range(n)]
    rows, want = [], {}
    for i, words in items.items():
        for offset in range(16):
            want[len(rows)] = [i]
            rows.append((len(rows), " ".join(other(64 + offset) + words + other(136 - offset))))
        for _ in range(25):  # the words without their order: no copies
            want[len(rows)] = []
            rows.append((len(rows), " ".join(r.sample(words, 48))))
    got = decontaminate.contaminated(make(rows), bench(spark, [(i, " ".join(w)) for i, w in items.items()])).collect()
    assert {x.doc_id: x.item_ids for x in got} == want


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        return row[-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 80))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


def test_randomised_svd(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 200)) + 0.01 * rng.normal(size=(300, 200))
    v = decontaminate.randomised_svd(spark, [(np.arange(200), row) for row in a], 200, rank=12)
    exact = np.linalg.svd(a)[2][:12]
    assert np.linalg.norm(exact @ v) ** 2 > 11.99


MESSAGES = "conv_id long, turn long, role string, text string"


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "> hello  there\n>second line\nHi!"), (1, 2, "user", "other topic"), (1, 3, "user", ">> Hello there\n> > second line\n> Hi!\n\nThanks"), (1, 4, None, "> Thanks\nbye"),
        (1, 5, "user", "> never said\nhm"), (1, 6, "user", "> bye\n> other topic\n\n> hm\nok"), (1, 6, "user", "> bye\n> other topic\n\n> hm\nok"), (2, 0, "u", None), (2, 1, "u", "> Hello there"), (None, 1, "u", "> a"), (3, None, "u", "x"),
    ]
    m = spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit("clash") for c in ("depth", "position", "formatted", "linked", "body", "levels", "n")})
    got = quotes.conversations(m)
    assert got.count() == len(rows)
    by = {(x.conv_id, x.turn): x for x in got.collect()}
    assert {k: x.reply_to for k, x in by.items() if x.linked} == {(1, 1): 0, (1, 3): 1, (1, 4): 3, (1, 6): 5}
    assert {k: x.reply_to for k, x in by.items() if not x.linked} == {(1, 0): None, (1, 2): 1, (1, 5): 4, (2, 0): None, (2, 1): 0, (None, 1): None, (3, None): None}
    assert [x.text for x in (by[1, 1], by[1, 3], by[1, 6], by[2, 0], by[2, 1])] == ["Hi!", "Thanks", "ok", "", ""]
    assert by[1, 1].formatted == "<|assistant|>\nHi!\n<|end|>" and by[1, 3].n_quoted == 3
    chat = {(x.conv_id, tuple(x.turns)): x for x in quotes.segments(got).collect()}
    assert set(chat) == {(1, (0, 1, 3, 4, 5, 6, 2)), (2, (0, 1)), (None, (1,)), (3, (None,))}
    told = chat[1, (0, 1, 3, 4, 5, 6, 2)]
    assert [line for line in told.chat.split("\n") if not line.startswith("<|")] == ["Hello there", "second line", "Hi!", "Thanks", "bye", "hm", "ok", "other topic"] and told.n_linked == 4
    assert quotes.conversations(spark.createDataFrame([], MESSAGES)).collect() == [] and quotes.segments(quotes.conversations(spark.createDataFrame([], MESSAGES))).collect() == []


def test_partial_quotes_of_several_lines(spark):
    """Runs of lines or paragraphs of a message, whole bodies or not; lines that don't stand together in one earlier message link nothing."""
    first, second = "one a\ntwo b\nthree c\n\nfour d\nfive e\n\nsix f", "lead\ntwo b\nthree c"
    quoted = [
        ("> one a\n> two b", 0), ("> one a\n> two b\n> three c\n>\n> four d\n> five e", 0), ("> Three  c\n>\n> four d", 0), ("> two b\n> three c", 0), ("> lead\n> two b", 1),
        (">> two b\n>> three c\n>> four d", 0), ("> one a two b\n> three c\n>\n> four d five e", 0), ("> one a\n> three c", None), ("> six f\n> lead", None), ("> three c\n> two b", None), ("> seen\n> later", None),
    ]
    rows = [(1, 0, "u", first), (1, 1, "u", second)] + [(1, 2 + i, "u", f"{q}\nreply {i}") for i, (q, _) in enumerate(quoted)] + [(1, 90, "u", "x\nseen\nlater"), (2, 0, "u", second), (2, 1, "u", "> one a\n> two b")]
    got = {(x.conv_id, x.turn): x.reply_to if x.linked else None for x in quotes.conversations(spark.createDataFrame(rows + rows[:3], MESSAGES)).collect()}
    assert [got[1, 2 + i] for i in range(len(quoted))] == [o for _, o in quoted] and got[2, 1] is None


def brute_conversation(messages):
    """{turn: (origin by quotation or None, own lines)} of (turn, text) in turn order, and the turns in reply order, the plain way."""
    own, origin, order = {}, {}, []
    for turn, text in messages:
        lines, runs, last = [], [], 0
        for line in (text or "").split("\n"):
            marks = re.match(r"[ \t]*((?:>[ \t]*)*)", line)
            level, said = marks[1].count(">"), " ".join(line[marks.end():].lower().split())
            if level == 0:
                lines.append(said)
            elif last == level:
                runs[-1][1].append(said)
            else:
                runs.append((level, [said]))
            last = level
        found = []
        for level, said in runs:
            want = [x for x in said if x]
            first = next((t for t, b in own.items() if want and any(b[i : i + len(want)] == want for i in range(len(b)))), None)
            if first is not None:
                found.append((-level, first))
        origin[turn] = max(found)[1] if found else None
        own[turn] = [x for x in lines if x]
    turns = [t for t, _ in messages]
    before = dict(zip(turns[1:], turns, strict=False))
    up = {t: before.get(t) if origin[t] is None else origin[t] for t in turns}
    todo = turns[:1]
    while todo:
        t = todo.pop()
        order.append(t)
        replies = [c for c in turns if c != turns[0] and up[c] == t]
        todo += sorted(replies, key=lambda c: (origin[c] is not None, -c))
    return origin, order


def test_conversations_by_brute_force(spark):
    """Generated quoting of whole and partial bodies at several levels: links, reply order and text."""
    r = random.Random(4)
    rows = []
    for c in range(25):
        own, shown = [], []
        for turn in range(0, 40 if c < 2 else 12):
            source = r.choice(shown) if shown and r.random() < 0.6 else []
            n = r.randrange(1, 5)
            at = r.randrange(max(1, len(source)))
            q = source[at : at + n] if r.random() < 0.7 else [r.choice("abcd") for _ in range(n)]
            body = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(1, 9))]
            mark = r.choice(["> ", ">", ">> ", "> > "])
            lines = "".join(mark + x + "\n" + r.choice(["", "", mark.strip() + "\n"]) for x in q) if r.random() < 0.7 else ""
            rows.append((c, 3 * turn + c % 2, "u", lines + "".join(x + r.choice(["\n", "\n", "\n\n"]) for x in body)))
            own.append(body)
            shown.append(body)
    got = quotes.conversations(spark.createDataFrame(rows, MESSAGES))
    by, told = defaultdict(list), {x.conv_id: x for x in quotes.segments(got).collect()}
    for x in got.collect():
        by[x.conv_id].append(x)
    branched = 0
    for c, found in by.items():
        origin, order = brute_conversation([(t, text) for k, t, _, text in rows if k == c])
        assert {x.turn: x.reply_to if x.linked else None for x in found} == origin
        assert [x.turn for x in sorted(found, key=lambda x: x.position)] == order == told[c].turns
        assert told[c].chat == "\n".join(next(x for x in found if x.turn == t).formatted for t in order) and told[c].n_linked == sum(v is not None for v in origin.values())
        branched += order != sorted(order)
    assert branched > 15


def test_a_long_thread_and_a_hot_passage(spark):
    """Every message quotes the one before; all of a second conversation quote its first, whose words many repeat; one turn has very many messages."""
    rows = [(1, i, "u", (f"> message {i - 1}\n" if i else "") + f"message {i}") for i in range(600)] + [(2, i, "u", "> common words\nre" if i % 2 else "common words") for i in range(60)] + [(3, 5, "u", f"text {i}") for i in range(2000)]
    found = quotes.conversations(spark.createDataFrame(rows, MESSAGES))
    got = {(x.conv_id, x.turn): x for x in found.collect()}
    assert all(got[1, i].position == i and got[1, i].reply_to == (i - 1 if i else None) and got[1, i].linked == (i > 0) for i in range(600))
    assert all(got[2, i].reply_to == (0 if i % 2 else i - 1) for i in range(1, 60)) and [got[2, i].position for i in (0, 1, 2, 3, 59)] == [0, 1, 2, 3, 59]
    told = [x for x in quotes.segments(found).collect()]
    assert [x.turns for x in sorted((x for x in told if x.conv_id == 1), key=lambda x: x.segment)] == [list(range(i, min(600, i + 256))) for i in (0, 256, 512)]
    assert sum(x.n_messages for x in told if x.conv_id == 3) == 2000 and max(x.n_messages for x in told) <= 400


def test_a_very_long_message(spark):
    long = "\n".join(f"> line {i}" if i % 2 else f"own {i}" for i in range(20_000)) + " " * 200_000 + "\n" * 1000
    got = {x.turn: x for x in quotes.conversations(spark.createDataFrame([(1, 0, "u", "line 7"), (1, 1, "u", long)], MESSAGES)).collect()}
    assert got[1].n_quoted == 10_000 and got[1].reply_to == 0 and got[1].linked and got[1].text.endswith("own 19998")


def test_whole_table_of_conversations(spark):
    got = queries()["op9_quotation_threads"](spark, SF).collect()
    rows = defaultdict(list)
    for x in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[x.conv_id].append((x.turn, f"<|{x.role}|>\n{x.text.strip()}\n<|end|>"))
    assert {x.conv_id: (x.turns, x.chat) for x in got} == {c: ([t for t, _ in sorted(v)], "\n".join(y for _, y in sorted(v))) for c, v in rows.items()}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The tables with a copy, a near copy, a benchmark passage and junk put in."""
    out = tmp_path_factory.mktemp("planted")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()
    clean = next(r for r in rows.values() if r.n_chars > 2000 and "***" not in r.text and "!!" not in r.text and "|" not in r.text)
    words = clean.text.split(" ")
    words[30:31] = ["replacement"]
    new = [(900_001, clean.text), (900_002, " ".join(words)), (900_003, " ".join(rows[0].text.split(" ")[:40]) + " " + item.text + " tail of it")]
    spark.createDataFrame([(d, t, clean.lang, clean.source, len(t)) for d, t in new], docs.schema).unionByName(docs).coalesce(2).write.parquet(str(out / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(out / f"{t}.parquet"))
    return str(out), clean


def test_pipeline(spark, planted):
    sf, clean = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, sf))
        seen[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sharding":
            assert docs.columns == columns
    assert docs.columns == [*columns, "shard", "slot"]
    assert sum(x in seen["near_dedup"] for x in (clean.doc_id, 900_001, 900_002)) == 1
    assert 900_003 in seen["near_dedup"] and 900_003 not in seen["decontamination"]
    assert max(seen["mixing"].values()) == 2 and set(seen["mixing"]) <= set(seen["decontamination"])
    assert seen["sharding"] == seen["mixing"]
    slots = defaultdict(list)
    for r in docs.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_near_duplicates_of_repeated_and_null_ids(spark, make):
    """One row of each group stays, whether its rows have ids of their own, one id or none."""
    r = random.Random(8)
    texts = [" ".join(f"t{r.randrange(5000)}" for _ in range(120)) for _ in range(7)]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0] + " tail"), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[2] + " tail"), (None, texts[3]), (9, texts[3]), (8, texts[3]), (None, texts[4]), (5, "one"), (5, "one"), (None, None), (6, texts[5]), (7, texts[6])]
    got = corpus_pipeline.near_duplicate_stage(spark, make(rows).repartition(5), "").collect()
    group = {x: i for i, text in enumerate(texts) for x in (text, text + " tail")}
    kept = Counter((x.doc_id, group.get(x.text, x.text)) for x in got)
    assert kept == Counter([(1, 0), (1, 1), (None, 2), (8, 3), (None, 4), (5, "one"), (None, None), (6, 5), (7, 6)])
    found = near_dup.near_duplicates(make(rows)).collect()
    assert sorted(repr((x.doc_id, x.component_id, x.kept)) for x in found) == sorted(repr(x) for x in [(1, 1, True)] * 4 + [(None, None, True)] * 3 + [(None, 8, False), (9, 8, False), (8, 8, True), (None, None, True), (5, 5, True), (5, 5, True), (None, None, True), (6, 6, True), (7, 7, True)])
    names = near_dup.near_duplicates(make(rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))).collect()
    assert sorted(repr((x.doc_id, x.component_id)) for x in names) == sorted(repr((x.doc_id and f"d{x.doc_id}", x.component_id and f"d{x.component_id}")) for x in found)
    alone = corpus_pipeline.near_duplicate_stage(spark, make([(i, text) for i, (_, text) in enumerate(rows) if text]), "").collect()
    assert Counter(group.get(x.text, x.text) for x in alone) == Counter([*range(7), "one"])


def test_pipeline_of_odd_rows(spark, make, odd, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    for rows in (odd, []):
        docs = make(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stash(stage(spark, docs, str(tmp_path)))
        assert docs.columns.count("shard") == 1
