import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import near_dup
from marlstone.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    rows, k = [], 100
    for size in (4, 12, 60, 150):
        base = [r.choice(vocabulary) for _ in range(size)]
        for _ in range(12):  # near copies of a common origin, some within and some beyond the threshold
            t = list(base)
            for _ in range(r.randrange(0, max(2, size // 25))):
                t[r.randrange(size)] = r.choice(vocabulary)
            rows.append((k := k + 1, " ".join(t).replace("w1", "W1")))
    chain = [f"c{i}" for i in range(120)]
    for step in range(12):  # each links with the next only
        t = list(chain)
        for j in range(step * 2):
            t[(j * 7) % 120] = f"z{j}"
        rows.append((k := k + 1, "  ".join(t)))
    rows += [(k + i + 1, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(40)]
    r.shuffle(rows)
    return rows


def test_same_as_brute_force_with_odd_rows(make, odd):
    rows = odd + corpus()
    got = near_dup.near_duplicates(make(rows), shingle=3, threshold=0.85).collect()
    assert len(got) == len(rows)
    want = brute(rows, 3, 85)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]


def test_empty_table(make):
    assert near_dup.near_duplicates(make([])).collect() == []


def test_full_comparison_finds_links_between_components(spark):
    """Members that no pivot joined are compared in full, in the first bucket that they share."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(30):
        t = list(base)
        for j in range(i // 2):
            t[(13 * j) % 200] = f"x{j}"
        texts.append((i, " ".join(t)))
    rows = near_dup.bands_for(0.85)
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"k1": F.col("doc_id"), "k2": F.col("doc_id")})
    sig = near_dup.signatures(docs, 3, rows).withColumnRenamed("doc_id", "node").cache()
    members = sig.select("node", F.explode("bands").alias("key"), F.col("node").alias("root"))
    for sigmas in (near_dup.SIGMAS, None):
        edges = near_dup.compared(members, sig, docs.select(F.col("doc_id").alias("node"), "text"), 3, 85.0, sigmas)
        roots = {x.node: x.root for x in components(edges).collect()}
        assert {d: roots.get(d, d) for d, _ in texts} == {d: v[1] for d, v in brute(texts, 3, 85).items()}
    assert r


def test_re_used_ids_with_other_texts(make):
    """A row is told apart by id and text: an id's rows can be in several components, all of which have its number."""
    rows = [(i % 7, t) for i, (_, t) in enumerate(corpus(3))]
    got = near_dup.near_duplicates(make(rows), shingle=3, threshold=0.85).collect()
    want = brute(list(enumerate(t for _, t in rows)), 3, 85)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[want[i][1]] = min(least.get(want[i][1], d), d)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((d, want[i][0], least[want[i][1]]) for i, (d, _) in enumerate(rows))


def test_signature_agreement_is_the_similarity():
    rng = np.random.default_rng(0)
    with np.errstate(over="ignore"):
        for share in (0.3, 0.6, 0.9):
            got = []
            for _ in range(60):
                e = rng.integers(0, 2**63, 400, dtype=np.uint64)
                cut = int(400 * (1 - share) / (1 + share) / 2 * 1.0 * (1 + share) / 1)
                a, b = e[: 400 - cut], e[cut:]
                real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                got.append(np.mean(near_dup.super_minhash(a) == near_dup.super_minhash(b)) - real)
            assert abs(np.mean(got)) < 0.02 and np.std(got) < (0.25 / near_dup.SLOTS) ** 0.5 * 1.2


@pytest.mark.parametrize("n", [1, 2, 5, 50, 2000])
def test_signature_is_full_for_any_size(n):
    with np.errstate(over="ignore"):
        s = near_dup.super_minhash(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert np.isfinite(s.view(np.float64)).all()


def test_sets_are_exact():
    with np.errstate(over="ignore"):
        texts = [t for _, t in corpus(7)] + ["A b C", "a B c", "", None, "x"]
        sets = list(near_dup.sets(pa.array(texts), 3))
    for t, s in zip(texts, sets, strict=True):
        assert len(s) == len(shingles(t, 3))
    assert (sets[-5] == sets[-4]).all()


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 3)], "a long, b long")
    assert {r.node: r.root for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7}


def test_wide_buckets_are_dealt_by_rare_shingles(spark, monkeypatch):
    """Every open bucket is taken as a wide one: the links are those of brute force."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 1)
    near_dup.linked.__defaults__, kept = (0,), near_dup.linked.__defaults__
    try:
        for seed in (1, 5):
            rows = corpus(seed)
            r = random.Random(seed)
            base = [f"b{i}" for i in range(160)]
            for i in range(40):  # about at the threshold of a common origin, so that pivots leave the bucket open
                t = list(base)
                for j in r.sample(range(160), 4 + i % 4):
                    t[j] = f"y{i}x{j}"
                rows.append((9000 + i, " ".join(t)))
            got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=0.85).collect()
            want = brute(rows, 3, 85)
            assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == want
    finally:
        near_dup.linked.__defaults__ = kept


def test_rare_shingles_of_similar_sets_meet(spark):
    """Texts of one boilerplate: those that are similar share a key, and the boilerplate itself deals nobody together."""
    r = random.Random(7)
    common = [f"c{i}" for i in range(300)]
    texts = [(i, " ".join(common + [f"u{i}w{j}" for j in range(90)])) for i in range(400)]  # similarity 0.6 to each other
    near = [(1000 + i, t.replace("c150 ", f"z{r.random()} ")) for i, t in texts[:50]]
    docs = spark.createDataFrame(texts + near, "node long, text string")
    keys = {}
    for x in near_dup.prefixed(docs, 3, 85.0).collect():
        keys.setdefault(x.key, set()).add(x.node)
    together = {(a, b) for v in keys.values() if len(v) > 1 for a in v for b in v if a < b}
    assert together >= {(i, 1000 + i) for i in range(50)} and len(together) < 200


def test_prefixes_are_long_enough(spark):
    """Random sets at every similarity: a pair at or above the threshold shares a rare shingle."""
    r = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(8, 120))]
        other = [w if r.random() > 0.03 * (i % 4) else f"q{r.randrange(400)}" for w in base]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    keys = {}
    for x in near_dup.prefixed(spark.createDataFrame(rows, "node long, text string"), 3, 80.0).collect():
        keys.setdefault(x.node, set()).add(x.key)
    sets = {d: shingles(t, 3) for d, t in rows}
    similar = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(similar) > 15 and all(keys[a] & keys[b] for a, b in similar)
