"""Piecewise hashing against a plain version that walks byte by byte."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marlstone.llm import fuzzy_hash as fh
from marlstone.llm.queries import queries

SF = "/root/testdata/sf0.001"
MASK = 0xFFFFFFFF


def plain_hash(data, i):
    total = 0
    for j in range(fh.LOOK - 1, -1, -1):
        total = (total * fh.FACTOR + (data[i - j] if i >= j else 0) + 1) & MASK
    return total * fh.SPREAD & MASK


def plain_print(text):
    data = (text or "").encode()
    values = [plain_hash(data, i) for i in range(len(data))]

    def signature(k, most):
        out, start = "", 0
        ends = [i + 1 for i, v in enumerate(values) if v < 2**32 / 2**k][: most - 1]
        for end in [*ends, len(data)]:
            if end > start:
                x = (zlib.crc32(data[start:end]) * fh.SPREAD & MASK) >> 20
                out += fh.LETTERS[x // 64] + fh.LETTERS[x % 64]
            start = end
        return out, len(ends)

    k = 0
    while 2**k * fh.MOST < len(data):
        k += 1
    while k and signature(k, 2 * fh.MOST)[1] < fh.MOST // 4:
        k -= 1
    return f"{k}:{signature(k, 2 * fh.MOST)[0]}:{signature(k + 1, fh.MOST)[0]}"


def plain_likeness(one, two):
    if one == two:
        return 1.0
    known = []
    for x in (one, two):
        k, a, b = x.split(":")
        known.append({int(k): a, int(k) + 1: b})
    shared = sorted(known[0].keys() & known[1].keys())
    if not shared:
        return 0.0
    a, b = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (known[0][shared[0]], known[1][shared[0]]))
    if not a or not b:
        return 0.0
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 2))
    return 1 - d[-1][-1] / (len(a) + len(b))


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0]))
    out = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 4
        new = t[: len(t) - n] + f[:n]
        a, b, c = plain_print(t), plain_print(new), plain_print(f)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(((*x[:5], round(x[5], 9), round(x[6], 9)) for x in df.collect()), key=repr)


def test_query_is_the_plain_version(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    assert as_rows(queries()["op11_context_triggered_hash"](spark, SF)) == plain(zip(t["doc_id"], t["text"], strict=True))


def test_random_texts_and_blocks(monkeypatch):
    r = random.Random(1)
    for n in (0, 1, 6, 7, 63, 64, 65, 700, 5000):
        for letters in ("a", "ab", "abcdefgh é😀"):
            text = "".join(r.choice(letters) for _ in range(n))
            assert fh.fingerprint(text) == plain_print(text)
    text, whole = "".join(r.choice("abcdefgh \n") for _ in range(9000)), None
    whole = fh.fingerprint(text)
    monkeypatch.setattr(fh, "BLOCK", 100)
    assert fh.fingerprint(text) == whole


def test_odd_rows(spark, make, odd):
    distinct = [x for x in dict.fromkeys(odd) if x[0] not in (4,)] + [(4, "one")]
    found = as_rows(fh.beside_next(make(distinct).repartition(5)))
    assert found == plain(distinct)
    assert as_rows(fh.beside_next(make(distinct, extra=False).select(F.col("text").alias("TEXT"), F.col("doc_id")))) == found
    assert as_rows(fh.beside_next(make([(3, "alone in here")]))) == plain([(3, "alone in here")])
    assert fh.beside_next(make([])).collect() == []
    assert fh.fingerprints(make([])).collect() == []
    assert {x.fingerprint for x in fh.fingerprints(make([(1, None), (2, "")])).collect()} == {"0::"}


def test_repeated_rows(spark, make):
    """Copies of an id and text follow each other; a third of all rows is spread over tasks."""
    rows = [(7, f"the same text of row seven {'x' * 40}")] * 300 + [(i, f"text number {i} of these " * 9) for i in range(1000, 1600)]
    found = fh.beside_next(make(rows).repartition(6))
    assert as_rows(found) == plain(rows)


def test_likeness_tells_edits_from_strangers():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(60, 900))) for _ in range(80)]
    near = [fh.likeness(fh.fingerprint(a), fh.fingerprint(fh.edited(a, b))) for a, b in zip(texts, texts[1:], strict=False)]
    far = [fh.likeness(fh.fingerprint(a), fh.fingerprint(b)) for a, b in zip(texts, texts[1:], strict=False)]
    assert min(near) > 0.5 > 0.15 > max(far)
    assert all(fh.likeness(x, y) == fh.likeness(y, x) for x, y in zip(map(fh.fingerprint, texts), map(fh.fingerprint, texts[1:]), strict=False))
