"""Digest trees, their proofs and changes against a plain version; order by UTF-16 units."""

import hashlib

from pyspark.sql import functions as F

from marlstone.functions.text import utf16_sorted
from marlstone.operators import graph, merkle, relational


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def units(s):
    return s.encode("utf-16-be")


def plain_line(path, content):
    return path + "\0" + ("" if content is None else "sha256:" + sha(content))


def plain_root(files):
    buckets = {}
    for path, content in files:
        buckets.setdefault(sha(path)[: merkle.DIGITS], []).append(plain_line(path, content))
    now = {k: sha("\n".join(sorted(v, key=units))) for k, v in buckets.items()}
    for level in range(merkle.DIGITS - 1, -1, -1):
        above = {}
        for k in sorted(now):
            above.setdefault(k[:level], []).append(f"{k}:{now[k]}")
        now = {k: sha("\n".join(v)) for k, v in above.items()}
    return "sha256:" + now.get("", sha(""))


def rows(spark, files):
    return merkle.lines(spark.createDataFrame(files, "path string, text string"), F.col("path"), F.col("text").cast("binary"))


FILES = [(f"d{i % 7}/f{i}.md", f"text {i % 50}") for i in range(300)] + [("ﬁ.md", ""), ("😀.md", "x"), ("null.md", None), ("twice.md", "1"), ("twice.md", "2"), ("twice.md", "2")]


def test_root_and_updates(spark):
    before = merkle.tree(rows(spark, FILES))
    assert merkle.root(before).first().tree_hash == plain_root(FILES)
    after = [(p, "edited" if p.startswith("d3/f1") else t) for p, t in FILES if p not in ("d1/f1.md", "😀.md")] + [("new.md", "n")]
    changed = spark.createDataFrame([(p,) for p, _ in set(FILES) ^ set(after)], "path string")
    nodes = merkle.updated(before, rows(spark, after), changed)
    assert merkle.root(nodes).first().tree_hash == plain_root(after)
    again = merkle.tree(rows(spark, after))
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))


def test_no_files_and_the_last_file_gone(spark):
    none = merkle.tree(rows(spark, []))
    assert merkle.root(none).first().tree_hash == plain_root([])
    one = merkle.updated(none, rows(spark, FILES[:1]), rows(spark, FILES[:1]))
    assert merkle.root(one).first().tree_hash == plain_root(FILES[:1])
    assert merkle.root(merkle.updated(one, rows(spark, []), rows(spark, FILES[:1]))).first().tree_hash == plain_root([])


def test_proofs(spark):
    r = rows(spark, FILES)
    nodes = merkle.tree(r)
    asked = spark.createDataFrame([("d1/f1.md",), ("😀.md",), ("twice.md",), ("gone.md",)], "path string")
    p = merkle.proofs(nodes, r, asked)
    found = p.withColumn("root", merkle.proven_root(F.col("path"), F.col("line"), F.col("bucket"), F.col("way"))).collect()
    assert sorted(x.path for x in found) == ["d1/f1.md", "twice.md", "twice.md", "twice.md", "😀.md"]
    for x in found:  # a plain check of each proof
        digest, key = sha("\n".join(x.bucket)), sha(x.path)
        assert x.line in x.bucket
        for i, step in enumerate(x.way):
            assert f"{key[: merkle.DIGITS - i]}:{digest}" in step
            digest = sha("\n".join(step))
        assert "sha256:" + digest == x.root == plain_root(FILES)


def test_a_proof_of_something_else_has_no_root_or_another(spark):
    r = rows(spark, FILES)
    p = merkle.proofs(merkle.tree(r), r, spark.createDataFrame([("d1/f1.md",)], "path string"))
    root = lambda path, line, bucket, way: p.select(merkle.proven_root(path, line, bucket, way)).first()[0]
    path, line, bucket, way = (F.col(c) for c in ("path", "line", "bucket", "way"))
    other = F.concat(line, F.lit("0"))
    assert root(F.lit("d1/f8.md"), line, bucket, way) is None
    assert root(path, other, bucket, way) is None
    assert root(path, other, F.array(other), way) is None
    assert root(path, line, bucket, F.slice(way, 1, merkle.DIGITS - 1)) is None
    assert root(path, line, bucket, way) == plain_root(FILES)


def test_units_of_utf_16(spark):
    df = spark.createDataFrame([(["ﬁ", "😀", None, "z", ""],)], "x array<string>")
    assert df.select(utf16_sorted(F.col("x"))).first()[0] == ["", "z", "😀", "ﬁ", None]
    concepts = spark.createDataFrame([("ﬁ.md", "ﬁ", ""), ("😀.md", "😀", "")], "path string, title string, description string")
    text = graph.directory_indexes(concepts, normalise=False).first().index_text
    assert text.index("😀") < text.index("ﬁ")
    files = spark.createDataFrame([("k", "ﬁ", "a"), ("k", "😀", "b")], "key string, path string, text string")
    parts = {}
    for name, content in (("ﬁ", "a"), ("😀", "b")):
        parts.setdefault(sha(name)[:3], []).append(f"{name}\0{sha(content)}")
    lines = sorted(f"{k}:" + sha("\n".join(sorted(v, key=units))) for k, v in parts.items())
    assert relational.tree_hash(files, "key", "path", "text").first().tree_hash == "sha256:" + sha("\n".join(lines))
