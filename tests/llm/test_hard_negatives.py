"""Hard negatives against every pair, on the driver's tables and on awkward rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import hard_negatives as hn
from marlstone.llm.queries import queries

KINDS = "vec_id long, embedding array<double>, label int"


def brute(rows, chosen, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = []
    for vec_id, v, label in rows:
        if vec_id is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(scale * x)) for x in v], label))
    out = []
    for i, (a, v, label) in enumerate(kept):
        if not chosen(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, lab, n) for n, (j, w, lab) in enumerate(kept) if n != i)
        for ps, p, _, _ in [x for x in scored if x[2] == label][:positives]:
            ps = -ps
            fits = [(n, -s) for s, n, lab, _ in scored if lab != label and low * ps <= -100 * s <= high * ps]
            out += [(a, p, r, n, ps, s) for r, (n, s) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def got(spark, rows, chosen=lambda c: c % 5 == 0, **named):
    df = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit("x") for c in ("score", "row", "pivot", "page", "anchor")})
    return sorted(map(tuple, hn.mine(df.repartition(3), chosen(F.col("vec_id")), **named).collect()))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_is_its_sql(spark, size):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{size}/embeddings.parquet'")
    want = sorted(c.sql(hn.ORACLE_SQL).fetchall())
    found = queries()["op13_distance_key_negatives"](spark, f"/root/testdata/{size}")
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50


def test_clusters_ties_and_many_rounds(spark, monkeypatch):
    """Tight clusters, so that annuli leave pages out; small integers, so that scores tie; small pages, blocks and slabs."""
    r = np.random.default_rng(1)
    centres = r.normal(0, 4, (12, 6))
    rows = [(i, (centres[i % 12] + np.round(r.normal(0, 0.4, 6), 1)).tolist(), int(i % 3)) for i in range(1500)]
    for name, value in (("PAGE", 32), ("BLOCK", 16), ("SLAB", 3), ("SAMPLE", 128), ("PIVOTS", 9)):
        monkeypatch.setattr(hn, name, value)
    assert got(spark, rows, scale=2.0) == brute(rows, lambda a: a % 5 == 0, scale=2)
    assert got(spark, rows, scale=2.0, positives=2, negatives=7, low=90, high=100) == brute(rows, lambda a: a % 5 == 0, 2, 7, 90, 100, 2)


def test_pages_beyond_the_annulus_are_not_read(spark):
    """Far clusters: with the key bound, most pages meet no anchor's annulus."""
    r = np.random.default_rng(2)
    centres = np.eye(16) * 50
    rows = [(i, (centres[i % 16] + r.normal(0, 0.3, 16)).tolist(), int(i % 2)) for i in range(4000)]
    df = spark.createDataFrame(rows, KINDS).withColumn("chosen", F.lit(True))
    known = hn.space(hn.usable(df, 1.0), 1.0)
    pages = hn.index(df, known, 1.0, 4096)
    blocks = hn.packed(hn.anchors_of(pages, known, 5), known)
    spans = blocks.select("block", F.inline("spans")).withColumnRenamed("low", "l").withColumnRenamed("high", "h").withColumnRenamed("pivot", "p")
    met = spans.join(pages, F.expr("p = pivot AND l <= high AND h >= low")).count()
    assert met < 0.5 * blocks.count() * pages.count()
    assert sorted(map(tuple, hn.mine(df, F.col("vec_id") % 50 == 0, scale=1.0).collect())) == brute(rows, lambda a: a % 50 == 0, scale=1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (5, [1.0, 2.0, 3.0], 1), (10, [], 1), (15, [0.5], 2), (1, [1.0, 2.0], 2), (2, [0.75, 1.0], 2), (3, None, 1), (None, [1.0], 1), (4, [1.0], None), (6, [nan], 1), (7, [inf, 1.0], 2),
        (8, [1.0, None], 1), (20, [-1.0, -2.0], 1), (25, [0.0, 0.0], 1), (9, [0.0, 0.0], 2), (-5, [1.0, 1.0], 1), (11, [1.0, 1.5], 0), (11, [1.0, 1.5], 0), (30, [1.0, 1.5], 1), (30, [1.0, 1.5], 1),
    ]
    assert got(spark, rows) == brute(rows, lambda a: a % 5 == 0)
    assert got(spark, []) == []
    assert got(spark, [(3, [1.0], 1), (4, [1.0], 2)]) == [] and got(spark, [(5, [1.0], 1)]) == []


def test_equal_vectors_and_one_label_with_most_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 0.5, 0.25], 1) for i in range(900)] + [(i, r.normal(0, 1, 3).round(2).tolist(), int(i % 4)) for i in range(900, 1400)]
    assert got(spark, rows, lambda c: c % 50 == 0) == brute(rows, lambda a: a % 50 == 0)


def test_components_beyond_a_double(spark):
    """Scores of up to 62 bits are exact; a vector that could leave a long takes no part."""
    rows = [(i, [float((i % 7) * 2**28 + i), float(i * 3), 2.0**28], i % 2) for i in range(60)]
    want = brute(rows, lambda a: a % 20 == 0, scale=1)
    assert got(spark, [*rows, (100, [2.0**40], 1), (101, [1e300], 0)], lambda c: c % 20 == 0, scale=1.0) == want and len(want) == 30
