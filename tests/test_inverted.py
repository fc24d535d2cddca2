"""The inverted index: a batch gives what each search gives, and no text is read."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import inverted, retrieval
from marlstone.plans.core_queries import TODAY, mounts, source_like
from marlstone.sources.tables import entity

KEEP = ["mount_id", "concept_id", "title", "tier", "score", "normalized", "is_stale", "place"]


def rows(df):
    return sorted((x.mount_id, x.concept_id, x.title, x.tier, int(x.score), round(x.normalized, 9), x.is_stale, x.place) for x in df.select(KEEP).collect())


@pytest.fixture(scope="module")
def concepts(spark, sf):
    c = source_like(entity(spark, sf, "concept"))
    tags = F.when(F.col("concept_id") % 3 == 0, F.array(F.lit("license"), F.lit("The Er")))
    return c.withColumn("tags", tags).withColumn("description", F.when(F.col("concept_id") % 4 == 0, "and the license"))


@pytest.mark.parametrize("how", [{}, {"mode": "audit", "limit": 3}, {"stale_behavior": "fail", "limit": 5}, {"mode": "trusted-only", "stale_behavior": "exclude", "limit": 7}])
def test_batch_is_each_search(spark, sf, concepts, how):
    texts = [x.text for x in entity(spark, sf, "benchmark").orderBy("item_id").limit(2).collect()] + ["the license of er and", "zzzz nothing", "", "license"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    found = inverted.search_batch(inverted.indexed(concepts), mounts(concepts), queries, today=TODAY, **how)
    for i, t in enumerate(texts):
        want = rows(retrieval.search(concepts, mounts(concepts), t, today=TODAY, **how)) if t else []
        assert rows(found.where(F.col("query_id") == i)) == want


def test_few_postings_are_opened_before_the_bound(spark, concepts, monkeypatch):
    """With a small opening, terms end late, and the rows stay the same; a limit out of bounds is an error."""
    queries = spark.createDataFrame([(1, "the license of er and"), (2, "er er and and the xx")], "query_id int, text string")
    index = inverted.indexed(concepts)
    want = rows(inverted.search_batch(index, mounts(concepts), queries, today=TODAY, limit=2))
    for opening in (1, 10**6):
        monkeypatch.setattr(inverted, "OPENING", opening)
        assert rows(inverted.search_batch(index, mounts(concepts), queries, today=TODAY, limit=2)) == want
    with pytest.raises(ValueError, match="limit"):
        inverted.search_batch(index, mounts(concepts), queries, limit=101)


def test_no_text_is_scanned(spark, sf, concepts):
    index = inverted.indexed(concepts)
    queries = spark.createDataFrame([(1, "the license")], "query_id int, text string")
    found = inverted.search_batch(index, spark.createDataFrame([("src0", 1)], "mount_id string, priority int"), queries, today=TODAY)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan and "documents.parquet" not in plan
    assert "body" not in index.catalog.columns


def test_an_index_of_asked_terms_only(spark, concepts):
    """Where the terms are known before, no other term has postings, the texts are read once, and the rows are the same."""
    queries = spark.createDataFrame([(1, "the license of er and"), (2, "er er zzzz the xx")], "query_id int, text string")
    want = rows(inverted.search_batch(inverted.indexed(concepts), mounts(concepts), queries, today=TODAY))
    some = inverted.indexed(concepts, asked=inverted.vocabulary(queries))
    assert {x.term for x in some.postings.select("term").distinct().collect()} <= {"the", "license", "of", "er", "and", "zzzz", "xx"}
    assert want and rows(inverted.search_batch(some, mounts(concepts), queries, today=TODAY)) == want
    assert inverted.indexed(concepts, asked=inverted.vocabulary(queries.limit(0))).postings.isEmpty()
