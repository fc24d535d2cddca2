"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(dicts, columns):
    return sorted(repr([d[c] for c in sorted(columns)]) for d in dicts)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([r.asDict() for r in df.collect()], df.columns) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_twice_alike(spark, sf, name):
    a, b = (sorted(map(repr, QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_canonical_answers_of_blank_texts(spark, tmp_path):
    texts = ["", " ", "\n \t\r\n", "a", " é \n\n b\t", None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, QUERIES["canonical_answers"](spark, str(tmp_path)).collect())) == sorted(c.sql(ORACLES["canonical_answers"]).fetchall())


def test_access_filter_stands_before_the_text_is_used(spark, sf):
    """The plan reads no body for a catalog decision: the scan's columns don't have the text."""
    plan = QUERIES["access_subset"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


def test_aliases_of_all_parts(spark, tmp_path):
    """Chains and cycles of every part, against a walk."""
    spark.range(1, 701).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    to = {k: k - 2 if k % 50 == 0 else k + 1 for k in range(1, 701) if k % 5 != 4 or k % 50 == 49}
    want = {}
    for k in to:
        at, seen = to[k], [k]
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        want[k] = (at, len(seen), "cycle" if at in seen else "resolved")
    got = {r.from_id: (r.to_id, r.hops, r.state) for r in QUERIES["alias_chain"](spark, str(tmp_path)).collect()}
    assert got == want
    cycles = {r.subject for r in QUERIES["lint_alias_cycles"](spark, str(tmp_path)).collect()}
    assert cycles == {str(k) for k, (_, _, state) in want.items() if state == "cycle"}


def test_csv_of_more_rows_than_one_document_may_have(spark, tmp_path):
    """A nation of 200,200 rows is partial, one of 1,000 complete, and the one of null stays one."""
    rows = [(k, 1) for k in range(1001)] + [(k, 2) for k in range(2000, 2005)] + [(k, None) for k in range(3000, 3002)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    got = QUERIES["csv_samples"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == [("1", "partial", 1000), ("2", "complete", 1000), (None, "complete", 400)]


@pytest.mark.parametrize("name", ["alias_chain", "stage_cycles"])
def test_tables_of_nodes_are_not_sent_to_all_tasks(spark, sf, name):
    """They grow with the parts, so that the joins along them shuffle."""
    assert "BroadcastHashJoin" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
