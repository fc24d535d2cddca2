"""Queries over units, canonical forms and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.sources import normalizers
from marlstone.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


@query("""WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT source_id, 'unit_' || sha256(source_id || chr(0) || CAST(line - 1 AS VARCHAR))[1:16] AS unit_id, CAST(line AS INTEGER) AS line, text FROM u""")
def line_units(spark, sf_dir):
    return normalizers.line_units(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS text, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (SELECT doc_id, '# Part ' || CAST(doc_id AS VARCHAR) || chr(10) || text AS t FROM documents))
SELECT CAST(doc_id AS VARCHAR) AS source_id, count(*) AS n_lines, max('Part ' || CAST(doc_id AS VARCHAR)) AS heading FROM l GROUP BY 1""")
def heading_scope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Part "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("text"))
    return normalizers.headings(normalizers.line_units(docs, "doc_id", "text")).groupBy("source_id").agg(F.count("*").alias("n_lines"), F.max("heading").alias("heading"))
