import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (id, text) or longer rows, with a column whose name clashes with outputs."""

    def build(rows, extra=True):
        full = [(*r, *(None, None, None)[len(r) - 2 :])[:5] for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in ("score", "kept", "size", "shard", "y", "label", "component_id", "rows")})
        return df

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty, blank, one word, repeated rows, ties, markup, control characters, a very long text."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (4, "one"), (None, "null id text"), (5, "same same same same"), (6, "same same same same"), (7, long), (8, "\x00\x1c  é 😀 <<beginOptional>>"), (9, "MIT License apache license\nMIT License")]
