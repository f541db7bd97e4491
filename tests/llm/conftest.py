import pytest
from pyspark.sql import types as T

#: Extra columns whose names the operators use internally.
CLASHING = ("row", "fp", "of", "h1", "h2", "pos", "line", "size", "class", "bucket", "t", "key", "x", "id", "turn",
            "vote", "logs", "host", "suffix", "declared", "ranges", "left", "found", "block", "v", "rank_")


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with clashing columns on request."""

    def make(rows, clash=False):
        schema = T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in (CLASHING if clash else ())],
        ])
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, "en", "a")[:4] if len(r) == 2 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text), *(["clash"] * len(CLASHING) if clash else [])))
        return spark.createDataFrame(full, schema)

    return make
