"""Documents that try an operator's edges, and how to compare its rows."""

from __future__ import annotations

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = "\n".join(f"line {i % 97} of a very long text, number {i}" for i in range(4000))

#: null ids, null and empty texts, ties, rows that repeat in whole and in part
EDGES = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", None),
    (2, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
    (2, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
    (2, "another text under the same id", None, "b", None),
    (None, "one two three four five six seven eight nine ten eleven twelve", None, None, None),
    (None, None, None, None, None),
    (3, None, "en", "a", None),
    (4, "", "en", "a", 0),
    (5, " \t\n \n", "en", "b", 0),
    (6, LONG, "en", "b", None),
    (7, LONG + " end", "en", "b", None),
    (8, "É ñ 　 ß\r\nx\ty", "de", "c", None),
    (9, "word", "en", "c", 4),
    (10, "x" * 5000, "en", "c", 5000),
]


def documents(spark, rows=EDGES):
    return spark.createDataFrame(rows, DOCS)


def corpus(spark, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_rows(df, *names):
    """Rows as sorted tuples of the named columns."""
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def clashing(df):
    """df with further columns that carry names operators use inside."""
    from pyspark.sql import functions as F

    for name in ("text_hash", "n_lines", "n_dropped", "kept", "print", "component_id", "_text_hash", "length", "score", "key"):
        df = df.withColumn(name, F.lit("taken"))
    return df
