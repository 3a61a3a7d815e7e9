"""The key index: what it reads, and what is left after an insert broke off."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import files
from tidemark.operators import ingest
from tidemark.operators.key_index import KeyIndex

NOW = dt.datetime(2026, 8, 17)
LISTING = (
    "source_type string, source_name string, external_id string, source_url string, title string, company string,"
    " location string, description string, posted_at timestamp, payload string, fetch_seq bigint"
)


def listing(url, seq, text="python", source="lever"):
    return (source, "acme", str(seq), url, "t", "c", "Toronto", text, None, "{}", seq)


def listings(spark, rows):
    return spark.createDataFrame(rows, LISTING)


def table_of(spark, n, buckets, tmp_path):
    rows = spark.range(n).select(F.concat(F.lit("u"), F.col("id")).alias("source_url"))
    rows.write.parquet(f"{tmp_path}/table")
    index = KeyIndex(spark, f"{tmp_path}/keys", f"{tmp_path}/table", ("source_url",), buckets)
    index.prepare(lambda: spark.read.parquet(f"{tmp_path}/table"))
    return index


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    index = table_of(spark, 5000, 64, tmp_path)
    batch = spark.createDataFrame([("u17", 1), ("u4000", 2), ("new", 3), ("new", 4)], "source_url string, seq bigint")
    assert [(r.source_url, r.seq) for r in index.fresh(batch, "seq").collect()] == [("new", 3)]
    buckets = [r[0] for r in batch.select(index._bucket()).distinct().collect()]
    held = index.held(buckets)
    read = {r[0].rsplit("/", 2)[1] for r in held.select(F.input_file_name()).distinct().collect()}
    assert read <= {f"bucket={b}" for b in buckets} and len(read) <= 3
    every = index.held().select(F.input_file_name()).distinct().count()
    assert every >= 64 and index.held().count() == 5000
    plan = held._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan


def test_the_target_is_not_read_once_it_is_indexed(spark, tmp_path, monkeypatch):
    raw = f"{tmp_path}/raw"

    def store(rows):
        return tuple(x.count() for x in ingest.store(listings(spark, rows), raw, f"{tmp_path}/posts", F.lit(NOW)))

    assert store([listing("u1", 1), listing("u2", 2), listing("u1", 3)]) == (2, 2)
    # what the table would say is forgotten: only the index speaks from here on
    monkeypatch.setattr(ingest, "landed_keys", lambda spark, path, keys: spark.createDataFrame([], ", ".join(f"{k} string" for k in keys)))
    assert store([listing("u1", 4), listing("u3", 5), listing("u1", 6, "java")]) == (2, 1)
    assert store([listing("u3", 7), listing("u1", 8, "java")]) == (0, 0)
    assert spark.read.parquet(raw).count() == 4


def test_a_table_from_before_the_index_is_filed_first(spark, tmp_path):
    raw = f"{tmp_path}/raw"
    ingest.with_hash(listings(spark, [listing("u1", 1), listing("u2", 2)])).write.partitionBy("source_type").parquet(raw)
    new_raw, _ = ingest.store(listings(spark, [listing("u1", 3), listing("u9", 4)]), raw, None, F.lit(NOW))
    assert [r.source_url for r in new_raw.collect()] == ["u9"]


@pytest.mark.parametrize("rows_landed", [False, True])
def test_an_insert_that_broke_off(spark, tmp_path, monkeypatch, rows_landed):
    """Broken before its rows landed, the rows are inserted again; broken after, they are not."""
    raw = f"{tmp_path}/raw"
    ingest.store(listings(spark, [listing("u0", 0)]), raw, None, F.lit(NOW))
    step = "settle" if rows_landed else "note"
    whole = getattr(KeyIndex, step)

    def broken(self, rows):
        if not rows_landed:
            whole(self, rows)
        raise RuntimeError("power cut")

    monkeypatch.setattr(KeyIndex, step, broken)
    with pytest.raises(RuntimeError):
        ingest.store(listings(spark, [listing("u1", 1), listing("u2", 2)]), raw, None, F.lit(NOW))
    monkeypatch.setattr(KeyIndex, step, whole)
    assert files.exists(spark, f"{raw}.keys/pending")
    new_raw, _ = ingest.store(listings(spark, [listing("u1", 3), listing("u2", 4), listing("u3", 5)]), raw, None, F.lit(NOW))
    assert sorted(r.source_url for r in new_raw.collect()) == (["u3"] if rows_landed else ["u1", "u2", "u3"])
    assert sorted(r.source_url for r in spark.read.parquet(raw).collect()) == ["u0", "u1", "u2", "u3"]
    assert not files.exists(spark, f"{raw}.keys/pending")


def test_compaction_keeps_the_keys(spark, tmp_path):
    index = table_of(spark, 100, 4, tmp_path)
    for n in range(5):
        index.file(spark.createDataFrame([(f"more{n}x{i}",) for i in range(40)], "source_url string"))
    before = len(index.held().inputFiles())
    assert index.compact(files_a_bucket=2) and len(index.held().inputFiles()) < before
    assert index.held().count() == 300 and index.held().distinct().count() == 300
    assert not index.compact(files_a_bucket=2)


def test_an_empty_batch_and_an_empty_index(spark, tmp_path):
    index = KeyIndex(spark, f"{tmp_path}/keys", f"{tmp_path}/table", ("a", "b"), 8)
    index.prepare(lambda: pytest.fail("there is no table"))
    rows = spark.createDataFrame([("x", "y", 2), ("x", "y", 1)], "a string, b string, seq bigint")
    assert [tuple(r) for r in index.fresh(rows, "seq").collect()] == [("x", "y", 1)]
    assert index.fresh(rows.limit(0), "seq").isEmpty()
    index.settle(rows)
    assert index.fresh(rows, "seq").isEmpty()
