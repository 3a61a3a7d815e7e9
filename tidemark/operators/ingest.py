"""Idempotent ingestion: disposition, insert-if-absent, run counters, sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import files
from tidemark.fixed_values import AGGREGATORS
from tidemark.functions.arrays import no_strings
from tidemark.functions.geo import looks_canadian
from tidemark.functions.terms import extract_terms
from tidemark.functions.text import content_hash
from tidemark.operators.key_index import KeyIndex
from tidemark.operators.scale import first_rows, first_seqs, ranked
from tidemark.session import pinned

RAW_KEY = ("source_type", "source_url", "content_hash")
POSTING_KEY = ("source_url",)


def with_hash(listings: DataFrame) -> DataFrame:
    return listings.withColumn(
        "content_hash",
        content_hash(F.col("title"), F.col("company"), F.col("location"), F.col("description")),
    )


def _is_folded(folded: Sequence[str] | None) -> Column:
    return F.lit(True) if folded is None else F.col("source_type").isin(*folded)


def first_of_run(
    listings: DataFrame, canada_only: bool = True, folded: Sequence[str] | None = AGGREGATORS
) -> DataFrame:
    """(source_type, fetch_seq, in_scope) of the listings that speak for themselves.

    That is the first listing of every url of the folded sources (None: of all), and every listing of the others.
    """
    in_scope = looks_canadian(F.col("location")) if canada_only else F.lit(True)
    narrow = listings.select("source_type", "source_url", "location", "fetch_seq")
    mine = _is_folded(folded)
    firsts = first_rows(narrow.where(mine), ["source_url"], "fetch_seq")
    return firsts.unionByName(narrow.where(~mine)).withColumn("in_scope", in_scope)


def assign_disposition(
    listings: DataFrame,
    canada_only: bool = True,
    folded: Sequence[str] | None = AGGREGATORS,
    firsts: DataFrame | None = None,
) -> DataFrame:
    """Adds disposition: 'duplicate', else 'filtered_location', else 'kept'.

    Only aggregators repeat a url within a run, once per search, so only their urls are folded (None: those
    of all sources).  The first listing of a url speaks for it whether or not it is kept, so a later copy
    of a dropped url is a duplicate.  Joined on url and fetch_seq together, so a url repeated any
    number of times stays spread out.  firsts (source_url, fetch_seq) are the listings that speak for their urls, where
    listings are only a part of a run.
    """
    mine = _is_folded(folded)
    if firsts is None:
        firsts = first_seqs(listings.where(mine), ["source_url"], "fetch_seq")
    firsts = firsts.select("source_url", "fetch_seq", F.lit(True).alias("is_first"))
    in_scope = looks_canadian(F.col("location")) if canada_only else F.lit(True)
    return (
        listings.join(firsts, ["source_url", "fetch_seq"], "left")
        .withColumn(
            "disposition",
            F.when(mine & F.col("is_first").isNull(), "duplicate")
            .when(~in_scope, "filtered_location")
            .otherwise("kept"),
        )
        .drop("is_first")
    )


def keep_in_scope(listings: DataFrame) -> DataFrame:
    return listings.where(looks_canadian(F.col("location")))


def _counter(name: str) -> Column:
    return F.count_if(F.col("disposition") == name)


def run_counts(
    dispositions: DataFrame,
    new_raw: DataFrame | None = None,
    new_postings: DataFrame | None = None,
    failed: DataFrame | None = None,
) -> DataFrame:
    """Per source: fetched, kept, filtered_location, duplicate_in_run, and, where
    given, new_raw, new_postings and the tokens of failed bodies."""
    base = dispositions.groupBy("source_type").agg(
        F.count("*").alias("fetched"),
        _counter("kept").alias("kept"),
        _counter("filtered_location").alias("filtered_location"),
        _counter("duplicate").alias("duplicate_in_run"),
    )
    for name, rows in (("new_raw", new_raw), ("new_postings", new_postings)):
        if rows is not None:
            per_source = rows.groupBy("source_type").agg(F.count("*").alias(name))
            base = base.join(per_source, "source_type", "left").fillna(0, [name])
    if failed is not None:
        # a token that fails many times is one entry: distinct tokens are listed, and they are a configured list
        tokens = failed.select("source_type", "source_name").distinct().groupBy("source_type").agg(
            F.sort_array(F.collect_list("source_name")).alias("failed_boards")
        )
        base = base.join(tokens, "source_type", "full").fillna(0).withColumn(
            "failed_boards", F.coalesce("failed_boards", no_strings())
        )
    return base


def fast_run_counts(
    listings: DataFrame, canada_only: bool = True, folded: Sequence[str] | None = AGGREGATORS
) -> DataFrame:
    """run_counts without labelling every row: two aggregates over narrow columns."""
    fetched = listings.groupBy("source_type").agg(F.count("*").alias("fetched"))
    firsts = first_of_run(listings, canada_only, folded)
    kept = firsts.groupBy("source_type").agg(
        F.count_if("in_scope").alias("kept"), F.count_if(~F.col("in_scope")).alias("filtered_location")
    )
    return (
        fetched.join(kept, "source_type", "left")
        .fillna(0)
        .withColumn(
            "duplicate_in_run", F.col("fetched") - F.col("kept") - F.col("filtered_location")
        )
    )


def insert_if_absent(new: DataFrame, target: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The rows of new to append: first of each key, and only keys target lacks.

    Winners are found on keys and seq alone; whole rows move once, to be joined with them.  Keys are unique on
    both sides of the anti join, and the last join includes seq, so no hot key meets in one task.
    """
    names = list(keys)
    firsts = first_seqs(new, names, seq)
    fresh = firsts.join(target.select(*names), names, "left_anti")
    return new.join(fresh, [*names, seq], "left_semi")


def to_postings(kept: DataFrame, as_of: Column, extract=extract_terms) -> DataFrame:
    """Posting rows of kept listings; unstated locations read 'Unknown'."""
    location = F.col("location")
    return kept.select(
        "title",
        "company",
        F.when(location != "", location).otherwise("Unknown").alias("location"),
        extract(F.col("description")).alias("skills"),
        as_of.alias("date_scraped"),
        "source_url",
        F.col("description").alias("raw_description"),
        "source_type",
        "fetch_seq",
    )


def landed_keys(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The key columns of the table at path, or no rows if nothing was written yet."""
    schema = ", ".join(f"{key} string" for key in keys)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def key_index(spark: SparkSession, path: str, keys: Sequence[str]) -> KeyIndex:
    """The index of the table at path, brought up to it."""
    index = KeyIndex(spark, f"{path}.keys", path, tuple(keys))
    index.prepare(lambda: landed_keys(spark, path, keys))
    return index


def insert_by_index(new: DataFrame, index: KeyIndex, seq: str) -> DataFrame:
    """insert_if_absent by the target's index: reads the buckets of the new keys and nothing of the target."""
    names = list(index.keys)
    return new.join(index.fresh(new, seq), [*names, seq], "left_semi")


def _append(rows: DataFrame, keyed: DataFrame, path: str, keys: Sequence[str], shape) -> DataFrame:
    """Append the rows whose keys the table at path lacks; (source_type, fetch_seq and keys) of what was added.

    The keys to add are written aside first: texts are read again for the rows that are written, not stored in between.
    """
    index = key_index(rows.sparkSession, path, keys)
    narrow = keyed.select(*dict.fromkeys(["source_type", *keys, "fetch_seq"]))
    fresh = pinned(insert_by_index(narrow, index, "fetch_seq"))
    if not fresh.isEmpty():
        index.note(fresh)
        wanted = rows.join(fresh.select("source_url", "fetch_seq"), ["source_url", "fetch_seq"], "left_semi")
        # rebalance merges small sources into few files and splits a hot one
        shape(wanted).hint("rebalance", "source_type").write.mode("append").partitionBy("source_type").parquet(path)
        index.settle(fresh)
    return fresh


def store(
    kept: DataFrame,
    raw_path: str,
    postings_path: str | None,
    as_of: Column,
    raw_only: Sequence[str] = AGGREGATORS,
) -> tuple[DataFrame, DataFrame | None]:
    """Append kept listings to the raw table and, when a path is given, the postings table.

    Sources in raw_only reach the raw table only: an aggregator lists jobs that boards list too, under
    urls of its own.  Both appends skip keys already there, so running a batch again adds nothing.
    fetch_seq tells the listings of a run apart.  Returns the keys of the new raw rows and of the new
    postings (None without a path), with their source_type.
    """
    raw = with_hash(kept)
    keyed = pinned(raw.select("source_type", "source_url", "content_hash", "fetch_seq"))
    new_raw = _append(raw, keyed, raw_path, RAW_KEY, lambda rows: rows)
    if not postings_path:
        return new_raw, None
    both = ~F.col("source_type").isin(*raw_only) if raw_only else F.lit(True)
    # terms are extracted from new postings only
    new_postings = _append(
        kept.where(both), keyed.where(both), postings_path, POSTING_KEY, lambda rows: to_postings(rows, as_of)
    )
    return new_raw, new_postings


@dataclass(frozen=True)
class Run:
    """One run that arrives in several parts: which urls its earlier parts have seen.

    Each part leaves a folder of its own, in buckets of urls; a part that is run again replaces it and does not see itself.
    """

    path: str
    part: int
    buckets: int = 8

    def _seen(self, spark: SparkSession, buckets: Sequence[int]) -> DataFrame:
        earlier = [n for n in files.numbered(spark, self.path, "part=") if n < self.part]
        if not earlier:
            return spark.createDataFrame([], "source_url string")
        rows = spark.read.schema("source_url string, part int, bucket int").parquet(self.path)
        return rows.where((F.col("part") < self.part) & F.col("bucket").isin(list(buckets))).select("source_url")

    def first_listings(self, rows: DataFrame) -> DataFrame:
        """(source_url, fetch_seq) of the urls that no earlier part has seen; they are noted for the next parts."""
        bucket = F.pmod(F.xxhash64("source_url"), F.lit(self.buckets)).cast("int")
        firsts = pinned(first_seqs(rows, ["source_url"], "fetch_seq").withColumn("bucket", bucket))
        met = [r[0] for r in firsts.select("bucket").distinct().collect()]
        seen = self._seen(rows.sparkSession, met).join(firsts.select("source_url"), "source_url", "left_semi")
        fresh = pinned(firsts.join(seen, "source_url", "left_anti"))
        noted = fresh.select("source_url", "bucket").hint("rebalance", "bucket")
        noted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/part={self.part}")
        return fresh.select("source_url", "fetch_seq")


def run_totals(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counters of whole runs: the sums of run_counts over their parts, and every failed board once."""
    numbers = [f.name for f in parts.schema if f.name not in (*keys, "source_type", "failed_boards", "batch", "run")]
    sums = [F.sum(n).alias(n) for n in numbers]
    # distinct tokens of a configured list
    boards = F.sort_array(F.array_distinct(F.flatten(F.collect_set("failed_boards")))).alias("failed_boards")
    return parts.groupBy(*keys, "source_type").agg(*sums, *([boards] if "failed_boards" in parts.columns else []))


def ingest_run(
    listings: DataFrame,
    raw_path: str,
    postings_path: str | None,
    as_of: Column,
    failed: DataFrame | None = None,
    canada_only: bool = True,
    raw_only: Sequence[str] = AGGREGATORS,
    run: Run | None = None,
) -> DataFrame:
    """Store one run's complete listings, or a part of them, and count them by the same dispositions.

    Returns run_counts with new_raw, new_postings and, where failed bodies are given, failed_boards.  With a run,
    a url that an earlier part of it has seen is a duplicate here.
    """
    narrow = listings.select("source_type", "source_url", "location", "fetch_seq")
    firsts = run.first_listings(narrow.where(_is_folded(AGGREGATORS))) if run else None
    marked = pinned(assign_disposition(narrow, canada_only, firsts=firsts))
    kept = marked.where(F.col("disposition") == "kept").select("source_url", "fetch_seq")
    new_raw, new_postings = store(
        listings.join(kept, ["source_url", "fetch_seq"], "left_semi"), raw_path, postings_path, as_of, raw_only
    )
    return run_counts(marked, new_raw, new_postings, failed)


def content_versions(raw: DataFrame, keys: Sequence[str] = ("source_type", "external_id")) -> DataFrame:
    """Distinct contents of each external id in order of first sight.

    (keys, content_hash, first_seen, version, changed): copies are folded before
    anything is ordered, and the numbering is spread over range slices.
    """
    distinct = raw.groupBy(*keys, "content_hash").agg(F.min("fetched_at").alias("first_seen"))
    return ranked(distinct, keys, ["first_seen", "content_hash"], "version").withColumn(
        "changed", F.col("version") > 1
    )


def next_versions(
    raw: DataFrame, versions: DataFrame, keys: Sequence[str] = ("source_type", "external_id")
) -> DataFrame:
    """content_versions of what raw adds to versions, numbered on from the last version of each external id.

    Contents that versions holds already, at any number, are left out; only external ids that raw has are looked at, and
    only what is new is ordered.  raw comes after everything versions was made of.
    """
    names = list(keys)
    distinct = raw.groupBy(*names, "content_hash").agg(F.min("fetched_at").alias("first_seen"))
    met = versions.join(distinct.select(*names).distinct(), names, "left_semi")
    fresh = distinct.join(met.select(*names, "content_hash"), [*names, "content_hash"], "left_anti")
    last = met.groupBy(*names).agg(F.max("version").alias("_last"))
    numbered = ranked(fresh, names, ["first_seen", "content_hash"], "version").join(last, names, "left")
    version = F.col("version") + F.coalesce("_last", F.lit(0))
    return numbered.select(*names, "content_hash", "first_seen", version.alias("version"), (version > 1).alias("changed"))


def add_versions(raw: DataFrame, path: str, keys: Sequence[str] = ("source_type", "external_id")) -> DataFrame:
    """Append what raw adds to the version table at path; the rows that were added.

    What is added is written aside before the table it comes from grows.  The same raw rows again add nothing.
    """
    spark = raw.sparkSession
    if files.exists(spark, path):
        added = pinned(next_versions(raw, spark.read.parquet(path), keys))
    else:
        added = pinned(content_versions(raw, keys))
    added.write.mode("append").parquet(path)
    return added
