"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark import files

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a partial or final aggregate on the join key must not stop a hot key being split
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # checkpoint files are compressed, and go when nothing refers to them any more
    tidy = {
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
    }
    for key, value in {**DEFAULTS, **tidy, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Give a session somebody else built the settings results depend on, where it has none of its own."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local sessions."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def pinned(df: DataFrame) -> DataFrame:
    """Write df once to the checkpoint folder, so every reader sees the same rows
    and a lost executor costs a re-read, not a re-run."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: how much larger rows of texts are in memory than in the files of tables_aside
COMPRESSED = 16


@contextmanager
def tables_aside(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that is to wide rows what pinned() is to narrow ones: it writes them compressed, by column, and they go at the end.

    Until then spark, as a rule the session of a streaming batch, takes tables to be larger than their files, so that none is
    broadcast for being well compressed.
    """
    factor = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(factor)
    spark.conf.set(factor, COMPRESSED)
    folder = f"{shared_folder(spark)}/aside-{uuid.uuid4().hex}"

    def put(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield put
    finally:
        spark.conf.set(factor, before)
        files.remove(spark, folder)
