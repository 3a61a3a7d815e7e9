"""Folders for queries that write a table and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tidemark.session import shared_folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, never one used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
