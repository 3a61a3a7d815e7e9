"""Constraint checks as violation tables; an empty result means the rule holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child key values without a parent row, with their number of child rows.

    Counted per key first: a hot foreign key is one row in the join.
    """
    counted = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("_parent"))
    return counted.join(known, F.col(child_key) == F.col("_parent"), "left_anti")


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls) for every column that must not be NULL, from one pass."""
    counted = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "nulls")


def too_long(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(column_name, too_long): values beyond the declared length of a column."""
    counted = rows.agg(*[F.count_if(F.length(c) > n).alias(c) for c, n in limits.items()])
    return counted.unpivot([], list(limits), "column_name", "too_long")


def counter_identity(run_counts: DataFrame) -> DataFrame:
    """Adds balanced: fetched = kept + filtered_location + duplicate_in_run."""
    parts = F.col("kept") + F.col("filtered_location") + F.col("duplicate_in_run")
    return run_counts.withColumn("balanced", F.col("fetched") == parts)
