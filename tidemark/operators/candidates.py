"""Which listings still need extraction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import AGGREGATORS
from tidemark.operators.search import check_range, days_before


def unextracted(raw: DataFrame, components: DataFrame, version: str) -> DataFrame:
    """Listings without a component row at the version."""
    done = components.where(F.col("prompt_version") == version).select(
        F.col("raw_listing_id").alias("id")
    )
    return raw.join(done, "id", "left_anti")


def pending(
    raw: DataFrame,
    components: DataFrame,
    version: str,
    as_of: datetime | Column,
    max_age_days: int | None = 90,
    skip_sources=AGGREGATORS,
    limit: int | None = None,
) -> DataFrame:
    """Unextracted listings worth the money, newest first, undated ones last.

    The cheap filters run before the anti join.  An undated listing is never stale.
    """
    kept = raw
    if skip_sources:
        kept = kept.where(~F.col("source_type").isin(*skip_sources))
    if max_age_days:
        posted = F.col("posted_at")
        kept = kept.where(posted.isNull() | (posted >= days_before(as_of, max_age_days)))
    found = unextracted(kept, components, version).orderBy(F.desc_nulls_last("posted_at"), "id")
    if limit is None:
        return found
    check_range("limit", limit, 1)
    return found.limit(limit)
