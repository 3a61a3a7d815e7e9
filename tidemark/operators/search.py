"""Posting filters, paging and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators.scale import running_before
from tidemark.schemas import POSTING_COLUMNS


def check_range(name: str, value: int, low: int, high: int | None = None) -> None:
    """Bounds of a request parameter, checked before anything is planned."""
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be {low}..{'' if high is None else high}, got {value}")


def days_before(as_of: datetime | Column, days: int) -> Column:
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)) - F.make_dt_interval(F.lit(days))


def filter_postings(
    postings: DataFrame,
    location: str | None = None,
    company: str | None = None,
    source_type: str | None = None,
    skill: str | None = None,
    q: str | None = None,
    since_days: int | None = None,
    as_of: datetime | Column | None = None,
) -> DataFrame:
    """All given filters, and-combined; shared by page and count_jobs.

    Substrings are literal: % and _ are ordinary characters.
    """
    kept = postings
    if location:
        kept = kept.where(F.lower("location").contains(location.lower()))
    if company:
        kept = kept.where(F.lower("company") == company.lower())
    if source_type:
        kept = kept.where(F.col("source_type") == source_type.lower())
    if skill:
        kept = kept.where(F.array_contains("skills", skill.lower()))
    if q:
        kept = kept.where(F.lower("title").contains(q.lower()))
    if since_days is not None:
        check_range("since_days", since_days, 1, 365)
        if as_of is None:
            raise ValueError("since_days needs as_of")
        kept = kept.where(F.col("date_scraped") >= days_before(as_of, since_days))
    return kept


#: rows page() may skip: a task holds skip + limit of them; page_directory() goes deeper
MAX_SKIP = 10_000


def page(postings: DataFrame, skip: int = 0, limit: int = 50, **filters) -> DataFrame:
    """Newest first, ties by id."""
    check_range("skip", skip, 0, MAX_SKIP)
    check_range("limit", limit, 1, 200)
    found = filter_postings(postings, **filters)
    return found.orderBy(F.desc("date_scraped"), "id").offset(skip).limit(limit)


def page_after(
    postings: DataFrame, last_date: datetime, last_id: int, limit: int = 50, **filters
) -> DataFrame:
    """The page behind a known last row.  Deep pages cost the same as the first."""
    check_range("limit", limit, 1, 200)
    when, ident = F.col("date_scraped"), F.col("id")
    beyond = (when < F.lit(last_date)) | ((when == F.lit(last_date)) & (ident > last_id))
    found = filter_postings(postings, **filters).where(when <= F.lit(last_date)).where(beyond)
    return found.orderBy(F.desc("date_scraped"), "id").limit(limit)


def page_directory(postings: DataFrame, limit: int = 50, **filters) -> DataFrame:
    """(page, first_date, first_id): the first row of every page of the filtered postings, pages counted from 0.

    Rows are ranked by range: the postings are cut into ranges of (date, id), ranges are counted, and only a range is ever
    sorted in one task.  Keep the directory as a table; page_at() then reads any page without the pages before it.
    Postings without a date come last, as in page().
    """
    check_range("limit", limit, 1, 200)
    narrow = filter_postings(postings, **filters).select("date_scraped", "id")
    numbered = running_before(narrow, [], [F.desc("date_scraped"), "id"], {"before": F.lit(1).cast("bigint")})
    firsts = numbered.where(F.col("before") % limit == 0)
    page_number = (F.col("before") / limit).cast("bigint").alias("page")
    return firsts.select(page_number, F.col("date_scraped").alias("first_date"), F.col("id").alias("first_id"))


def page_at(postings: DataFrame, directory: DataFrame, number: int, limit: int = 50, **filters) -> DataFrame:
    """Page `number` of the filtered postings by their directory; filters and limit are those it was made with.

    Two rows of the directory bound the page, so the scan is filtered by date and at most `limit` rows are sorted.
    """
    check_range("page", number, 0)
    check_range("limit", limit, 1, 200)
    edges = {r.page: r for r in directory.where(F.col("page").isin(number, number + 1)).collect()}
    found = filter_postings(postings, **filters)
    if number not in edges:
        return found.limit(0)
    found = found.where(_from(edges[number]))
    if number + 1 in edges:
        found = found.where(~_from(edges[number + 1]))
    return found.orderBy(F.desc("date_scraped"), "id").limit(limit)


def _from(edge) -> Column:
    """Rows at or after a directory's row, newest first, without a date last."""
    when, ident = F.col("date_scraped"), F.col("id") >= edge.first_id
    if edge.first_date is None:
        return when.isNull() & ident
    first = F.lit(edge.first_date)
    return when.isNull() | (when < first) | ((when == first) & ident)


def count_jobs(postings: DataFrame, **filters) -> DataFrame:
    return filter_postings(postings, **filters).agg(F.count("*").alias("total"))


def page_count(postings: DataFrame, page_size: int, **filters) -> DataFrame:
    """Number of pages, one when nothing matches."""
    total = F.col("total")
    pages = F.greatest(F.ceil(total / page_size), F.lit(1).cast("bigint"))
    return count_jobs(postings, **filters).select("total", pages.alias("pages"))


def by_id(postings: DataFrame, ident: int) -> DataFrame:
    return postings.where(F.col("id") == ident)


def posting_output(postings: DataFrame) -> DataFrame:
    return postings.select(*POSTING_COLUMNS)


def source_label(source: Column) -> Column:
    """Display name of a source; an unknown source shows as itself."""
    label = source
    for name, text in fv.SOURCE_LABELS.items():
        label = F.when(source == name, text).otherwise(label)
    return label
