"""Counts, rankings and weekly series over postings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.search import check_range, days_before
from tidemark.session import pinned


def total_jobs(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count("*").alias("total_jobs"))


def _top(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Most frequent keys; equal counts are ordered by key, so the cut is stable."""
    check_range("top_n", n, 1, 100)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(n)


def mentions(postings: DataFrame, *columns: str) -> DataFrame:
    """One row per posting and skill."""
    return postings.select(*columns, F.explode("skills").alias("skill"))


def top_skills(postings: DataFrame, n: int = 20) -> DataFrame:
    return _top(mentions(postings), "skill", n)


def top_roles(postings: DataFrame, n: int = 20) -> DataFrame:
    return _top(postings, "title", n)


def top_companies(postings: DataFrame, n: int = 15) -> DataFrame:
    return _top(postings, "company", n)


def stats(postings: DataFrame, approximate: bool = False) -> DataFrame:
    """total_jobs, total_companies and last_scraped in one row."""
    companies = F.approx_count_distinct("company") if approximate else F.countDistinct("company")
    return postings.agg(
        F.count("*").alias("total_jobs"),
        companies.alias("total_companies"),
        F.max("date_scraped").alias("last_scraped"),
    )


#: 2 ** SKETCH_BITS registers of a sketch: a standard error of 1.04 / sqrt(4096), 1.6 percent
SKETCH_BITS = 12


def daily_companies(postings: DataFrame) -> DataFrame:
    """(day, n, companies): postings of each day and a mergeable sketch of who posted them.

    A few kilobytes a day stand in for the names, so counts over any days need neither the postings nor a
    distinct over them; new days are added without touching old ones.
    """
    return postings.groupBy(F.to_date("date_scraped").alias("day")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("company", SKETCH_BITS).alias("companies")
    )


def companies_by(daily: DataFrame, period: str) -> DataFrame:
    """(period, n, companies): distinct companies of each week, month or year out of daily sketches, as an estimate."""
    start = F.to_date(F.date_trunc(period, "day")).alias("period")
    merged = daily.groupBy(start).agg(F.sum("n").alias("n"), F.hll_union_agg("companies").alias("sketch"))
    return merged.select("period", "n", F.hll_sketch_estimate("sketch").alias("companies"))


def sources(postings: DataFrame, as_of: datetime | Column, days: int = 7) -> DataFrame:
    """Per source: postings of all time and of the last days, and share of the total."""
    recent = F.col("date_scraped") >= days_before(as_of, days)
    per_source = postings.groupBy("source_type").agg(
        F.count("*").alias("n"), F.count_if(recent).alias("recent")
    )
    everything = Window.partitionBy()  # over one row per source
    return per_source.withColumn("share", F.col("n") / F.sum("n").over(everything))


def fresh_total(postings: DataFrame, as_of: datetime | Column, days: int = 7) -> DataFrame:
    return sources(postings, as_of, days).agg(F.sum("recent").alias("fresh"))


def week_of(ts: Column) -> Column:
    """Monday of the week of ts."""
    return F.to_date(F.date_trunc("week", ts))


def weekly_counts(
    postings: DataFrame, as_of: datetime | Column, weeks: int, skills: Sequence[str]
) -> DataFrame:
    """(week, skill, n) of the wanted skills inside the trailing window."""
    check_range("weeks", weeks, 1, 52)
    recent = postings.where(F.col("date_scraped") >= days_before(as_of, 7 * weeks))
    dated = mentions(recent, week_of(F.col("date_scraped")).alias("week"))
    return dated.where(F.col("skill").isin(*skills)).groupBy("week", "skill").agg(
        F.count("*").alias("n")
    )


def top_weekly_counts(
    postings: DataFrame, as_of: datetime | Column, weeks: int, n: int = 5
) -> DataFrame:
    """weekly_counts of the n overall most frequent skills, from one pass over the postings.

    Older weeks are folded into one row per skill, so what is kept between the
    ranking and the selection is skills times weeks, not mentions.
    """
    check_range("weeks", weeks, 1, 52)
    check_range("top_n", n, 1, 100)
    date = F.col("date_scraped")
    week = F.when(date >= days_before(as_of, 7 * weeks), week_of(date))
    counts = pinned(
        mentions(postings, week.alias("week")).groupBy("week", "skill").agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("skill").agg(F.sum("n").alias("total"))
    top = totals.orderBy(F.desc("total"), "skill").limit(n)  # at most 100 rows
    return counts.where(F.col("week").isNotNull()).join(
        F.broadcast(top.select("skill")), "skill", "left_semi"
    )


def skill_history(
    postings: DataFrame,
    as_of: datetime | Column,
    skills: Sequence[str] | None = None,
    weeks: int = 8,
) -> DataFrame:
    """Weekly counts per skill, ordered by week and skill; the overall top five by default."""
    if skills:
        counts = weekly_counts(postings, as_of, weeks, skills)
    else:
        counts = top_weekly_counts(postings, as_of, weeks)
    return counts.select("week", "skill", "n").orderBy("week", "skill")


def skill_series(
    postings: DataFrame, as_of: datetime | Column, skills: Sequence[str], weeks: int = 8
) -> DataFrame:
    """One row per requested skill in request order; a skill without points keeps an empty series."""
    points = (
        weekly_counts(postings, as_of, weeks, skills)
        .groupBy("skill")
        # at most one entry per week, 53 at the most
        .agg(F.sort_array(F.collect_list(F.struct("week", "n"))).alias("points"))
    )
    asked = F.posexplode(F.array(*[F.lit(s) for s in skills])).alias("position", "skill")
    requested = postings.sparkSession.range(1).select(asked)
    nothing = F.expr("array()").cast("array<struct<week: date, n: bigint>>")
    return requested.join(points, "skill", "left").select(
        "position", "skill", F.coalesce("points", nothing).alias("points")
    ).orderBy("position")


def skill_matrix(
    postings: DataFrame, as_of: datetime | Column, skills: Sequence[str], weeks: int = 8
) -> DataFrame:
    """Week by skill, one column per requested skill, 0 where nothing was counted."""
    counts = weekly_counts(postings, as_of, weeks, skills)
    return counts.groupBy("week").pivot("skill", list(skills)).agg(F.sum("n")).fillna(0)
