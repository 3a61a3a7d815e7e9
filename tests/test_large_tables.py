"""Operators that must not depend on one key, one page or one plan: against plain answers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import terms
from tidemark.operators import ingest, search, taxonomy, trends


@pytest.fixture
def no_skew_join(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_mentions_of_a_hot_spelling_stay_where_they_are(no_skew_join, monkeypatch):
    spark = no_skew_join
    lookup = spark.createDataFrame([("go", "golang"), ("python", "python")], "match_key string, skill_id string")
    hot = [(i, " Go ") for i in range(3000)] + [(i, "  ") for i in range(3000)]
    rest = [(i, f"Rare{i}") for i in range(2500)] + [(9000, "python"), (9001, "PYTHON"), (9002, None)]
    mentions = spark.createDataFrame(hot + rest, "id int, raw string")
    found = taxonomy.resolve_mentions(mentions, lookup)
    counts = {(r.folded, r.skill_id): r["count"] for r in found.groupBy("folded", "skill_id").count().collect()}
    assert counts[("go", "golang")] == 3000 and counts[("python", "python")] == 2 and len(counts) == 2502
    assert found.count() == 5502
    plan = found._jdf.queryExecution().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_mentions_without_and_with_only_heavy_spellings(spark):
    lookup = spark.createDataFrame([("go", "golang")], "match_key string, skill_id string")
    none = spark.createDataFrame([], "id int, raw string")
    assert taxonomy.resolve_mentions(none, lookup).count() == 0
    same = spark.createDataFrame([(i, "go") for i in range(50)], "id int, raw string")
    assert [tuple(r) for r in taxonomy.resolve_mentions(same, lookup).select("folded", "skill_id").distinct().collect()] == [("go", "golang")]


@pytest.mark.parametrize("vocabulary", [terms.BASE_VOCABULARY, ("c++", "Node.js", "the of the", "ci/cd", "a b c d e f g h"), ()])
def test_terms_from_a_table_are_those_of_the_plan(spark, vocabulary):
    rng = random.Random(1)
    words = [w for v in (*vocabulary, "python", "x") for w in (v, v.upper(), *v.split())]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "\n"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "")], "id int, text string")
    table = spark.createDataFrame([(v,) for v in vocabulary] * 2, "term string")
    got = {r.id: r.terms for r in terms.extract_from_table(rows, table, "id", "text").collect()}
    if not vocabulary:
        assert set(map(tuple, got.values())) == {()} and len(got) == 62
        return
    want = {r.id: r.t for r in rows.select("id", terms.extract_terms(F.col("text"), vocabulary).alias("t")).collect()}
    assert got == want and any(want.values())


def test_a_term_of_too_many_tokens_stops_the_query(spark):
    rows, table = spark.createDataFrame([(1, "a")], "id int, text string"), spark.createDataFrame([("a b c",)], "term string")
    with pytest.raises(Exception, match="too many tokens"):
        terms.extract_from_table(rows, table, "id", "text", longest=2).collect()


@pytest.mark.parametrize("held", [4 << 20, 0])
def test_texts_stay_in_place_for_a_small_vocabulary(spark, monkeypatch, held):
    monkeypatch.setattr(terms, "HELD_BYTES", held)
    rows = spark.createDataFrame([(1, "red fox, red"), (1, "a fox"), (2, None), (None, "fox"), (3, "")], "id int, text string")
    vocabulary = spark.createDataFrame([("Fox",), ("red  fox",), ("a",), (" ",), (None,)], "term string")
    found = terms.extract_from_table(rows, vocabulary, "id", "text")
    both = ["a", "fox", "red  fox"]
    want = [Row(id=i, terms=t) for i, t in [(1, both), (1, both), (2, []), (None, []), (3, [])]]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want))
    joins = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [_g" in x]
    assert len(joins) == 1 and ("BroadcastHashJoin" in joins[0]) == (held > 0)


def postings(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        when = rng.choice([None, dt.datetime(2026, 8, 1), dt.datetime(2026, 8, rng.randrange(1, 28), rng.randrange(24))])
        rows.append((i, when, rng.choice(["Toronto", "Remote", None]), f"c{rng.randrange(n // 3 + 1)}"))
    return spark.createDataFrame(rows, "id bigint, date_scraped timestamp, location string, company string"), rows


@pytest.mark.parametrize("n, limit, filters", [(0, 10, {}), (1, 1, {}), (400, 7, {}), (400, 25, {"location": "remote"}), (50, 50, {})])
def test_pages_by_directory_are_the_pages(spark, n, limit, filters):
    given, rows = postings(spark, n, 3)
    directory = search.page_directory(given, limit, **filters)
    assert directory.count() == search.page_count(given, limit, **filters).first().pages - (n == 0)
    wanted = [r for r in rows if not filters or r[2] == "Remote"]
    wanted.sort(key=lambda r: (r[1] is None, -(r[1] or dt.datetime(2000, 1, 1)).timestamp(), r[0]))
    kept = spark.createDataFrame(directory.collect(), directory.schema)
    for number in {0, 1, len(wanted) // limit // 2, max(len(wanted) - 1, 0) // limit, len(wanted) // limit + 1}:
        got = [r.id for r in search.page_at(given, kept, number, limit, **filters).collect()]
        assert got == [r[0] for r in wanted[number * limit : (number + 1) * limit]]


def test_a_page_at_reads_one_range(spark, tmp_path):
    """The scan is told the dates of the page, and nothing skips or sorts what lies before it."""
    given, _ = postings(spark, 300, 4)
    given.write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    directory = spark.createDataFrame(search.page_directory(stored, 20).collect(), "page bigint, first_date timestamp, first_id bigint")
    plan = search.page_at(stored, directory, 5, 20)._jdf.queryExecution().toString()
    assert "Offset" not in plan and "PushedFilters: [" in plan and "LessThan" in plan.split("PushedFilters")[1]
    with pytest.raises(ValueError, match="skip"):
        search.page(stored, skip=search.MAX_SKIP + 1)


def test_companies_by_merged_sketches(spark):
    rows = [(dt.datetime(2026, 3 + i % 3, 1 + i % 28), f"company {i % 4000}") for i in range(12_000)]
    given = spark.createDataFrame([*rows, (None, "x"), (rows[0][0], None)], "date_scraped timestamp, company string")
    daily = trends.daily_companies(given)
    assert daily.count() == len({r[0] for r in rows}) + 1
    # two halves of the days, kept apart and merged later
    halves = daily.where("day < '2026-04-10'").unionByName(daily.where("day >= '2026-04-10' or day is null"))
    for period in ("week", "month"):
        got = {r.period: (r.n, r.companies) for r in trends.companies_by(halves, period).collect()}
        exact = given.groupBy(F.to_date(F.date_trunc(period, "date_scraped")).alias("p")).agg(F.count("*").alias("n"), F.countDistinct("company").alias("c"))
        for r in exact.collect():
            assert got[r.p][0] == r.n and abs(got[r.p][1] - r.c) <= max(1, 0.05 * r.c)


def test_versions_grow_by_what_is_new(spark, tmp_path):
    rng = random.Random(6)
    rows = [("lever", f"e{rng.randrange(20)}", f"h{rng.randrange(6)}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)) for i in range(400)]
    schema = "source_type string, external_id string, content_hash string, fetched_at timestamp"
    path, cuts = f"{tmp_path}/v", [0, 30, 30, 200, 400]
    for a, b in zip(cuts, cuts[1:], strict=False):
        step = spark.createDataFrame(rows[a:b], schema)
        ingest.add_versions(step, path)
        assert ingest.add_versions(step, path).isEmpty()
    whole = ingest.content_versions(spark.createDataFrame(rows, schema))
    names = whole.columns
    assert sorted(map(tuple, spark.read.parquet(path).select(*names).collect())) == sorted(map(tuple, whole.collect()))


def test_a_step_reads_only_what_it_touches(spark):
    """Versions of external ids that the step does not have take no part."""
    schema = "source_type string, external_id string, content_hash string, fetched_at timestamp"
    raw = spark.createDataFrame([("s", "a", "h2", dt.datetime(2026, 2, 1)), ("s", "b", "h1", dt.datetime(2026, 2, 2))], schema)
    stored = spark.createDataFrame(
        [("s", "a", "h1", dt.datetime(2026, 1, 1), 1, False), ("s", "z", "h2", dt.datetime(2026, 1, 1), 7, True)],
        "source_type string, external_id string, content_hash string, first_seen timestamp, version bigint, changed boolean",
    )
    got = {(r.external_id, r.content_hash): (r.version, r.changed) for r in ingest.next_versions(raw, stored).collect()}
    assert got == {("a", "h2"): (2, True), ("b", "h1"): (1, False)}
