import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import (
    candidates, components, evaluate, ingest, ledger, quality, queues, scale, search, taxonomy, trends,
)
from tidemark.schemas import PRICE, SKILL
from tidemark.sources import dimensions

NOW = dt.datetime(2026, 8, 17, 12, 0)


def listing(spark, rows):
    return spark.createDataFrame(
        rows, "source_type string, source_url string, location string, fetch_seq bigint, title string, company string, description string"
    )


# --- scale ----------------------------------------------------------------------


def test_running_total_with_a_hot_key(spark):
    """One key holds half of all rows; the result equals a sequential pass."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(50), i, Decimal(rng.randrange(-50, 100))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v decimal(10,2)").repartition(5)
    got = scale.running_before(df, ["k"], ["t", "id"], {"before": F.col("v"), "nth": F.lit(1)}, slices=7)
    want, sums, seen = {}, {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = (sums.get(k, Decimal(0)), seen.get(k, 0))
        sums[k] = sums.get(k, Decimal(0)) + v
        seen[k] = seen.get(k, 0) + 1
    found = {r.id: (r.before, r.nth) for r in got.collect()}
    assert found == want


def test_running_total_splits_a_hot_key(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id"))
    ranged = df.repartitionByRange(8, "k", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ranged.collect()) < 20000 / 4


def test_ranked_without_keys(spark):
    df = spark.range(500).withColumn("x", F.md5(F.col("id").cast("string")))
    got = scale.ranked(df, [], ["x"], "r").orderBy("x").select("r").collect()
    assert [r.r for r in got] == list(range(1, 501))


# --- ingest ---------------------------------------------------------------------


def test_disposition_order(spark):
    rows = listing(spark, [
        ("adzuna", "u1", "Berlin", 1, "t", "c", "d"), ("jooble", "u1", "Toronto", 2, "t", "c", "d"),
        ("adzuna", "u2", "Toronto", 3, "t", "c", "d"), ("adzuna", "u2", "Toronto", 4, "t", "c", "d"),
        ("jooble", "u3", None, 5, "t", "c", "d"),
    ])
    marked = ingest.assign_disposition(rows)
    assert {r.fetch_seq: r.disposition for r in marked.collect()} == {
        1: "filtered_location", 2: "duplicate", 3: "kept", 4: "duplicate", 5: "kept",
    }
    counts = ingest.run_counts(marked)
    assert quality.counter_identity(counts).where("not balanced").count() == 0
    fast = ingest.fast_run_counts(rows)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, counts.select(*fast.columns).collect()))
    off = ingest.assign_disposition(rows, canada_only=False)
    assert off.where("disposition = 'filtered_location'").count() == 0


def test_run_counts_with_failures(spark):
    rows = listing(spark, [("lever", "u1", None, 1, "t", "c", "d")])
    marked = ingest.assign_disposition(rows)
    failed = spark.createDataFrame([("lever", "x"), ("lever", "x"), ("ashby", "y")], "source_type string, source_name string")
    got = {r.source_type: r for r in ingest.run_counts(marked, marked, None, failed).collect()}
    assert (got["lever"].failed_boards, got["lever"].new_raw, got["ashby"].fetched) == (["x"], 1, 0)


def test_store_twice_adds_nothing(spark, tmp_path):
    rows = listing(spark, [
        ("lever", "u1", "", 1, "T", "c", "we use python"), ("lever", "u1", "x", 2, "T2", "c", "v2"),
        ("ashby", "u2", None, 3, "t", "c", "d"), ("ashby", "u2", None, 4, "T", "C ", "d"),
    ])
    raw, postings = str(tmp_path / "raw"), str(tmp_path / "postings")

    def stored(listings, *paths):
        return tuple(None if keys is None else keys.count() for keys in ingest.store(listings, *paths, F.lit(NOW)))

    assert stored(rows, raw, postings) == (3, 2)
    assert stored(rows, raw, postings) == (0, 0)
    changed = rows.where("fetch_seq = 1").withColumn("description", F.lit("new text"))
    assert stored(changed, raw, postings) == (1, 0)
    assert stored(rows.where("fetch_seq = 3"), str(tmp_path / "only"), None) == (1, None)
    kept = {r.source_url: r for r in spark.read.parquet(postings).collect()}
    assert (kept["u1"].location, kept["u1"].skills, kept["u2"].location) == ("Unknown", ["python"], "Unknown")
    assert kept["u1"].raw_description == "we use python"  # the first one stays


def test_counts_agree_with_writes(spark, tmp_path):
    """An aggregator's url is folded before anything is stored, and stays out of the postings."""
    rows = listing(spark, [
        ("jooble", "u1", "Berlin", 1, "t", "c", "d"), ("jooble", "u1", "Toronto", 2, "t", "c", "d"),
        ("adzuna", "u2", "Toronto", 3, "t", "c", "d"), ("jooble", "u2", "Toronto", 4, "t", "c", "e"),
        ("lever", "u3", "Toronto", 5, "t", "c", "d"), ("lever", "u3", "Toronto", 6, "t", "c", "e"),
    ])
    failed = spark.createDataFrame([("ashby", "x"), ("ashby", "x")], "source_type string, source_name string")
    raw, postings = str(tmp_path / "raw"), str(tmp_path / "postings")
    counts = {r.source_type: r for r in ingest.ingest_run(rows, raw, postings, F.lit(NOW), failed).collect()}
    got = {s: (r.fetched, r.kept, r.filtered_location, r.duplicate_in_run, r.new_raw, r.new_postings, r.failed_boards) for s, r in counts.items()}
    assert got == {
        "jooble": (3, 0, 1, 2, 0, 0, []), "adzuna": (1, 1, 0, 0, 1, 0, []),
        "lever": (2, 2, 0, 0, 2, 1, []), "ashby": (0, 0, 0, 0, 0, 0, ["x"]),
    }
    assert sorted((r.source_type, r.fetch_seq) for r in spark.read.parquet(raw).collect()) == [("adzuna", 3), ("lever", 5), ("lever", 6)]
    assert [r.fetch_seq for r in spark.read.parquet(postings).collect()] == [5]


def test_insert_if_absent(spark):
    rows = listing(spark, [("a", f"u{i % 7}", None, i, "t", "c", "d") for i in range(50)])
    target = listing(spark, [("a", "u1", None, 900, "t", "c", "d"), ("a", "u1", None, 901, "t", "c", "d")])
    got = ingest.insert_if_absent(rows, target, ["source_url"], "fetch_seq")
    assert {(r.source_url, r.fetch_seq) for r in got.collect()} == {(f"u{i}", i) for i in (0, 2, 3, 4, 5, 6)}


def test_content_versions(spark):
    rows = spark.createDataFrame(
        [("s", "1", "h1", 1), ("s", "1", "h2", 2), ("s", "1", "h1", 3), ("s", "2", "h1", 4)],
        "source_type string, external_id string, content_hash string, fetched_at int",
    )
    got = {(r.external_id, r.content_hash): (r.version, r.changed) for r in ingest.content_versions(rows).collect()}
    assert got == {("1", "h1"): (1, False), ("1", "h2"): (2, True), ("2", "h1"): (1, False)}


def test_a_hot_url_stays_spread_out(spark):
    """All rows share a url: one of them is kept, and no task gets most of them."""
    rows = spark.range(20000).select(
        F.lit("adzuna").alias("source_type"), F.lit("u").alias("source_url"), F.lit(None).cast("string").alias("location"),
        F.col("id").alias("fetch_seq"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = ingest.assign_disposition(rows).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in marked.groupBy("task").count().collect()]
        assert marked.where("disposition = 'kept'").count() == 1 and max(sizes) < 20000 / 2
        assert ingest.insert_if_absent(rows, rows.limit(0), ["source_url"], "fetch_seq").count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- search and trends ------------------------------------------------------------


@pytest.fixture(scope="module")
def posts(spark):
    rows = [
        (1, "Senior 100% Dev", "Acme", "Toronto", ["go", "python"], dt.datetime(2026, 8, 17, 1), "u1", "d", "lever"),
        (2, "dev", "ACME", "Remote_x", ["go"], dt.datetime(2026, 8, 10, 12), "u2", "d", "lever"),
        (3, "Ops", "Beta", None, [], dt.datetime(2026, 8, 10, 11, 59), "u3", "d", "ashby"),
        (4, "Ops", "Beta", "Ottawa", None, dt.datetime(2026, 5, 1), "u4", "d", "ashby"),
    ]
    return spark.createDataFrame(
        rows, "id bigint, title string, company string, location string, skills array<string>, date_scraped timestamp,"
        " source_url string, raw_description string, source_type string",
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(posts):
    f = search.filter_postings
    assert ids(f(posts, company="acme")) == [1, 2]
    assert ids(f(posts, q="100%")) == [1] and ids(f(posts, q="%")) == [1]
    assert ids(f(posts, location="_")) == [2]
    assert ids(f(posts, skill="GO")) == [1, 2] and ids(f(posts, skill="python", source_type="LEVER")) == [1]
    assert ids(f(posts, since_days=7, as_of=NOW)) == [1, 2]  # the bound itself is inside
    assert search.count_jobs(posts, company="beta").first().total == 2
    assert search.page_count(posts, 3).first().pages == 2 and search.page_count(posts, 3, q="zzz").first().pages == 1
    assert [r.id for r in search.page(posts, 1, 2).collect()] == [2, 3]
    assert [r.id for r in search.page_after(posts, dt.datetime(2026, 8, 10, 12), 2, 2).collect()] == [3, 4]
    assert search.by_id(posts, 99).count() == 0


@pytest.mark.parametrize("call", [
    lambda p: search.page(p, -1), lambda p: search.page(p, 0, 201), lambda p: search.filter_postings(p, since_days=366, as_of=NOW),
    lambda p: search.filter_postings(p, since_days=0, as_of=NOW), lambda p: search.filter_postings(p, since_days=3),
    lambda p: trends.top_skills(p, 101), lambda p: trends.skill_history(p, NOW, ["go"], 53), lambda p: queues.queue_view(p, limit=501),
])
def test_bounds(posts, call):
    with pytest.raises(ValueError):
        call(posts)


def test_trends(posts):
    assert [tuple(r) for r in trends.top_skills(posts).collect()] == [("go", 2), ("python", 1)]
    assert [tuple(r) for r in trends.top_companies(posts).collect()] == [("Beta", 2), ("ACME", 1), ("Acme", 1)]
    assert trends.stats(posts).first().total_companies == 3
    assert trends.stats(posts, approximate=True).first().total_companies == 3
    got = {r.source_type: (r.n, r.recent, r.share) for r in trends.sources(posts, NOW).collect()}
    assert got == {"lever": (2, 2, 0.5), "ashby": (2, 0, 0.5)}
    assert trends.fresh_total(posts, NOW).first().fresh == 2
    weeks = [(str(r.week), r.skill, r.n) for r in trends.skill_history(posts, NOW).collect()]
    assert weeks == [("2026-08-10", "go", 1), ("2026-08-17", "go", 1), ("2026-08-17", "python", 1)]
    series = trends.skill_series(posts, NOW, ["rust", "go"]).collect()
    assert [(r.skill, len(r.points)) for r in series] == [("rust", 0), ("go", 2)]
    matrix = {str(r.week): (r.go, r.rust) for r in trends.skill_matrix(posts, NOW, ["go", "rust"]).collect()}
    assert matrix == {"2026-08-10": (1, 0), "2026-08-17": (1, 0)}


def test_source_label(values):
    assert values(["lever", "linkedin", "new"], "string", search.source_label) == ["Lever", "LinkedIn (archive)", "new"]


# --- taxonomy and queues ------------------------------------------------------------


@pytest.fixture(scope="module")
def lookup(spark):
    return dimensions.lookup_terms(spark.createDataFrame(
        [("go", "language", ["golang"]), ("python", "language", []), ("node.js", "runtime", ["Node JS"])], SKILL
    ))


def test_normalize(spark, lookup):
    rows = spark.createDataFrame(
        [(1, ["Python", "golang", "Fortran", "  ", "COBOL", "GO"]), (2, []), (3, None), (4, ["NODE-JS", "node js"])],
        "id int, raw_skills array<string>",
    )
    want = {1: (["go", "python"], ["cobol", "fortran"]), 2: ([], []), 3: ([], []), 4: (["node.js"], [])}
    assert {r.id: (r.mapped, r.unmapped) for r in taxonomy.normalize_skills(rows, lookup, "id").collect()} == want


def test_a_spelling_with_two_owners_stops_the_query(spark):
    lookup = spark.createDataFrame([("go", "go"), ("go", "golang")], "match_key string, skill_id string")
    rows = spark.createDataFrame([(1, ["Go"])], "id int, raw_skills array<string>")
    with pytest.raises(Exception, match="owned by two skills"):
        taxonomy.normalize_skills(rows, lookup, "id").collect()


def test_queue(spark):
    queue = spark.createDataFrame(
        [("fortran", 5, dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), "rejected")],
        "skill string, occurrences bigint, first_seen timestamp, last_seen timestamp, status string",
    )
    delta = queues.count_spellings(spark.createDataFrame([("Fortran ",), ("COBOL",), ("cobol",), ("  ",)], "raw string"))
    assert queues.new_keys(queue, delta, "skill").first().new_keys == 1
    got = {r.skill: tuple(r)[1:] for r in queues.merge_counts(queue, delta, "skill", NOW).collect()}
    assert got == {
        "fortran": (6, dt.datetime(2026, 1, 1), NOW, "rejected"), "cobol": (2, NOW, NOW, "pending"),
    }


def test_company_discovery(spark):
    rows = [
        ("Maple Analytics Inc.", 2), ("MAPLE analytics inc. ", 1), ("Cohere", 3), ("Best Staffing", 4), ("  ", 5),
        ("US Only", 6), ("Nowhere", 7),
    ]
    listings = spark.createDataFrame(rows, "company string, fetch_seq int")
    known = spark.createDataFrame([("cohere",)], "name string")
    mined = queues.mine_companies(listings, known)
    assert {(r.company_name, r.occurrences) for r in mined.collect()} == {
        ("MAPLE analytics inc.", 2), ("US Only", 1), ("Nowhere", 1),
    }
    boards = spark.createDataFrame(
        [("lever", "mapleanalytics", 9, 2), ("greenhouse", "maple-analytics", 5, 5), ("ashby", "mapleanalytics", 1, 1),
         ("ashby", "us-only", 4, 0)],
        "board string, token string, board_jobs bigint, ca_jobs bigint",
    )
    empty = spark.createDataFrame(
        [], "company_key string, occurrences bigint, first_seen timestamp, last_seen timestamp, status string, company_name string"
    )
    queue = queues.merge_counts(empty, mined, "company_key", NOW)
    probed = queues.probe(queue, boards, NOW)
    got = {r.company_key: (r.status, r.board, r.board_token, r.ca_jobs) for r in probed.collect()}
    assert got == {
        "maple analytics inc.": ("board_found", "lever", "mapleanalytics", 2),
        "us only": ("no_ca_roles", "ashby", "us-only", 0), "nowhere": ("no_board", None, None, None),
    }
    assert tuple(queues.probe_summary(probed).first()) == (3, 1, 1, 1)
    (row,) = queues.suggestions(probed).collect()
    assert (row.company_name, row.board, row.mentions, row.ca_jobs, row.board_jobs, row.ca_share) == (
        "MAPLE analytics inc.", "lever", 2, 2, 9, 0.2222,
    )
    back = {r.company_key: (r.status, r.probed_at) for r in queues.reprobe(queues.merge_probe(queue, probed)).collect()}
    assert back["maple analytics inc."] == ("pending", None) and back["nowhere"][0] == "no_board"


def test_dead_letters(spark):
    dead = spark.createDataFrame(
        [(1, "extraction", NOW, None), (2, "extraction", NOW, NOW), (3, "ingestion", NOW, None)],
        "id int, kind string, created_at timestamp, resolved_at timestamp",
    )
    assert [r.id for r in queues.list_dead_letters(dead).collect()] == [3, 1]
    assert [r.id for r in queues.list_dead_letters(dead, "extraction", True).collect()] == [2, 1]
    assert queues.count_unresolved(dead, "extraction").first().total_unresolved == 1
    asked = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id int")
    got = {r.id: (r.requeued, r.resolved_at) for r in queues.requeue(dead, asked, dt.datetime(2027, 1, 1)).collect()}
    assert got == {1: (True, dt.datetime(2027, 1, 1)), 2: (False, NOW), 3: (False, None)}


# --- extraction ---------------------------------------------------------------------

GOOD = {"title_raw": "T", "title_normalized": "t", "company_raw": "C", "company_canonical": "c"}


@pytest.mark.parametrize("change, want", [
    ({}, []),
    ({"visa": {"sponsorship_available": False}}, ["visa flag without evidence"]),
    ({"visa": {"sponsorship_available": True, "evidence": ["  "]}}, ["visa flag without evidence"]),
    ({"visa": {"sponsorship_available": True, "evidence": ["we sponsor"]}}, []),
    ({"compensation": {"min_amount": 5}}, ["amount without currency"]),
    ({"compensation": {"min_amount": 5, "max_amount": 4, "currency": "CAD"}}, ["minimum above maximum"]),
    ({"compensation": {"period": "day"}}, ["unknown pay period"]),
    ({"eligibility": {"min_years_experience": -1, "evidence": ["x"]}}, ["years out of range"]),
    ({"eligibility": {"min_years_experience": 41, "evidence": ["x"]}}, ["years out of range"]),
    ({"eligibility": {"min_years_experience": 0, "evidence": ["0-2 years"]}}, []),
    ({"eligibility": {"min_years_experience": 0}}, ["years without evidence"]),
    ({"eligibility": {"min_years_experience": 2.5, "evidence": ["x"]}}, ["years not whole"]),
    ({"eligibility": {"degree_required": True}}, []),
    ({"extra": 1}, ["unknown key"]),
    ({"visa": {"extra": 1}}, ["unknown key"]),
    ({"skills": None}, ["skills is null"]),
    ({"visa": None}, ["visa is null"]),
    ({"title_raw": None}, ["title_raw missing"]),
    ({"seniority": "boss", "remote_policy": "moon"}, ["unknown seniority", "unknown remote policy"]),
    ({"extraction_confidence": 1.01}, ["confidence out of range"]),
    ({"posted_at": "soon"}, ["unreadable"]),
    ({"skills": "python"}, ["unreadable"]),
])
def test_contract(spark, change, want):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "response string")
    row = components.judge_responses(df).first()
    assert row.problems == want
    assert (row.components is None) == bool(want)


def test_contract_rejects_what_is_no_object(spark):
    df = spark.createDataFrame([("[]",), ("{",), (None,), ("3",)], "response string")
    assert [r.problems for r in components.judge_responses(df).collect()] == [["unreadable"]] * 4
    accepted, rejected = components.validate(df)
    assert (accepted.count(), rejected.count()) == (0, 4)


def test_defaults(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),)], "response string")
    c = components.judge_responses(df).first().components
    assert (c.seniority, c.remote_policy, c.language, c.extraction_confidence, c.skills) == ("unknown", "unknown", "en", 0.5, [])
    assert c.visa is None and c.posted_at is None


def test_attempts(spark):
    ok, bad = json.dumps(GOOD), json.dumps({**GOOD, "extra": 1})
    rows = [
        (1, 1, "end", None, ok), (2, 1, "end", None, bad), (2, 2, "end", None, ok),
        (3, 1, "refusal", None, None), (3, 2, "end", None, ok), (4, 1, "end", None, bad), (4, 2, None, "timeout", None),
        (5, 1, None, "timeout", None), (5, 2, None, "timeout", None), (6, 1, "end", None, bad), (6, 2, "end", None, bad),
        (6, 3, "end", None, ok),
    ]
    df = spark.createDataFrame(rows, "listing_id int, attempt int, stop_reason string, transport_error string, response string")
    outcomes = components.resolve_attempts(df)
    got = {r.listing_id: (r.outcome, r.attempts, r.error, r.raw_response) for r in outcomes.collect()}
    assert got == {
        1: ("accepted", 1, None, None), 2: ("accepted", 2, None, None), 3: ("refused", 1, "model refused", None),
        4: ("failed", 2, "extraction failed after 2 attempts: timeout", bad),
        5: ("failed", 2, "extraction failed after 2 attempts: timeout", None),
        6: ("accepted", 3, None, None),
    }
    raw = spark.createDataFrame([(i, f"u{i}") for i in range(1, 7)], "id int, source_url string")
    long_error = outcomes.withColumn("error", F.repeat(F.lit("e"), 5000))
    dead = components.dead_letters(long_error, raw, "v2", "m", F.lit(NOW))
    assert {(r.raw_listing_id, len(r.error), json.loads(r.payload)["source_url"]) for r in dead.collect()} == {
        (i, 5000, f"u{i}") for i in (3, 4, 5)
    }


def test_attempts_are_read_twice(spark, tmp_path):
    """Once for what decides and once for the answers that matter, also where an attempt or a listing's id repeats."""
    ok, bad = json.dumps(GOOD), json.dumps({**GOOD, "extra": 1})
    rows = [
        (1, 1, "end", None, bad), (1, 2, "end", None, ok), (1, 2, "end", None, ok), (1, 3, "end", None, bad),
        (2, 1, "end", None, bad), (2, 1, "end", None, bad), (2, 2, None, "timeout", None), (2, 2, None, "timeout", None),
        (3, 1, "end", None, bad), (None, 1, "end", None, bad),
    ]
    df = spark.createDataFrame(rows, "listing_id int, attempt int, stop_reason string, transport_error string, response string")
    df.write.parquet(f"{tmp_path}/attempts")
    found = components.resolve_attempts(spark.read.parquet(f"{tmp_path}/attempts"))
    # what decides is written aside by then
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r.listing_id: (r.outcome, r.attempts, r.components and r.components.title_raw, r.error, r.raw_response) for r in found.collect()}
    wrong = "extraction failed after %d attempts: %s"
    assert got == {
        1: ("accepted", 2, GOOD["title_raw"], None, None),
        2: ("failed", 2, None, wrong % (2, "timeout"), bad),
        3: ("failed", 1, None, wrong % (1, "unknown key"), bad),
        None: ("failed", 1, None, wrong.replace("%s", "null") % 1, None),
    }


def test_flatten(spark, lookup):
    body = {
        **GOOD, "skills": ["GO", "Fortran"], "skills_unmapped": ["golang", " Cobol "],
        "compensation": {"min_amount": 50, "max_amount": 50, "currency": "usd", "period": "hour"}, "location_raw": "",
        "country": "ca", "visa": {"citizenship_or_pr_required": False, "evidence": ["q", " "]}, "posted_at": "2026-01-05",
    }
    rows = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(GOOD))], "listing_id int, response string")
    raw = spark.createDataFrame([(1, "Toronto", NOW), (2, None, NOW)], "id int, location string, posted_at timestamp")
    wide = components.flatten(components.validate(rows)[0], raw, lookup, "v2", "m")
    got = {r.raw_listing_id: r for r in wide.collect()}
    assert (got[1].skills, got[1].skills_unmapped) == (["go"], ["cobol", "fortran"])
    assert (got[1].comp_currency, got[1].country, got[1].location_raw) == ("USD", "CA", "Toronto")
    assert got[1].comp_cad_annual_est == Decimal("142480.00")
    assert (got[1].posted_at, got[2].posted_at) == (dt.datetime(2026, 1, 5), NOW)
    assert (got[1].visa_citizenship_or_pr_required, got[2].visa_citizenship_or_pr_required) == (False, None)
    assert got[1].visa_evidence == ["q"] and got[2].eligibility_evidence == []
    assert [r.raw_listing_id for r in components.with_visa_signal(wide).collect()] == [1]


def test_evidence_and_mining(spark):
    df = spark.createDataFrame([(["we  sponsor", "visa"], "Yes, we\nsponsor a visa"), (["we fund"], "we sponsor"), ([], "x")], "e array<string>, t string")
    assert [r[0] for r in df.select(components.verbatim(F.col("e"), F.col("t"))).collect()] == [True, False, True]
    said = ["3-5 years, or 10+ yrs", "minimum 7 years", "120 years old", "No visa sponsorship. New grads welcome", "We sponsor work permits", ""]
    mined = spark.createDataFrame([(s,) for s in said], "t string").select(components.mine_eligibility(F.col("t")).alias("m"))
    got = [(r.m.min_years_experience, r.m.sponsorship_available, r.m.is_new_grad_friendly) for r in mined.collect()]
    assert got == [(3, None, None), (7, None, None), (None, None, None), (None, False, True), (None, True, None), (None, None, None)]


def test_pending(spark):
    raw = spark.createDataFrame(
        [(1, "lever", dt.datetime(2026, 8, 1)), (2, "lever", None), (3, "lever", dt.datetime(2026, 1, 1)),
         (4, "adzuna", dt.datetime(2026, 8, 2)), (5, "ashby", dt.datetime(2026, 8, 3)), (6, "ashby", dt.datetime(2026, 8, 4))],
        "id int, source_type string, posted_at timestamp",
    )
    done = spark.createDataFrame([(5, "v2"), (6, "v1")], "raw_listing_id int, prompt_version string")
    assert [r.id for r in candidates.pending(raw, done, "v2", NOW).collect()] == [6, 1, 2]
    assert [r.id for r in candidates.pending(raw, done, "v2", NOW, None, (), 2).collect()] == [6, 4]


def test_prices_and_cap(spark):
    prices = spark.createDataFrame(
        [("a", Decimal(3), Decimal(15)), ("b", Decimal(5), Decimal(25)), ("c", Decimal(1), Decimal(5))], PRICE
    )
    calls = spark.createDataFrame(
        [(1, "a", 10**6, 10**6, False), (2, "a", 10**6, 10**6, True), (3, "zzz", 10**6, 10**6, False), (4, "a", 5000, 800, False)],
        "id int, model string, input_tokens bigint, output_tokens bigint, batch boolean",
    )
    got = {r.id: r.cost_usd for r in ledger.price_calls(calls, prices).collect()}
    assert got[1] == 18 and got[2] == 9 and got[3] == 30 and Decimal("0.02") < got[4] < Decimal("0.04")
    with pytest.raises(ValueError, match="empty"):
        ledger.price_calls(calls, prices.limit(0))
    with pytest.raises(Exception, match="priced twice"):
        ledger.price_calls(calls, prices.union(prices.where("model = 'a'"))).collect()
    spent = spark.createDataFrame(
        [("r", 1, Decimal("14.5")), ("r", 2, Decimal("0.5")), ("r", 3, Decimal("1")), ("q", 4, Decimal("99")), ("q", 5, Decimal("1"))],
        "run_id string, id int, cost_usd decimal(10,6)",
    )
    kept = ledger.within_cap(spent, Decimal(15), ["id"], 3)
    assert {(r.id, r.spent_before) for r in kept.collect()} == {(1, 0), (2, Decimal("14.5")), (4, 0)}


def test_status_of_nothing(spark):
    empty = spark.createDataFrame([], "id int")
    comps = spark.createDataFrame([], "prompt_version string, visa_sponsorship_available boolean, visa_requires_existing_authorization boolean, visa_citizenship_or_pr_required boolean")
    dead = spark.createDataFrame([], "kind string, resolved_at timestamp")
    spent = spark.createDataFrame([], "id int, run_id string, purpose string, cost_usd decimal(10,6), created_at timestamp")
    row = ledger.extraction_status(empty, comps, dead, spent, "v2").first()
    assert (row.raw_listings, row.pending, row.coverage_pct, row.spend_usd_total, row.spend_usd_last_run, row.last_run_id) == (0, 0, 0.0, 0, 0, None)


# --- evaluation -----------------------------------------------------------------------


def test_scores_and_report(spark):
    gold = spark.createDataFrame(
        [("1", 1, "A", "t", ["a"], True), ("2", 2, "B", "t", [], False), ("3", 3, "C", "t", ["x"], False), ("4", 4, "D", "t", ["a", "c"], True)],
        "listing_id string, position int, company string, title string, skills array<string>, human_verified boolean",
    )
    said = spark.createDataFrame([("1", ["a"]), ("2", []), ("3", ["y"]), ("4", ["a", "b", "b"])], "listing_id string, predicted array<string>")
    scores = evaluate.score(evaluate.pair(said, gold))
    assert {r.listing_id: r.f1 for r in scores.collect()} == {"1": 1.0, "2": 1.0, "3": 0.0, "4": 0.5}
    s = evaluate.summary(scores).first()
    assert (s.n, s.n_human_verified, s.tp, s.fp, s.fn, s.micro_precision, s.macro_f1) == (4, 2, 2, 2, 2, 0.5, 0.625)
    assert [r.listing_id for r in evaluate.worst(scores, 3).collect()] == ["3", "4", "1"]
    report = evaluate.report_rows(scores, 2).orderBy("place", "part").collect()
    assert [(r.part, r.place, r.subject, r.f1) for r in report] == [
        ("macro", 0, "4 listings", 0.625), ("micro", 0, "4 listings", 0.5), ("poorest", 1, "C: t", 0.0), ("poorest", 2, "D: t", 0.5),
    ]
    assert (report[0].share_verified, report[2].wrong, report[2].missed) == (0.5, ["y"], ["x"])


def test_predictions_in_place(spark):
    rows = spark.createDataFrame([("1", "go and rust", ["go", "c"])], "listing_id string, raw_description string, skills array<string>")
    (row,) = evaluate.score(evaluate.predict(rows)).collect()
    assert (row.tp, row.false_positives, row.false_negatives, row.f1) == (1, ["rust"], ["c"], 0.5)


def drafts(spark, n_same, n_other):
    rows = [(str(i), ["go"], "we use go" if i < n_same else "we use python", "t", "c") for i in range(n_same + n_other)]
    df = spark.createDataFrame(rows, "listing_id string, annotator_skills array<string>, raw_description string, title string, company string")
    return evaluate.draft_labels(df)


def test_review_routing(spark):
    routed = evaluate.route_review(drafts(spark, 42, 5), 42)
    counts = {r.verification_method: r["count"] for r in routed.groupBy("verification_method").count().collect()}
    assert counts == {"manual_review": 5 + 10, "auto_accept_agreement": 32}  # 10.5 rounds to the even 10
    capped = evaluate.route_review(drafts(spark, 42, 5), 42, cap=3)
    counts = {(r.verification_method, r.disagreement): r["count"] for r in capped.groupBy("verification_method", "disagreement").count().collect()}
    assert counts == {
        ("manual_review", True): 3, ("auto_accept_unreviewed_disagreement", True): 2, ("auto_accept_agreement", False): 42,
    }
    unknown = drafts(spark, 3, 0).withColumn("disagreement", F.lit(None).cast("boolean"))
    assert evaluate.route_review(unknown, 42).where("human_verified").count() == 3
    decisions = routed.select("listing_id", F.lit("custom").alias("decision"), F.array(F.lit(" X "), F.lit(" ")).alias("custom_skills"))
    gold = evaluate.gold_rows(routed, decisions)
    assert gold.count() == 47
    assert gold.where("human_verified").first().skills == ["x"]
    assert evaluate.gold_rows(routed, decisions.limit(0)).count() == 32
    assert evaluate.unreviewed(routed, gold).count() == 0


def test_sample_is_reproducible(spark):
    rows = spark.range(300).select("id", F.lit("t").alias("title"), F.lit("c").alias("company"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("raw_description"))
    one = [r.listing_id for r in evaluate.sample_pool(rows, 20, 1).collect()]
    two = [r.listing_id for r in evaluate.sample_pool(rows.repartition(7), 20, 1).collect()]
    assert one == two and all(int(i) > 200 for i in one)
    assert one != [r.listing_id for r in evaluate.sample_pool(rows, 20, 2).collect()]


def test_quality(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert [tuple(r) for r in quality.orphans(child, parent, "k", "k").collect()] == [(2, 1)]
    assert [tuple(r) for r in quality.duplicates(child, ["k"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in quality.null_counts(child, ["k"]).collect()] == [("k", 1)]
    assert [tuple(r) for r in quality.too_long(spark.createDataFrame([("abc",)], "s string"), {"s": 2}).collect()] == [("s", 1)]


def test_new_unmapped_per_run(spark):
    said = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "x"), ("b", "y"), ("b", "known")], "run_id string, skill string")
    queue = spark.createDataFrame([("known",)], "skill string")
    new = queues.first_unmapped(said, queue)
    assert {tuple(r) for r in new.collect()} == {("a", 1), ("b", 1)}
    runs = spark.createDataFrame([("a", "accepted", 1, Decimal(1), True), ("c", "failed", 2, None, False)],
                                 "run_id string, outcome string, attempts int, cost_usd decimal(10,2), has_visa_signal boolean")
    assert {(r.run_id, r.extracted, r.unmapped_new) for r in ledger.run_statistics(runs, new).collect()} == {("a", 1, 1), ("c", 0, 0)}
