import json

import pytest

from tidemark.schemas import COMPANY, LANDED, SKILL
from tidemark.sources import boards, dimensions, jsonl


def land(spark, *bodies):
    rows = [(source, token, None, i, body if isinstance(body, str) else json.dumps(body)) for i, (source, token, body) in enumerate(bodies)]
    return spark.createDataFrame(rows, LANDED)


def by_id(df):
    return {r.external_id: r for r in df.collect()}


def test_greenhouse(spark):
    job = {
        "id": 4638026005, "title": "Manager", "location": {"name": "Ottawa, Canada"}, "absolute_url": "https://b/1",
        "first_published": "2025-12-09T10:15:25-05:00",
        "content": "&lt;div class=&quot;x&quot;&gt;&lt;p&gt;We &amp;amp; you&lt;/p&gt;&lt;/div&gt;",
    }
    bare = {"id": 7, "title": "T", "location": None, "absolute_url": "u", "content": None}
    landed = land(spark, ("greenhouse", "birch", {"jobs": [job, bare], "meta": {"total": 2}}))
    companies = spark.createDataFrame([("Birch", "x", "greenhouse", "birch"), ("Other", "x", "lever", "birch")], COMPANY)
    got = by_id(boards.normalize(landed, "greenhouse", companies))
    first, second = got["4638026005"], got["7"]
    assert (first.company, first.location, first.description) == ("Birch", "Ottawa, Canada", "We & you")
    assert str(first.posted_at).startswith("2025-12-09") and json.loads(first.payload) == job
    assert (second.location, second.description, second.posted_at) == (None, "", None)
    assert first.fetch_seq < second.fetch_seq


def test_lever(spark):
    job = {
        "id": "a", "text": "Associate", "hostedUrl": "https://l/1", "createdAt": 1786394912472,
        "categories": {"location": "Toronto", "allLocations": ["Toronto, Ontario", "Remote"]},
        "openingPlain": "Open", "descriptionPlain": " ", "additionalPlain": "More", "salaryDescriptionPlain": None,
        "lists": [{"text": "You:", "content": "\n<li>caf&eacute;</li><li>b</li>"}, {"text": "", "content": None}],
    }
    bare = {"id": "b", "text": "T", "hostedUrl": "u", "createdAt": "1786394912472", "categories": {"location": "X"}}
    got = by_id(boards.normalize(land(spark, ("lever", "wave", [job, bare])), "lever"))
    assert got["a"].description == "Open\nYou:\ncafé\nb\nMore"
    assert got["a"].location == "Toronto, Ontario | Remote" and got["a"].company == "wave"
    assert got["a"].posted_at.microsecond == 472000
    assert (got["b"].location, got["b"].posted_at, got["b"].description) == ("X", None, "")


def test_ashby(spark):
    jobs = [
        {"id": "1", "title": "A", "location": "Ottawa", "secondaryLocations": [{"location": "Toronto"}, {"location": "Ottawa"}],
         "isListed": True, "isRemote": True, "publishedAt": "2026-07-03T05:01:26.656+00:00", "jobUrl": "u1",
         "descriptionPlain": "plain", "descriptionHtml": "<p>html</p>"},
        {"id": "2", "title": "B", "isListed": False, "jobUrl": "u2"},
        {"id": "3", "title": "C", "location": "", "jobUrl": "u3", "descriptionPlain": "", "descriptionHtml": "<p>h&amp;i</p>"},
    ]
    got = by_id(boards.normalize(land(spark, ("ashby", "n", {"apiVersion": "1", "jobs": jobs})), "ashby"))
    assert sorted(got) == ["1", "3"]
    assert got["1"].location == "Ottawa | Toronto | Remote" and got["1"].description == "plain"
    assert got["3"].location is None and got["3"].description == "h&i"


def test_aggregators(spark):
    adzuna = {"results": [
        {"id": "9", "title": "Senior <strong>Dev</strong>", "description": "a", "company": {"display_name": "Acme"},
         "location": {"display_name": "Toronto", "area": []}, "redirect_url": "u", "created": "2026-08-15T01:02:03Z"},
        {"id": "10", "title": "No company", "redirect_url": "u", "created": "x"},
    ], "count": 2}
    jooble = {"totalCount": 2, "jobs": [
        {"id": 0, "title": "ML <b>Eng</b>", "location": "Montreal, QC", "snippet": "Use <b>PyTorch</b>.&nbsp;Ok", "link": "u",
         "company": "Lau", "updated": "2026-08-15T00:00:00.0000000"},
        {"id": None, "title": "x", "link": "u", "company": "y"}, {"id": 5, "title": "", "link": "u", "company": "y"},
    ]}
    landed = land(spark, ("adzuna", "k", adzuna), ("jooble", "k", jooble))
    (a,) = boards.normalize(landed, "adzuna").collect()
    (j,) = boards.normalize(landed, "jooble").collect()
    assert (a.title, a.source_name, a.company) == ("Senior Dev", "adzuna-ca", "Acme")
    assert (j.external_id, j.title, j.description) == ("0", "ML Eng", "Use\nPyTorch\n. Ok")


def test_wrong_shapes_fail_the_body_not_the_run(spark):
    landed = land(
        spark, ("lever", "weird", {"not": "a list"}), ("greenhouse", "g1", {"jobs": "none"}), ("greenhouse", "g2", "<html>"),
        ("ashby", "a1", {}), ("ashby", "ok", {"jobs": []}), ("lever", "ok", []), ("jooble", "ok", {"totalCount": 0}),
        ("adzuna", "broken", "not json"),
        ("greenhouse", "g3", {"jobs": [{"id": 1, "title": "T", "absolute_url": "u", "content": ""}, {"id": 2}]}),
    )
    listings, failed = boards.normalize_all(landed)
    assert {r.source_name for r in failed.collect()} == {"weird", "g1", "g2", "a1", "broken"}
    complete, incomplete = boards.split_incomplete(listings)
    assert [r.external_id for r in complete.collect()] == ["1"]
    assert [r.external_id for r in incomplete.collect()] == ["2"]
    companies = spark.createDataFrame([("G1", "x", "greenhouse", "g1"), ("G3", "x", "greenhouse", "g3"), ("L", "x", "lever", "ok")], COMPANY)
    alive = {r.name: (r.jobs, r.alive) for r in boards.board_liveness(landed, companies).collect()}
    assert alive == {"G1": (None, False), "G3": (2, True), "L": (0, True)}


def test_dimension_checks(spark):
    companies = spark.createDataFrame(
        [("A", "x", "lever", "a"), ("a", "x", "lever", "b"), ("C", " ", "lever", "a"), ("D", "x", "other", "d")], COMPANY
    )
    got = {(r.rule, r.key) for r in dimensions.company_violations(companies).collect()}
    assert got == {("duplicate board", "lever/a"), ("duplicate name", "a"), ("empty field", "lever/a"), ("unknown board", "other/d")}
    skills = spark.createDataFrame(
        [("go", "language", ["golang"]), ("go", "language", []), ("Rust", "language", []), ("cpp", "x", ["Golang!"]), ("node.js", "language", ["nodejs"])],
        SKILL,
    )
    got = {(r.rule, r.key) for r in dimensions.taxonomy_violations(skills, ("language",)).collect()}
    assert got == {("duplicate id", "go"), ("id not lower case", "Rust"), ("spelling owned twice", "golang"), ("unknown category", "cpp")}


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "rows")
    schema = "listing_id string, n int"
    assert jsonl.read_jsonl(spark, path, schema).count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    jsonl.write_jsonl(rows, path)
    jsonl.write_jsonl(rows, path, append=True)
    (tmp_path / "rows" / "part-x.json").write_text('\n{"listing_id": "c", "n": 3}\n\n')
    assert jsonl.read_jsonl(spark, path, schema).count() == 5
    (tmp_path / "rows" / "part-y.json").write_text("{broken\n")
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, schema).collect()


def test_dimension_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"name": " Acme ", "hq": "T", "board": "lever", "token": "acme"}\n')
    (tmp_path / "s.json").write_text('{"id": "go", "category": "language"}\n')
    assert dimensions.load_companies(spark, str(tmp_path / "c.json")).first().name == "Acme"
    assert dimensions.load_taxonomy(spark, str(tmp_path / "s.json")).first().aliases == []
