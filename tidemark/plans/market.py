"""Search and trend queries over postings, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sql, terms
from tidemark.functions.text import long_id, strip_query
from tidemark.operators import ingest, search, trends
from tidemark.plans.bindings import P_CTE, clock, list_text, postings, sql_places_cte, ts_text
from tidemark.session import pinned

NAMED = ("red", "widget", "absent", "bolt")


def _dates(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return df


def _output(df):
    return search.posting_output(df).withColumn("skills", list_text(F.col("skills"))).withColumn(
        "date_scraped", ts_text(F.col("date_scraped"))
    )


def _filtered(**filters):
    def query(spark, sf_dir):
        p = postings(spark, sf_dir)
        now = {"as_of": clock(p, "date_scraped")} if "since_days" in filters else {}
        return _output(search.filter_postings(p, **filters, **now))

    return query


def total_jobs(spark, sf_dir):
    return trends.total_jobs(postings(spark, sf_dir, skills=False, company=False))


def top_skills(spark, sf_dir):
    return trends.top_skills(postings(spark, sf_dir, company=False), 20)


def top_roles(spark, sf_dir):
    return trends.top_roles(postings(spark, sf_dir, skills=False, company=False), 20)


def top_companies(spark, sf_dir):
    return trends.top_companies(postings(spark, sf_dir, skills=False), 15)


def corpus_stats(spark, sf_dir):
    found = trends.stats(postings(spark, sf_dir, skills=False))
    return found.withColumn("last_scraped", ts_text(F.col("last_scraped")))


def sources_all_recent(spark, sf_dir):
    p = postings(spark, sf_dir, skills=False)
    return trends.sources(p, clock(p, "date_scraped")).withColumn("share", F.round("share", 6))


def source_labels(spark, sf_dir):
    p = postings(spark, sf_dir, skills=False)
    label = search.source_label(F.col("source_type")).alias("label")
    return p.groupBy("source_type", label).agg(F.count("*").alias("n"))


def fresh_total(spark, sf_dir):
    p = postings(spark, sf_dir, skills=False)
    return trends.fresh_total(p, clock(p, "date_scraped"))


def skill_history_default(spark, sf_dir):
    p = postings(spark, sf_dir, company=False)
    return _dates(trends.skill_history(p, clock(p, "date_scraped")), "week")


def skill_history_named(spark, sf_dir):
    p = postings(spark, sf_dir, company=False)
    return _dates(trends.skill_history(p, clock(p, "date_scraped"), NAMED, 52), "week")


def skill_series(spark, sf_dir):
    p = postings(spark, sf_dir, company=False)
    series = trends.skill_series(p, clock(p, "date_scraped"), NAMED, 8)
    shown = F.transform(
        "points", lambda x: F.concat(x["week"].cast("string"), F.lit(":"), x["n"].cast("string"))
    )
    return series.select("position", "skill", list_text(shown).alias("points"))


def skill_matrix(spark, sf_dir):
    p = postings(spark, sf_dir, company=False)
    return _dates(trends.skill_matrix(p, clock(p, "date_scraped"), NAMED, 52), "week")


def postings_per_week(spark, sf_dir):
    p = postings(spark, sf_dir, skills=False, company=False)
    weekly = p.groupBy(trends.week_of(F.col("date_scraped")).alias("week")).agg(F.count("*").alias("n"))
    return _dates(weekly, "week")


def posting_skills(spark, sf_dir):
    return trends.mentions(postings(spark, sf_dir, company=False), "id")


def jobs_page(spark, sf_dir):
    return _output(search.page(postings(spark, sf_dir), skip=40, limit=25, location="remote"))


def jobs_page_after(spark, sf_dir):
    p = postings(spark, sf_dir)
    last = search.page(postings(spark, sf_dir, skills=False, company=False), limit=50)
    edge = last.orderBy("date_scraped", F.desc("id")).first()
    return _output(search.page_after(p, edge.date_scraped, edge.id, 50))


def jobs_page_deep(spark, sf_dir):
    """The page in the middle of all remote postings, by a directory of first rows."""
    p = postings(spark, sf_dir)
    places = postings(spark, sf_dir, skills=False)
    directory = pinned(search.page_directory(places, 25, location="remote"))
    middle = directory.count() // 2
    return _output(search.page_at(p, directory, middle, 25, location="remote"))


def companies_weekly(spark, sf_dir):
    """Distinct companies of each week by merged daily sketches, beside the exact count they stay within 5 percent of."""
    p = postings(spark, sf_dir, skills=False)
    estimated = trends.companies_by(trends.daily_companies(p), "week")
    exact = p.groupBy(F.to_date(F.date_trunc("week", "date_scraped")).alias("period")).agg(F.countDistinct("company").alias("exact"))
    near = F.abs(F.col("companies") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return estimated.join(exact, "period").select(F.col("period").cast("string").alias("week"), "n", "exact", near.alias("near"))


def jobs_count(spark, sf_dir):
    p = postings(spark, sf_dir)
    return search.count_jobs(p, skill="RED", q="high", source_type="Building")


def jobs_page_count(spark, sf_dir):
    return search.page_count(postings(spark, sf_dir, skills=False), 50, location="toronto")


def job_by_id(spark, sf_dir):
    return _output(search.by_id(postings(spark, sf_dir), 7))


def posting_urls(spark, sf_dir):
    p = postings(spark, sf_dir, skills=False, company=False)
    tracked = F.concat("source_url", F.lit("?utm=1"))
    return p.select("id", strip_query(tracked).alias("url"), long_id(tracked).alias("long_id"))


def posting_rows(spark, sf_dir):
    """Listings as they enter the postings table: unstated locations read Unknown."""
    p = postings(spark, sf_dir, skills=False).withColumnRenamed("id", "fetch_seq")
    listings = p.withColumn("description", F.concat_ws(" ", "title", "source_type"))
    now = clock(p, "date_scraped")
    rows = ingest.to_postings(listings, now, lambda text: terms.extract_terms(text, ("high", "low", "urgent")))
    return rows.select(
        "source_url", "location", list_text(F.col("skills")).alias("skills"), ts_text(F.col("date_scraped")).alias("date_scraped")
    )


def posting_inserted(spark, sf_dir):
    """Two single inserts into the postings table, one of a url it has already."""
    p = postings(spark, sf_dir, skills=False).select("source_url", "title", F.col("id").alias("fetch_seq"))
    newest = p.agg(F.max("source_url").alias("url"), F.max("fetch_seq").alias("seq"))
    rows = F.inline(F.array(
        F.struct(F.col("url").alias("source_url"), F.lit("again").alias("title"), (F.col("seq") + 1).alias("fetch_seq")),
        F.struct(F.concat("url", F.lit("-new")).alias("source_url"), F.lit("new").alias("title"), (F.col("seq") + 2).alias("fetch_seq")),
    ))
    added = ingest.insert_if_absent(newest.select(rows), p, ingest.POSTING_KEY, "fetch_seq")
    return p.unionByName(added).groupBy("title").agg(F.count("*").alias("n"))


def sql_functions(spark, sf_dir):
    """The scalar functions called from SQL over postings."""
    sql.register(spark)
    return spark.sql(
        """SELECT id, content_hash(concat(title, '  '), company, location, 'x') AS digest,
                  match_key(company) AS key, long_id(concat(source_url, '?a=1')) AS ident,
                  strip_query(concat(source_url, '?a=1')) AS url, collapse_ws(concat(' ', title, '\n x ')) AS title,
                  date_format(parse_ts(date_format(date_scraped, "yyyy-MM-dd'T'HH:mm:ss-01:00")), 'yyyy-MM-dd HH:mm:ss') AS parsed,
                  CAST(CAST(cad_annual_estimate(pay, NULL, 'usd', 'hour') AS DECIMAL(18,6)) AS STRING) AS estimate,
                  date_format(week_of(date_scraped), 'yyyy-MM-dd') AS week, strip_ws(concat('\t', source_type)) AS source,
                  looks_canadian(location) AS canadian,
                  CAST(price_call(id, 1000, 3, 15, id % 2 = 0) AS STRING) AS price
           FROM {postings}""",
        postings=postings(spark, sf_dir, skills=False),
    )


QUERIES = {
    "posting_rows": posting_rows,
    "posting_inserted": posting_inserted,
    "sql_functions": sql_functions,
    "total_jobs": total_jobs,
    "top_skills": top_skills,
    "top_roles": top_roles,
    "top_companies": top_companies,
    "corpus_stats": corpus_stats,
    "sources_all_recent": sources_all_recent,
    "source_labels": source_labels,
    "fresh_total": fresh_total,
    "skill_history_default": skill_history_default,
    "skill_history_named": skill_history_named,
    "skill_series": skill_series,
    "skill_matrix": skill_matrix,
    "postings_per_week": postings_per_week,
    "posting_skills": posting_skills,
    "posting_output": lambda spark, sf_dir: _output(postings(spark, sf_dir)),
    "filter_location": _filtered(location="Remote"),
    "filter_company": _filtered(company="CUSTOMER#000000007"),
    "filter_source": _filtered(source_type="MACHINERY"),
    "filter_skill": _filtered(skill="Widget"),
    "filter_title": _filtered(q="urgent"),
    "filter_since": _filtered(since_days=30),
    "jobs_page": jobs_page,
    "jobs_page_after": jobs_page_after,
    "jobs_page_deep": jobs_page_deep,
    "companies_weekly": companies_weekly,
    "jobs_count": jobs_count,
    "jobs_page_count": jobs_page_count,
    "job_by_id": job_by_id,
    "posting_urls": posting_urls,
}

_OUT = """id, title, company, location, array_to_string(skills, ',') AS skills,
  strftime(date_scraped, '%Y-%m-%d %H:%M:%S') AS date_scraped, source_url, raw_description, source_type"""
_OUT = _OUT.replace("array_to_string(skills, ',')", "coalesce(array_to_string(skills, ','), '')")
_M = f"WITH {P_CTE}, m AS (SELECT id, date_scraped, unnest(skills) AS skill FROM p)"
_WEEK = "strftime(date_trunc('week', date_scraped), '%Y-%m-%d')"
_NAMED = ", ".join(f"'{n}'" for n in NAMED)


def _where(condition: str) -> str:
    return f"WITH {P_CTE} SELECT {_OUT} FROM p WHERE {condition}"


ORACLES = {
    "posting_rows": f"""WITH {P_CTE} SELECT source_url, coalesce(location, 'Unknown') AS location,
        CASE title WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE '' END AS skills,
        (SELECT strftime(t, '%Y-%m-%d %H:%M:%S') FROM now_p) AS date_scraped FROM p""",
    "posting_inserted": """SELECT o_orderpriority AS title, count(*) AS n FROM orders GROUP BY 1
        UNION ALL SELECT 'new', 1""",
    "sql_functions": f"""WITH {P_CTE}, {sql_places_cte('p')} SELECT id, sha256(lower(title) || chr(31) || lower(company) || chr(31)
          || lower(coalesce(location, '')) || chr(31) || 'x') AS digest,
        replace(lower(company), '#', '#') AS key, CAST(id + 1000000 AS VARCHAR) AS ident, source_url AS url, title || ' x' AS title,
        strftime(date_scraped + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS parsed,
        CAST(CAST(round_even(CAST(pay AS DECIMAL(18,2)) * 2080 * CAST(1.37 AS DECIMAL(5,2)), 2) AS DECIMAL(18,6)) AS VARCHAR) AS estimate,
        strftime(date_trunc('week', date_scraped), '%Y-%m-%d') AS week, source_type AS source, coalesce(canadian, true) AS canadian,
        CAST(CAST((CAST(id AS DECIMAL(14,0)) * 3 + 15000) * CASE WHEN id % 2 = 0 THEN 5 ELSE 10 END AS DECIMAL(20,12))
          * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(24,12))::VARCHAR AS price
        FROM p LEFT JOIN (SELECT location AS place, canadian FROM places) ON place IS NOT DISTINCT FROM location""",
    "total_jobs": "SELECT count(*) AS total_jobs FROM orders",
    "top_skills": f"{_M} SELECT skill, count(*) AS n FROM m GROUP BY skill ORDER BY n DESC, skill LIMIT 20",
    "top_roles": """SELECT o_orderpriority AS title, count(*) AS n FROM orders
        GROUP BY 1 ORDER BY n DESC, title LIMIT 20""",
    "top_companies": """SELECT c_name AS company, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY 1 ORDER BY n DESC, company LIMIT 15""",
    "corpus_stats": f"""WITH {P_CTE} SELECT count(*) AS total_jobs, count(DISTINCT company) AS total_companies,
        strftime(max(date_scraped), '%Y-%m-%d %H:%M:%S') AS last_scraped FROM p""",
    "sources_all_recent": f"""WITH {P_CTE} SELECT source_type, count(*) AS n,
        count(*) FILTER (WHERE date_scraped >= (SELECT t FROM now_p) - INTERVAL 7 DAY) AS recent,
        round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY source_type""",
    "source_labels": f"WITH {P_CTE} SELECT source_type, source_type AS label, count(*) AS n FROM p GROUP BY source_type",
    "fresh_total": f"""WITH {P_CTE} SELECT count(*) AS fresh FROM p
        WHERE date_scraped >= (SELECT t FROM now_p) - INTERVAL 7 DAY""",
    "skill_history_default": f"""{_M}, top AS (SELECT skill FROM m GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 5)
        SELECT {_WEEK} AS week, skill, count(*) AS n FROM m
        WHERE date_scraped >= (SELECT t FROM now_p) - INTERVAL 56 DAY AND skill IN (SELECT skill FROM top)
        GROUP BY 1, 2 ORDER BY 1, 2""",
    "skill_history_named": f"""{_M} SELECT {_WEEK} AS week, skill, count(*) AS n FROM m
        WHERE date_scraped >= (SELECT t FROM now_p) - INTERVAL 364 DAY AND skill IN ({_NAMED})
        GROUP BY 1, 2 ORDER BY 1, 2""",
    "skill_series": f"""{_M}, c AS (SELECT {_WEEK} AS week, skill, count(*) AS n FROM m
          WHERE date_scraped >= (SELECT t FROM now_p) - INTERVAL 56 DAY GROUP BY 1, 2),
        asked AS (SELECT unnest([{_NAMED}]) AS skill, unnest(range(0, {len(NAMED)})) AS position)
        SELECT CAST(position AS INTEGER) AS position, asked.skill,
               coalesce(string_agg(week || ':' || n, ',' ORDER BY week), '') AS points
        FROM asked LEFT JOIN c ON c.skill = asked.skill GROUP BY 1, 2 ORDER BY 1""",
    "skill_matrix": f"""{_M} SELECT {_WEEK} AS week, {", ".join(
        f"count(*) FILTER (WHERE skill = '{n}') AS {n}" for n in NAMED)} FROM m
        WHERE date_scraped >= (SELECT t FROM now_p) - INTERVAL 364 DAY AND skill IN ({_NAMED}) GROUP BY 1""",
    "postings_per_week": "SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) AS n FROM orders GROUP BY 1",
    "posting_skills": f"{_M} SELECT id, skill FROM m",
    "posting_output": f"WITH {P_CTE} SELECT {_OUT} FROM p",
    "filter_location": _where("contains(lower(location), 'remote')"),
    "filter_company": _where("lower(company) = 'customer#000000007'"),
    "filter_source": _where("source_type = 'machinery'"),
    "filter_skill": _where("list_contains(skills, 'widget')"),
    "filter_title": _where("contains(lower(title), 'urgent')"),
    "filter_since": _where("date_scraped >= (SELECT t FROM now_p) - INTERVAL 30 DAY"),
    "jobs_page": _where("contains(lower(location), 'remote') ORDER BY p.date_scraped DESC, id LIMIT 25 OFFSET 40"),
    "jobs_page_deep": _where("""contains(lower(location), 'remote') ORDER BY p.date_scraped DESC, id LIMIT 25
        OFFSET (SELECT CAST(ceil(count(*) / 25) AS BIGINT) // 2 * 25 FROM p WHERE contains(lower(location), 'remote'))"""),
    "companies_weekly": f"""WITH {P_CTE} SELECT strftime(date_trunc('week', date_scraped), '%Y-%m-%d') AS week, count(*) AS n,
        count(DISTINCT company) AS exact, true AS near FROM p GROUP BY 1""",
    "jobs_page_after": _where("true ORDER BY p.date_scraped DESC, id LIMIT 50 OFFSET 50"),
    "jobs_count": f"""WITH {P_CTE} SELECT count(*) AS total FROM p WHERE list_contains(skills, 'red')
        AND contains(lower(title), 'high') AND source_type = 'building'""",
    "jobs_page_count": f"""WITH {P_CTE} SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 50) AS BIGINT), 1) AS pages
        FROM p WHERE contains(lower(location), 'toronto')""",
    "job_by_id": _where("id = 7"),
    "posting_urls": """SELECT o_orderkey AS id, 'https://x.example/jobs-' || (o_orderkey + 1000000) AS url,
        CAST(o_orderkey + 1000000 AS VARCHAR) AS long_id FROM orders""",
}
