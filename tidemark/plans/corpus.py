"""Ingestion and text queries over documents and pages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import geo, terms, text
from tidemark.operators import evaluate, ingest, quality
from tidemark.plans.bindings import (
    D_CTE,
    DISCOVERY_CTE,
    LOCATIONS,
    P_CTE,
    discovery_listings,
    document_listings,
    labelled_ids,
    list_text,
    pick,
    postings,
    sql_collapse,
    sql_pick,
    sql_places_cte,
    sql_segment_kind,
    table,
    ts_text,
)
from tidemark.plans.scratch import run_folder
from tidemark.session import pinned

# Frequent words and two-word phrases of the invented prose.
VOCABULARY = (
    "the", "of", "and", "that", "que", "und", "les", "rewh", "hehely", "tion", "c++",
    "of the", "and the", "de la", "the the", "rewh rewh", "der der", "in the", "the of the",
)


def doc_hash(spark, sf_dir):
    return ingest.with_hash(document_listings(spark, sf_dir)).select("fetch_seq", "content_hash")


def doc_collapsed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.collapse_ws(F.col("text"))).alias("digest"))


def docs_disposition(spark, sf_dir):
    marked = ingest.assign_disposition(document_listings(spark, sf_dir), folded=None)
    return marked.select("fetch_seq", "source_type", "disposition")


def docs_run_counts(spark, sf_dir):
    listings = document_listings(spark, sf_dir)
    counts = ingest.run_counts(ingest.assign_disposition(listings, folded=None))
    return quality.counter_identity(counts)


def docs_fast_counts(spark, sf_dir):
    return ingest.fast_run_counts(document_listings(spark, sf_dir), folded=None)


def _hashed(spark, sf_dir):
    """(keys and hash of the listings, the labelled ones among them as landed before), hashed once."""
    keys = ("source_type", "source_name", "source_url", "content_hash", "location", "fetch_seq")
    new = pinned(ingest.with_hash(document_listings(spark, sf_dir)).select(*keys))
    return new, new.join(labelled_ids(spark, sf_dir), "fetch_seq", "left_semi")


def docs_full_counts(spark, sf_dir):
    """Counters of a run against what labelled documents have landed before; every 50th body failed."""
    new, landed = _hashed(spark, sf_dir)
    marked = ingest.assign_disposition(new, folded=None)
    kept = marked.where(F.col("disposition") == "kept")
    new_raw = ingest.insert_if_absent(kept, landed, ingest.RAW_KEY, "fetch_seq")
    new_postings = ingest.insert_if_absent(kept, landed, ingest.POSTING_KEY, "fetch_seq")
    failed = new.where(F.col("fetch_seq") % 50 == 0).select("source_type", F.concat("source_name", F.lit("-x")).alias("source_name"))
    counts = ingest.run_counts(marked, new_raw, new_postings, failed)
    return counts.withColumn("failed_boards", list_text(F.col("failed_boards")))


def docs_new_raw(spark, sf_dir):
    """New contents by the key index of what has landed: only buckets that hold keys of the run are read."""
    new, landed = _hashed(spark, sf_dir)
    out = run_folder(spark, "docs_new_raw")
    landed.select(*ingest.RAW_KEY).write.parquet(f"{out}/raw")
    index = ingest.key_index(spark, f"{out}/raw", ingest.RAW_KEY)
    fresh = ingest.insert_by_index(new, index, "fetch_seq")
    return fresh.select("fetch_seq", "source_type", "content_hash")


def docs_new_postings(spark, sf_dir):
    new = document_listings(spark, sf_dir)
    landed = new.join(labelled_ids(spark, sf_dir), "fetch_seq", "left_semi")
    fresh = ingest.insert_if_absent(new, landed, ingest.POSTING_KEY, "fetch_seq")
    return fresh.select("fetch_seq", "source_url")


def docs_stored(spark, sf_dir):
    """Dual write of a run, run again, then read back: the second run adds nothing."""
    out = run_folder(spark, "docs_stored")
    kept = ingest.keep_in_scope(document_listings(spark, sf_dir))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    first, second = (
        [keys.count() for keys in ingest.store(kept, f"{out}/raw", f"{out}/postings", now)] for _ in range(2)
    )
    added = F.lit(sum(second)).alias("second_run")
    written = [
        spark.read.parquet(f"{out}/{name}").agg(F.count("*").alias("n"), F.countDistinct("source_url").alias("urls"))
        .select(F.lit(name).alias("table_name"), "n", "urls", F.lit(gained).cast("bigint").alias("gained"), added.cast("bigint"))
        for name, gained in zip(("raw", "postings"), first, strict=True)
    ]
    return written[0].unionByName(written[1])


SHOPS = ("greenhouse", "lever", "adzuna", "jooble")


def store_counts(spark, sf_dir):
    """A run of two boards and two aggregators, counted and stored by one rule; copies share a url.

    Counters stand beside what the tables hold afterwards.
    """
    out = run_folder(spark, "store_counts")
    listings = document_listings(spark, sf_dir).withColumn("source_type", pick(SHOPS, F.col("fetch_seq") % 4))
    failed = listings.where(F.col("fetch_seq") % 50 == 0).select("source_type", "source_name")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    counts = ingest.ingest_run(listings, f"{out}/raw", f"{out}/postings", now, failed)
    stored = [
        spark.read.parquet(f"{out}/{name}").groupBy("source_type").agg(F.count("*").alias(f"stored_{name}"))
        for name in ("raw", "postings")
    ]
    both = counts.join(stored[0], "source_type", "left").join(stored[1], "source_type", "left").fillna(0)
    return both.withColumn("failed_boards", list_text(F.col("failed_boards")))


def content_versions(spark, sf_dir):
    raw = ingest.with_hash(document_listings(spark, sf_dir))
    found = ingest.content_versions(raw, ["external_id"])
    return found.withColumn("first_seen", ts_text(F.col("first_seen")))


def content_versions_grown(spark, sf_dir):
    """The same table grown in three steps, each of which numbers on from what is stored; the last one runs twice."""
    out = run_folder(spark, "content_versions")
    hashed = ingest.with_hash(document_listings(spark, sf_dir))
    raw = pinned(hashed.select("external_id", "content_hash", "fetched_at", "fetch_seq"))
    third = raw.agg((F.max("fetched_at").cast("double") / 3 + F.min("fetched_at").cast("double") * 2 / 3).alias("x")).first().x
    first = raw.agg(F.min("fetched_at").cast("double").alias("x")).first().x
    step = F.least(F.floor((F.col("fetched_at").cast("double") - first) / max(third - first, 1.0)), F.lit(2))
    for number in (0, 1, 2, 2):
        ingest.add_versions(raw.where(step == number), f"{out}/versions", ["external_id"])
    found = spark.read.parquet(f"{out}/versions")
    return found.withColumn("first_seen", ts_text(F.col("first_seen")))


def order_texts(spark, sf_dir):
    """(id, text): what was ordered, line by line, as a text of names and numbers."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    said = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("id"), F.concat(F.upper("p_name"), F.lit("  "), F.col("p_partkey").cast("string")).alias("said"), "l_linenumber"
    )
    # an order has a handful of lines
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "said"))), lambda x: x["said"]), ";\n")
    return said.groupBy("id").agg(joined.alias("text"))


def part_phrases(spark, sf_dir):
    """Terms out of a vocabulary as large as the part table: every part's name with its number, and the names alone."""
    parts = table(spark, sf_dir, "part")
    named = parts.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("term"))
    vocabulary = named.union(parts.select("p_name"))
    found = terms.extract_from_table(order_texts(spark, sf_dir), vocabulary, "id", "text")
    return found.select("id", list_text(F.col("terms")).alias("terms"))


def doc_terms_table(spark, sf_dir):
    """doc_terms with the vocabulary as a table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = spark.createDataFrame([(v,) for v in VOCABULARY], "term string")
    found = terms.extract_from_table(docs, vocabulary, "doc_id", "text")
    return found.select("doc_id", list_text(F.col("terms")).alias("terms"))


def doc_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", list_text(terms.extract_terms(F.col("text"), VOCABULARY)).alias("terms"))


def top_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("lang", F.explode(terms.extract_terms(F.col("text"), VOCABULARY)).alias("term"))
    return found.groupBy("lang", "term").agg(F.count("*").alias("n"))


def base_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.explode(terms.extract_terms(F.col("text"))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n"))


def long_descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") > 200).groupBy("lang").agg(
        F.count("*").alias("n")
    )


def sample_pool(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("title"),
        F.col("source").alias("company"),
        F.col("text").alias("raw_description"),
    )
    return evaluate.sample_pool(docs, 150, 42)


def location_kind(spark, sf_dir):
    p = postings(spark, sf_dir, skills=False)
    segment = F.explode(F.transform(F.split("location", "[|;]"), lambda x: F.trim(x))).alias("segment")
    counted = p.select(segment).groupBy("segment").agg(F.count("*").alias("n"))
    return counted.withColumn("kind", geo.segment_kind(F.col("segment")))


def canadian_only(spark, sf_dir):
    return ingest.keep_in_scope(postings(spark, sf_dir, skills=False)).select("id", "location")


def mixed_locations(spark, sf_dir):
    """Every pair of a customer's and a supplier's place that occurs on a line, graded."""
    def place(c):
        return F.coalesce(c, F.lit(""))

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    here = F.get(F.array(*[F.lit(v) for v in LOCATIONS]), F.col("c_nationkey"))
    there = F.get(F.array(*[F.lit(v) for v in LOCATIONS]), F.col("s_nationkey"))
    pairs = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.concat(place(here), F.lit(" | "), place(there)).alias("location"))
        .groupBy("location").agg(F.count("*").alias("n"))
    )
    return pairs.withColumn("canadian", geo.looks_canadian(F.col("location")))


def page_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))


def page_escaped_text(spark, sf_dir):
    """Markup escaped once more, as some sources deliver it."""
    escaped = F.replace(
        F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit(">"), F.lit("&gt;"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", escaped.alias("html"))
    return pages.select("page_id", text.html_to_text(F.col("html"), escaped=True).alias("text"))


def page_title_inline(spark, sf_dir):
    title = text.element_markup(F.col("html"), "title")
    body = text.html_to_text(F.col("html"), inline=True)
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.html_to_text(title, inline=True).alias("title"), body.alias("body"))


def page_url_clean(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.strip_query(F.col("url")).alias("url"))


def page_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    containers = (("main", "", ""), ("article", "", ""), *fv.CONTENT_CONTAINERS)
    return pages.select("page_id", text.main_content(F.col("html"), containers).alias("text"))


def slug_guesses(spark, sf_dir):
    listings = discovery_listings(spark, sf_dir).select("company").distinct()
    return listings.select("company", list_text(text.slug_guesses(F.col("company"))).alias("slugs"))


QUERIES = {
    "doc_hash": doc_hash,
    "doc_collapsed": doc_collapsed,
    "docs_disposition": docs_disposition,
    "docs_run_counts": docs_run_counts,
    "docs_fast_counts": docs_fast_counts,
    "docs_full_counts": docs_full_counts,
    "docs_new_raw": docs_new_raw,
    "docs_new_postings": docs_new_postings,
    "docs_stored": docs_stored,
    "store_counts": store_counts,
    "content_versions": content_versions,
    "content_versions_grown": content_versions_grown,
    "part_phrases": part_phrases,
    "doc_terms_table": doc_terms_table,
    "doc_terms": doc_terms,
    "top_terms": top_terms,
    "base_terms": base_terms,
    "long_descriptions": long_descriptions,
    "sample_pool": sample_pool,
    "location_kind": location_kind,
    "canadian_only": canadian_only,
    "mixed_locations": mixed_locations,
    "page_text": page_text,
    "page_escaped_text": page_escaped_text,
    "page_title_inline": page_title_inline,
    "page_url_clean": page_url_clean,
    "page_main_text": page_main_text,
    "slug_guesses": slug_guesses,
}

_PLACED = f"""{D_CTE}, {sql_places_cte('l')},
f AS (SELECT h.*, row_number() OVER (PARTITION BY source_url ORDER BY fetch_seq) AS nth,
             coalesce(places.canadian, true) AS canadian
      FROM h LEFT JOIN places ON places.location IS NOT DISTINCT FROM h.location),
v AS (SELECT *, CASE WHEN nth > 1 THEN 'duplicate' WHEN NOT canadian THEN 'filtered_location'
                     ELSE 'kept' END AS disposition FROM f)"""
_COUNTS = """source_type, count(*) AS fetched, count(*) FILTER (WHERE disposition = 'kept') AS kept,
count(*) FILTER (WHERE disposition = 'filtered_location') AS filtered_location,
count(*) FILTER (WHERE disposition = 'duplicate') AS duplicate_in_run"""
_LANDED = "landed AS (SELECT h.* FROM h WHERE fetch_seq IN (SELECT doc_id FROM labels))"

_TOKEN = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*[+#]*|[^\s\p{L}\p{N}]"


def _terms_cte(vocabulary, keep: str = "true") -> str:
    """(doc_id, term) of a token n-gram match written with list slices and a join."""
    phrases = ", ".join(
        f"('{' '.join(terms._TOKEN_PY.findall(v))}', '{v}')" for v in vocabulary
    )
    return f"""
voc(phrase, term) AS (VALUES {phrases}),
tok AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '{_TOKEN}') AS t FROM documents WHERE {keep}),
pos AS (SELECT doc_id, lang, t, unnest(range(1, len(t) + 1)) AS i FROM tok),
gram AS (SELECT doc_id, lang, t[i] AS phrase FROM pos
         UNION ALL SELECT doc_id, lang, t[i] || ' ' || t[i + 1] FROM pos WHERE i < len(t)
         UNION ALL SELECT doc_id, lang, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FROM pos WHERE i + 1 < len(t)),
hit AS (SELECT DISTINCT doc_id, lang, term FROM gram JOIN voc USING (phrase))"""


def _markup_sql(html: str) -> str:
    """Visible text nodes, trimmed, one per line."""
    hidden = "<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
    nodes = f"regexp_replace(regexp_replace({html}, '{hidden}', chr(1), 'gs'), '<[^>]*>', chr(1), 'g')"
    plain = nodes
    # some titles end inside an entity, which then lacks its semicolon
    for entity, char in (("&quot", '"'), ("&copy", "©"), ("&middot", "·"), ("&lt", "<"), ("&gt", ">"), ("&amp", "&")):
        plain = f"regexp_replace({plain}, '{entity};?', '{char}', 'g')"
    trimmed = f"list_transform(string_split({plain}, chr(1)), lambda n: trim(n, ' ' || chr(10) || chr(13) || chr(9)))"
    return f"coalesce(array_to_string(list_filter({trimmed}, lambda n: n <> ''), chr(10)), '')"


def _inside(tag: str) -> str:
    return f"regexp_extract(html, '(?s)<{tag}[^>]*>(.*)</{tag}>', 1)"


_CLEAN = "regexp_replace(html, '<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gs')"

ORACLES = {
    "doc_hash": f"WITH {D_CTE} SELECT fetch_seq, content_hash FROM h",
    "doc_collapsed": f"SELECT doc_id, md5({sql_collapse('text')}) AS digest FROM documents",
    "docs_disposition": f"WITH {_PLACED} SELECT fetch_seq, source_type, disposition FROM v",
    "docs_run_counts": f"WITH {_PLACED} SELECT {_COUNTS}, true AS balanced FROM v GROUP BY source_type",
    "docs_fast_counts": f"WITH {_PLACED} SELECT {_COUNTS} FROM v GROUP BY source_type",
    "docs_full_counts": f"""WITH {_PLACED}, {_LANDED},
        k AS (SELECT * FROM v WHERE disposition = 'kept')
        SELECT {_COUNTS},
          count(*) FILTER (WHERE disposition = 'kept' AND NOT EXISTS (SELECT 1 FROM landed x WHERE
            x.source_type = v.source_type AND x.source_url = v.source_url AND x.content_hash = v.content_hash)) AS new_raw,
          count(*) FILTER (WHERE disposition = 'kept' AND NOT EXISTS (SELECT 1 FROM landed x WHERE
            x.source_url = v.source_url)) AS new_postings,
          coalesce(string_agg(DISTINCT source_name || '-x', ',' ORDER BY source_name || '-x')
            FILTER (WHERE fetch_seq % 50 = 0), '') AS failed_boards
        FROM v GROUP BY source_type""",
    "store_counts": f"""WITH {D_CTE}, {sql_places_cte('l')},
        s AS (SELECT h.* EXCLUDE (source_type), {sql_pick(SHOPS, 'fetch_seq % 4')} AS source_type, fetch_seq % 4 < 2 AS board,
                coalesce(places.canadian, true) AS canadian
              FROM h LEFT JOIN places ON places.location IS NOT DISTINCT FROM h.location),
        n AS (SELECT *, row_number() OVER (PARTITION BY board, source_url ORDER BY fetch_seq) AS nth FROM s),
        v AS (SELECT *, CASE WHEN NOT board AND nth > 1 THEN 'duplicate' WHEN NOT canadian THEN 'filtered_location'
                             ELSE 'kept' END AS disposition FROM n),
        r AS (SELECT source_type, count(DISTINCT (source_url, content_hash)) AS raw FROM v WHERE disposition = 'kept' GROUP BY 1),
        b AS (SELECT source_url, arg_min(source_type, fetch_seq) AS source_type FROM v WHERE disposition = 'kept' AND board GROUP BY 1),
        p AS (SELECT source_type, count(*) AS postings FROM b GROUP BY 1),
        c AS (SELECT {_COUNTS}, coalesce(string_agg(DISTINCT source_name, ',' ORDER BY source_name)
                FILTER (WHERE fetch_seq % 50 = 0), '') AS failed_boards FROM v GROUP BY source_type)
        SELECT c.*, coalesce(raw, 0) AS new_raw, coalesce(postings, 0) AS new_postings, coalesce(raw, 0) AS stored_raw,
          coalesce(postings, 0) AS stored_postings
        FROM c LEFT JOIN r USING (source_type) LEFT JOIN p USING (source_type)""",
    "docs_new_raw": f"""WITH {D_CTE}, {_LANDED}
        SELECT min(fetch_seq) AS fetch_seq, source_type, content_hash FROM h
        WHERE NOT EXISTS (SELECT 1 FROM landed x WHERE x.source_type = h.source_type
          AND x.source_url = h.source_url AND x.content_hash = h.content_hash)
        GROUP BY source_type, source_url, content_hash""",
    "docs_new_postings": f"""WITH {D_CTE}, {_LANDED} SELECT min(fetch_seq) AS fetch_seq, source_url FROM h
        WHERE NOT EXISTS (SELECT 1 FROM landed x WHERE x.source_url = h.source_url) GROUP BY source_url""",
    "docs_stored": f"""WITH {_PLACED}, k AS (SELECT * FROM f WHERE canadian)
        SELECT 'raw' AS table_name, count(*) AS n, count(DISTINCT source_url) AS urls, count(*) AS gained, 0 AS second_run
        FROM (SELECT DISTINCT source_type, source_url, content_hash FROM k)
        UNION ALL SELECT 'postings', count(DISTINCT source_url), count(DISTINCT source_url), count(DISTINCT source_url), 0 FROM k""",
    "content_versions": f"""WITH {D_CTE}, x AS (SELECT external_id, content_hash, min(fetched_at) AS t FROM h GROUP BY 1, 2)
        SELECT external_id, content_hash, strftime(t, '%Y-%m-%d %H:%M:%S') AS first_seen,
          row_number() OVER (PARTITION BY external_id ORDER BY t, content_hash) AS version,
          row_number() OVER (PARTITION BY external_id ORDER BY t, content_hash) > 1 AS changed FROM x""",
    "content_versions_grown": f"""WITH {D_CTE}, x AS (SELECT external_id, content_hash, min(fetched_at) AS t FROM h GROUP BY 1, 2)
        SELECT external_id, content_hash, strftime(t, '%Y-%m-%d %H:%M:%S') AS first_seen,
          row_number() OVER (PARTITION BY external_id ORDER BY t, content_hash) AS version,
          row_number() OVER (PARTITION BY external_id ORDER BY t, content_hash) > 1 AS changed FROM x""",
    "part_phrases": """WITH s AS (SELECT DISTINCT l_orderkey AS id, lower(p_name) AS name, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
        t AS (SELECT id, name AS term FROM s UNION SELECT id, name || ' ' || p_partkey FROM s)
        SELECT id, string_agg(term, ',' ORDER BY term) AS terms FROM t GROUP BY id""",
    "doc_terms": f"""WITH {_terms_cte(VOCABULARY)} SELECT d.doc_id, coalesce(string_agg(term, ',' ORDER BY term), '') AS terms
        FROM documents d LEFT JOIN hit ON hit.doc_id = d.doc_id GROUP BY d.doc_id""",
    "doc_terms_table": f"""WITH {_terms_cte(VOCABULARY)} SELECT d.doc_id, coalesce(string_agg(term, ',' ORDER BY term), '') AS terms
        FROM documents d LEFT JOIN hit ON hit.doc_id = d.doc_id GROUP BY d.doc_id""",
    "top_terms": f"WITH {_terms_cte(VOCABULARY)} SELECT lang, term, count(*) AS n FROM hit GROUP BY 1, 2",
    "base_terms": f"WITH {_terms_cte(terms.BASE_VOCABULARY)} SELECT term, count(*) AS n FROM hit GROUP BY 1",
    "long_descriptions": "SELECT lang, count(*) AS n FROM documents WHERE length(text) > 200 GROUP BY lang",
    "sample_pool": """SELECT CAST(doc_id AS VARCHAR) AS listing_id, 'prod_db' AS source, lang AS title, source AS company,
        text AS raw_description FROM documents WHERE length(text) > 200 ORDER BY md5('42|' || doc_id), doc_id LIMIT 150""",
    "location_kind": f"""WITH {P_CTE}, x AS (SELECT trim(unnest(regexp_split_to_array(location, '[|;]'))) AS segment FROM p)
        SELECT segment, count(*) AS n, {sql_segment_kind('lower(segment)')} AS kind FROM x GROUP BY segment""",
    "canadian_only": f"""WITH {P_CTE}, {sql_places_cte('p')} SELECT p.id, p.location FROM p
        LEFT JOIN places ON places.location = p.location WHERE p.location IS NULL OR places.canadian""",
    "mixed_locations": f"""WITH x AS (SELECT coalesce({sql_pick(LOCATIONS, 'c_nationkey')}, '') || ' | ' ||
          coalesce({sql_pick(LOCATIONS, 's_nationkey')}, '') AS location
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey), {sql_places_cte('x')}
        SELECT x.location, count(*) AS n, any_value(places.canadian) AS canadian
        FROM x JOIN places ON places.location = x.location GROUP BY x.location""",
    "page_text": f"SELECT page_id, {_markup_sql('html')} AS text FROM pages",
    "page_escaped_text": f"SELECT page_id, {_markup_sql('html')} AS text FROM pages",
    "page_title_inline": f"""SELECT page_id, {sql_collapse(_markup_sql(_inside('title')))} AS title,
        {sql_collapse(_markup_sql('html'))} AS body FROM pages""",
    "page_url_clean": "SELECT page_id, split_part(url, '?', 1) AS url FROM pages",
    "page_main_text": f"""WITH a AS (SELECT page_id, {_CLEAN} AS html FROM pages),
        b AS (SELECT page_id, {_markup_sql(_inside('article'))} AS art,
          {_markup_sql("regexp_extract(html, '(?s)<body[^>]*>(.*)', 1)")} AS body FROM a)
        SELECT page_id, CASE WHEN length(art) > 50 THEN art WHEN length(body) > 50 THEN body ELSE '' END AS text FROM b""",
    "slug_guesses": f"""WITH {DISCOVERY_CTE}, n AS (SELECT DISTINCT company FROM d),
        b AS (SELECT company, trim(regexp_replace(regexp_replace(lower(company), '\\b(inc|ltd|llc|corp|co|inc\\.|ltd\\.)\\.?$', ''),
          '[^a-z0-9 ]', '', 'g')) AS base FROM n)
        SELECT company, CASE WHEN contains(base, ' ') THEN replace(base, ' ', '') || ',' || replace(base, ' ', '-')
          ELSE base END AS slugs FROM b""",
}
