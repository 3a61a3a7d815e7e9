"""Postings, ledgers, documents and responses derived from the test tables.

Every binding reads whole tables.  The SQL twins of these definitions stand in
`CTE`, so that a check can rebuild the same input on another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.arrays import no_strings
from tidemark.session import apply_defaults

LOCATIONS = (
    "Toronto, Ontario", "Ottawa, Canada", "Remote (Canada)", "Kitchener-Waterloo, ON",
    "Montréal, QC", "Remote", "London, ON", "Toronto | San Francisco | New York | Remote",
    "Americas | Remote", "Pointe Claire", "TBD", "San Francisco, CA", "New York, NY",
    "Remote US", "EMEA - Remote", "Amsterdam | Remote", "Melbourne, Victoria", "Remote, KSA",
    "Hamburg | Remote", "Lenexa, KS", "Sudbury | Remote", "Hybrid Sudbury",
    "Vancouver, British Columbia; Seattle, WA", "Sydney, Australia", None,
)
NAME_ENDINGS = (
    "Inc.", "Ltd.", "Staffing", "Talent Agency", "Corp", "Labs", "Consulting Group", "Recruiting",
)


# Declared, so that opening a table starts no job to look into its files.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
        " l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_defaults(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """values[index] for an index column."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(values, index: str) -> str:
    return f"([{', '.join(sql_text(v) for v in values)}])[({index}) + 1]"


def clock(df: DataFrame, column: str) -> Column:
    """The latest time in a column, as a literal: the 'now' of a binding."""
    return F.lit(df.agg(F.max(column).cast("string")).first()[0]).cast("timestamp")


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def list_text(c: Column) -> Column:
    return F.array_join(c, ",")


def money_text(c: Column) -> Column:
    return c.cast("decimal(18,6)").cast("string")


# --- postings -----------------------------------------------------------------


def order_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, skills): the sorted distinct part words of an order.

    collect_set keeps one entry per word of the part vocabulary, and does so
    before the shuffle, so an order with any number of lines stays small.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    words = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("id"), F.explode(F.split("p_name", " ")).alias("word")
    )
    return words.groupBy("id").agg(F.sort_array(F.collect_set("word")).alias("skills"))


def postings(spark: SparkSession, sf_dir: str, skills: bool = True, company: bool = True) -> DataFrame:
    """Orders as postings.  What a query does not need is not joined."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("date_scraped"),
        F.concat(F.lit("https://x.example/jobs-"), F.col("o_orderkey") + 1000000).alias("source_url"),
        F.col("o_totalprice").alias("pay"),
    )
    if company:
        customers = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"),
            F.col("c_name").alias("company"),
            pick(LOCATIONS, F.col("c_nationkey")).alias("location"),
            F.lower("c_mktsegment").alias("source_type"),
            F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("balance"),
        )
        rows = rows.join(customers, "o_custkey")
    if skills:
        rows = rows.join(order_skills(spark, sf_dir), "id", "left").withColumn(
            "skills", F.coalesce("skills", no_strings())
        )
        rows = rows.withColumn(
            "raw_description",
            F.concat(F.lit("We look for "), F.array_join("skills", ", "), F.lit(" and care.")),
        )
    return rows.drop("o_custkey")


P_CTE = f"""
w AS (SELECT DISTINCT l_orderkey AS k, unnest(string_split(p_name, ' ')) AS word
      FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT k, list_sort(list(word)) AS skills FROM w GROUP BY k),
p AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderdate AS date_scraped,
             'https://x.example/jobs-' || (o_orderkey + 1000000) AS source_url,
             o_totalprice AS pay, c_name AS company,
             {sql_pick(LOCATIONS, 'c_nationkey')} AS location,
             lower(c_mktsegment) AS source_type, c_nationkey AS nation, c_acctbal AS balance,
             coalesce(skills, []::VARCHAR[]) AS skills,
             'We look for ' || coalesce(array_to_string(skills, ', '), '') || ' and care.' AS raw_description
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON s.k = o_orderkey),
now_p AS (SELECT max(date_scraped) AS t FROM p)
"""


def discovery_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as aggregator listings: employer names with and without agency words."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer")
    named = customers.select(
        F.col("c_custkey").alias("o_custkey"),
        F.concat_ws(" ", F.translate("c_name", "#", " "), pick(NAME_ENDINGS, F.col("c_custkey") % 8)).alias("company"),
        pick(LOCATIONS, F.col("c_nationkey")).alias("location"),
        "c_nationkey",
    )
    return orders.join(named, "o_custkey").select(
        F.col("o_orderkey").alias("fetch_seq"), "company", "location", "o_custkey", "c_nationkey"
    )


DISCOVERY_CTE = f"""
d AS (SELECT o_orderkey AS fetch_seq, c_custkey,
             replace(c_name, '#', ' ') || ' ' || {sql_pick(NAME_ENDINGS, 'c_custkey % 8')} AS company,
             {sql_pick(LOCATIONS, 'c_nationkey')} AS location
      FROM orders JOIN customer ON o_custkey = c_custkey)
"""


# --- documents ----------------------------------------------------------------


def document_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings; exact copies share a url."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("source_type"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("external_id"),
        F.concat(F.lit("https://d.example/"), F.md5("text")).alias("source_url"),
        F.concat(F.lit("Doc "), F.col("lang")).alias("title"),
        F.concat(F.lit("Firm  "), F.upper("source")).alias("company"),
        pick(LOCATIONS, F.col("doc_id") % 25).alias("location"),
        F.col("text").alias("description"),
        F.col("doc_id").alias("fetch_seq"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("fetched_at"),
    )


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that already carry a label: what an earlier run has landed."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fetch_seq"))


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\t\\n\\r]+', ' ', 'g'))"


D_CTE = f"""
l AS (SELECT source AS source_type, source AS source_name, lang AS external_id,
             'https://d.example/' || md5(text) AS source_url, 'Doc ' || lang AS title,
             'Firm  ' || upper(source) AS company, {sql_pick(LOCATIONS, 'doc_id % 25')} AS location,
             text AS description, doc_id AS fetch_seq,
             TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60) AS fetched_at
      FROM documents),
h AS (SELECT *, sha256(lower({sql_collapse('title')}) || chr(31) || lower({sql_collapse('company')})
                || chr(31) || lower({sql_collapse("coalesce(location, '')")})
                || chr(31) || lower({sql_collapse('description')})) AS content_hash
      FROM l)
"""


# --- ledger -------------------------------------------------------------------


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a spend ledger: a run per user, a purpose per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("purpose"),
        F.col("value").cast("decimal(10,6)").alias("cost_usd"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


E_CTE = """
e AS (SELECT event_id AS id, user_id AS run_id, event_type AS purpose,
             CAST(value AS DECIMAL(10,6)) AS cost_usd, ts AS created_at FROM events)
"""

# --- locations ----------------------------------------------------------------


def sql_segment_kind(g: str) -> str:
    """The location rules as one CASE over a lower-case segment."""
    def words(values) -> str:
        escaped = [v.replace("(", r"\(").replace(")", r"\)").replace(".", r"\.").replace("'", "''") for v in values]
        return "|".join(escaped)

    provinces = "|".join(fv.PROVINCE_CODES)
    states = "|".join(fv.US_STATE_CODES)
    arrangement = words(fv.ARRANGEMENT_WORDS)
    return f"""CASE
      WHEN regexp_matches({g}, 'canada|\\(can\\)|{words(fv.PROVINCES)}') THEN 'ca'
      WHEN regexp_matches({g}, '(^|[\\s,(])({provinces})($|[\\s,).|])') THEN 'ca'
      WHEN regexp_matches({g}, '{words(fv.CANADA_INCLUSIVE_REGIONS)}') THEN 'ca'
      WHEN regexp_matches({g}, '{words(fv.FOREIGN_PLACES)}') THEN 'foreign'
      WHEN regexp_matches({g}, '\\bu\\.?s\\.?a?\\.?\\b') THEN 'foreign'
      WHEN regexp_matches({g}, '(^|[\\s,(])({states})($|[\\s,).|])') THEN 'foreign'
      WHEN regexp_matches({g}, '{words(fv.CITIES)}') THEN 'ca'
      WHEN NOT regexp_matches(regexp_replace({g}, '{arrangement}', ' ', 'g'), '[a-z]') THEN 'arrangement'
      WHEN regexp_matches({g}, '{arrangement}') THEN 'foreign'
      ELSE 'unknown' END"""


def sql_places_cte(source: str) -> str:
    """A table `places` (location, canadian) of every distinct location in `source`."""
    return f"""
locs AS (SELECT DISTINCT location FROM {source}),
segs AS (SELECT location, trim(seg) AS seg
         FROM (SELECT location, unnest(regexp_split_to_array(location, '[|;]')) AS seg FROM locs)
         WHERE trim(seg) <> ''),
kinds AS (SELECT location, seg, {sql_segment_kind('lower(seg)')} AS kind FROM segs),
places AS (SELECT locs.location, coalesce(bool_or(kind = 'ca'), false)
                  OR (NOT coalesce(bool_or(kind = 'foreign'), false)
                      AND NOT (coalesce(bool_or(kind = 'arrangement'), false)
                               AND coalesce(bool_or(kind = 'unknown'), false))) AS canadian
           FROM locs LEFT JOIN kinds ON kinds.location = locs.location GROUP BY locs.location)
"""
