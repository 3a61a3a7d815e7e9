"""Taxonomy and review-queue queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.text import match_key
from tidemark.operators import queues, taxonomy
from tidemark.plans.bindings import (
    DISCOVERY_CTE,
    NAME_ENDINGS,
    P_CTE,
    discovery_listings,
    list_text,
    pick,
    postings,
    sql_places_cte,
    table,
    ts_text,
)
from tidemark.schemas import SKILL
from tidemark.session import pinned
from tidemark.sources import dimensions

# id, category, aliases; hot and cold are left out on purpose.
SKILLS = (
    ("red", "colour", ["Crimson"]),
    ("blue", "colour", ["azure", "sky-blue"]),
    ("widget", "product", ["gizmo", "Gadget"]),
    ("ring", "hardware", []),
    ("bolt", "hardware", ["screw bolt"]),
    ("gear", "hardware", []),
    ("plate", "hardware", []),
    ("rod", "hardware", ["ROD."]),
    ("anvil", "hardware", []),
    ("small", "size", ["little"]),
    ("large", "size", ["big"]),
    ("new", "state", []),
    ("old", "state", []),
)
NOW = "2002-01-01 00:00:00"


def skill_table(spark):
    return spark.createDataFrame([(i, c, a) for i, c, a in SKILLS], SKILL)


def spelled(c):
    """A word the way a careless writer puts it."""
    return F.concat(F.lit(" "), F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)), F.lit("-.\t"))


def raw_skills(spark, sf_dir):
    """Postings with skills in careless spelling and a blank among them."""
    p = postings(spark, sf_dir, company=False)
    messy = F.concat(F.transform("skills", lambda s: spelled(s)), F.array(F.lit("  ")))
    return p.select("id", messy.alias("raw_skills"))


def mentions(spark, sf_dir):
    return raw_skills(spark, sf_dir).select("id", F.explode("raw_skills").alias("raw"))


def _normalized(run):
    def query(spark, sf_dir):
        lookup = dimensions.lookup_terms(skill_table(spark))
        found = run(raw_skills(spark, sf_dir), lookup, "id", "raw_skills")
        return found.select("id", list_text(F.col("mapped")).alias("mapped"), list_text(F.col("unmapped")).alias("unmapped"))

    return query


def skills_normalized_joined(spark, sf_dir):
    """The same from mentions, grouped by the caller."""
    said = raw_skills(spark, sf_dir)
    found = taxonomy.resolve_mentions(mentions(spark, sf_dir), dimensions.lookup_terms(skill_table(spark)))
    lists = found.groupBy("id").agg(
        F.sort_array(F.collect_set("skill_id")).alias("mapped"),
        F.sort_array(F.collect_set(F.when(F.col("skill_id").isNull(), F.col("folded")))).alias("unmapped"),
    )
    return said.select("id").join(lists, "id", "left").select(
        "id", *[F.coalesce(list_text(F.col(c)), F.lit("")).alias(c) for c in ("mapped", "unmapped")]
    )


def skills_large_taxonomy(spark, sf_dir):
    """Parts sold, resolved against a taxonomy of all customers' and suppliers' names."""
    named = [
        table(spark, sf_dir, t).select(F.lower(n).alias("id"), F.lit(t).alias("category"), F.array(F.upper(n)).alias("aliases"))
        for t, n in (("customer", "c_name"), ("supplier", "s_name"))
    ]
    said = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.array(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("# - "))), F.col("c_mktsegment"), F.lit(" ")).alias("raw_skills"),
    )
    found = taxonomy.normalize_skills(said, dimensions.lookup_terms(named[0].unionByName(named[1])), "id")
    return found.select("id", list_text(F.col("mapped")).alias("mapped"), list_text(F.col("unmapped")).alias("unmapped"))


def mentions_resolved(spark, sf_dir):
    lookup = dimensions.lookup_terms(skill_table(spark))
    found = taxonomy.resolve_mentions(mentions(spark, sf_dir), lookup)
    return found.groupBy("folded", "skill_id").agg(F.count("*").alias("n"))


def taxonomy_coverage(spark, sf_dir):
    lookup = dimensions.lookup_terms(skill_table(spark))
    found = taxonomy.coverage(mentions(spark, sf_dir), lookup)
    return found.withColumn("coverage", F.round("coverage", 6))


def category_counts(spark, sf_dir):
    skills = skill_table(spark)
    return taxonomy.category_counts(mentions(spark, sf_dir), skills, dimensions.lookup_terms(skills))


def taxonomy_checks(spark, sf_dir):
    """Parts as a careless taxonomy: names as ids, words as aliases."""
    parts = table(spark, sf_dir, "part")
    rows = parts.select(
        F.when(F.col("p_size") > 45, F.initcap("p_name")).otherwise(F.col("p_name")).alias("id"),
        F.lower("p_type").alias("category"),
        F.array("p_brand").alias("aliases"),
    )
    return dimensions.taxonomy_violations(rows, ("small", "economy"))


def match_keys(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", match_key(F.concat_ws(" C#/.", "p_brand", "p_type")).alias("key"))


def _queue(spark, sf_dir):
    """A queue from part words: what earlier reviews have seen."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("raw"))
    counted = queues.count_spellings(words.select(F.concat("raw", F.lit("-.")).alias("raw")))
    status = F.when(F.col("skill") == "hot-.", "rejected").when(F.col("skill").startswith("r"), "mapped").otherwise("pending")
    start = F.lit("2001-01-01 00:00:00").cast("timestamp")
    return counted.where(F.col("skill") != "cold-.").select(
        "skill", "occurrences", start.alias("first_seen"), start.alias("last_seen"), status.alias("status")
    )


def _delta(spark, sf_dir):
    lookup = dimensions.lookup_terms(skill_table(spark))
    split = taxonomy.normalize_skills(raw_skills(spark, sf_dir), lookup, "id")
    return queues.count_spellings(split.select(F.explode("unmapped").alias("raw")))


def _merged(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    return queues.merge_counts(_queue(spark, sf_dir), _delta(spark, sf_dir), "skill", now)


def _times(df, *columns):
    for c in columns:
        df = df.withColumn(c, ts_text(F.col(c)))
    return df


def unmapped_queue(spark, sf_dir):
    return _times(_merged(spark, sf_dir), "first_seen", "last_seen")


def queue_new_keys(spark, sf_dir):
    return queues.new_keys(_queue(spark, sf_dir), _delta(spark, sf_dir), "skill")


def queue_pending(spark, sf_dir):
    return _times(queues.queue_view(_merged(spark, sf_dir), "pending", 100), "first_seen", "last_seen")


# --- companies ----------------------------------------------------------------


def _known(spark, sf_dir):
    """Customers of one segment are in the dimension already, under their full name."""
    customers = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    name = F.concat_ws(" ", F.translate("c_name", "#", " "), pick(NAME_ENDINGS, F.col("c_custkey") % 8))
    return customers.select(F.upper(name).alias("name"))


def company_suggestions(spark, sf_dir):
    return queues.mine_companies(discovery_listings(spark, sf_dir), _known(spark, sf_dir))


def _company_queue(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    empty = spark.createDataFrame(
        [], "company_key string, occurrences bigint, first_seen timestamp, last_seen timestamp,"
        " status string, company_name string",
    )
    return queues.merge_counts(empty, company_suggestions(spark, sf_dir), "company_key", now)


def _boards(spark, sf_dir):
    """Postings as listings of boards whose tokens follow the company name in two ways."""
    placed = discovery_listings(spark, sf_dir)
    words = F.split(F.regexp_replace(F.lower("company"), " (?:inc|ltd|corp)\\.?$", ""), " ")
    hyphened = F.array_join(words, "-")
    # the last nations' boards have tokens nobody would guess
    token = F.when(F.col("c_nationkey") < 12, F.array_join(words, "")).when(F.col("c_nationkey") < 20, hyphened)
    token = token.otherwise(F.concat(F.lit("office-"), hyphened))
    return placed.select(
        pick(fv.BOARDS, F.col("o_custkey") % 3).alias("source_type"), token.alias("source_name"), "location"
    )


def board_rank(spark, sf_dir):
    return queues.board_stats(_boards(spark, sf_dir))


def _probed(spark, sf_dir, queue=None):
    stats = queues.board_stats(_boards(spark, sf_dir))
    pending = _company_queue(spark, sf_dir) if queue is None else queue
    return queues.probe(pending, stats, F.lit(NOW).cast("timestamp"))


def board_probe(spark, sf_dir):
    found = _probed(spark, sf_dir)
    return found.select("company_key", "company_name", "board", "board_token", "board_jobs", "ca_jobs", "status", ts_text(F.col("probed_at")).alias("probed_at"))


def probe_summary(spark, sf_dir):
    return queues.probe_summary(_probed(spark, sf_dir))


def suggestion_blocks(spark, sf_dir):
    return queues.suggestions(_probed(spark, sf_dir))


def queue_reprobe(spark, sf_dir):
    queue = pinned(_company_queue(spark, sf_dir))
    merged = queues.merge_probe(queue, _probed(spark, sf_dir, queue))
    found = queues.reprobe(merged)
    return found.select("company_key", "status", F.col("probed_at").isNotNull().alias("probed"))


QUERIES = {
    "skills_normalized": _normalized(taxonomy.normalize_skills),
    "skills_normalized_joined": skills_normalized_joined,
    "skills_large_taxonomy": skills_large_taxonomy,
    "mentions_resolved": mentions_resolved,
    "taxonomy_coverage": taxonomy_coverage,
    "category_counts": category_counts,
    "taxonomy_checks": taxonomy_checks,
    "match_keys": match_keys,
    "unmapped_queue": unmapped_queue,
    "queue_new_keys": queue_new_keys,
    "queue_pending": queue_pending,
    "company_suggestions": company_suggestions,
    "board_rank": board_rank,
    "board_probe": board_probe,
    "probe_summary": probe_summary,
    "suggestion_blocks": suggestion_blocks,
    "queue_reprobe": queue_reprobe,
}

_SPELLINGS = ", ".join(
    f"('{word}', '{skill}', '{category}')" for skill, category, _ in SKILLS for word in (
        [skill, "gizmo"] if skill == "widget" else [skill]
    )
)
_S = f"""{P_CTE}, m AS (SELECT id, unnest(skills) AS word FROM p),
sp(word, skill_id, category) AS (VALUES {_SPELLINGS}),
r AS (SELECT id, m.word, m.word || '-.' AS folded, skill_id, category FROM m LEFT JOIN sp ON sp.word = m.word)"""
_NORMALIZED = f"""WITH {_S} SELECT p.id, coalesce(string_agg(DISTINCT skill_id, ',' ORDER BY skill_id), '') AS mapped,
    coalesce(string_agg(DISTINCT CASE WHEN skill_id IS NULL THEN folded END, ',' ORDER BY CASE WHEN skill_id IS NULL THEN folded END), '') AS unmapped
    FROM p LEFT JOIN r ON r.id = p.id GROUP BY p.id"""
_Q = f"""{_S}, q AS (SELECT word || '-.' AS skill, count(*) AS occurrences,
      CASE word WHEN 'hot' THEN 'rejected' WHEN 'red' THEN 'mapped' WHEN 'ring' THEN 'mapped' WHEN 'rod' THEN 'mapped'
        ELSE 'pending' END AS status
    FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> 'cold' GROUP BY word),
dl AS (SELECT folded AS skill, count(*) AS n FROM r WHERE skill_id IS NULL GROUP BY folded),
mq AS (SELECT coalesce(q.skill, dl.skill) AS skill, CAST(coalesce(occurrences, 0) + coalesce(n, 0) AS BIGINT) AS occurrences,
      CASE WHEN q.skill IS NULL THEN '{NOW}' ELSE '2001-01-01 00:00:00' END AS first_seen,
      CASE WHEN dl.skill IS NULL THEN '2001-01-01 00:00:00' ELSE '{NOW}' END AS last_seen,
      coalesce(status, 'pending') AS status
    FROM q FULL JOIN dl ON dl.skill = q.skill)"""
_BLOCKED = "regexp_matches(lower(company), 'recruit|staffing|talent|agency|consulting group')"
_C = f"""{DISCOVERY_CTE},
cq AS (SELECT d.c_custkey, lower(company) AS company_key, company AS company_name, count(*) AS occurrences
       FROM d JOIN customer c ON c.c_custkey = d.c_custkey
       WHERE NOT {_BLOCKED} AND c_mktsegment <> 'BUILDING' GROUP BY ALL)"""
_B = f"""{_C}, {sql_places_cte('d')},
b AS (SELECT (['greenhouse', 'lever', 'ashby'])[d.c_custkey % 3 + 1] AS board, d.c_custkey,
        c_nationkey < 20 AS guessed, CASE WHEN c_nationkey < 20 THEN '' ELSE 'office-' END ||
        replace(regexp_replace(lower(company), ' (inc|ltd|corp)\\.?$', ''), ' ', CASE WHEN c_nationkey < 12 THEN '' ELSE '-' END) AS token,
        count(*) AS board_jobs, count(*) FILTER (WHERE coalesce(canadian, true)) AS ca_jobs
      FROM d JOIN customer c ON c.c_custkey = d.c_custkey
      LEFT JOIN places ON places.location IS NOT DISTINCT FROM d.location
      GROUP BY ALL),
pr AS (SELECT company_key, company_name, occurrences, board, token AS board_token, board_jobs, ca_jobs,
        CASE WHEN board IS NULL THEN 'no_board' WHEN ca_jobs > 0 THEN 'board_found' ELSE 'no_ca_roles' END AS status
       FROM cq LEFT JOIN b ON b.c_custkey = cq.c_custkey AND guessed)"""

ORACLES = {
    "skills_normalized": _NORMALIZED,
    "skills_normalized_joined": _NORMALIZED,
    "skills_large_taxonomy": "SELECT c_custkey AS id, lower(c_name) AS mapped, lower(c_mktsegment) AS unmapped FROM customer",
    "mentions_resolved": f"WITH {_S} SELECT folded, skill_id, count(*) AS n FROM r GROUP BY 1, 2",
    "taxonomy_coverage": f"""WITH {_S} SELECT count(*) AS mentions, count(skill_id) AS resolved,
        round(count(skill_id) / count(*), 6) AS coverage FROM r""",
    "category_counts": f"WITH {_S} SELECT category, count(*) AS n FROM r WHERE category IS NOT NULL GROUP BY 1",
    "taxonomy_checks": """WITH t AS (SELECT CASE WHEN p_size > 45 THEN array_to_string(list_transform(string_split(p_name, ' '),
            lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS id, lower(p_type) AS category, p_brand AS alias FROM part),
        k AS (SELECT DISTINCT regexp_replace(lower(x), '[^a-z0-9+#]+', '', 'g') AS key, id
              FROM (SELECT id, id AS x FROM t UNION ALL SELECT id, alias FROM t))
        SELECT 'duplicate id' AS rule, id AS key, count(*) AS n FROM t GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'id not lower case', id, count(*) FROM t WHERE id <> lower(id) GROUP BY id
        UNION ALL SELECT 'spelling owned twice', key, count(*) FROM k GROUP BY key HAVING count(*) > 1
        UNION ALL SELECT 'unknown category', id, count(*) FROM t WHERE category NOT IN ('small', 'economy') GROUP BY id""",
    "match_keys": "SELECT p_partkey, regexp_replace(lower(p_brand || ' C#/.' || p_type), '[^a-z0-9+#]+', '', 'g') AS key FROM part",
    "unmapped_queue": f"WITH {_Q} SELECT * FROM mq",
    "queue_new_keys": f"WITH {_Q} SELECT count(*) AS new_keys FROM dl WHERE skill NOT IN (SELECT skill FROM q)",
    "queue_pending": f"WITH {_Q} SELECT * FROM mq WHERE status = 'pending' ORDER BY occurrences DESC, skill LIMIT 100",
    "company_suggestions": f"WITH {_C} SELECT company_key, company_name, occurrences FROM cq",
    "board_rank": f"WITH {_B} SELECT board, token, board_jobs, ca_jobs FROM b",
    "board_probe": f"""WITH {_B} SELECT company_key, company_name, board, board_token, board_jobs, ca_jobs, status,
        '{NOW}' AS probed_at FROM pr""",
    "probe_summary": f"""WITH {_B} SELECT count(*) AS probed, count(*) FILTER (WHERE status = 'board_found') AS board_found,
        count(*) FILTER (WHERE status = 'no_ca_roles') AS no_ca_roles, count(*) FILTER (WHERE status = 'no_board') AS no_board FROM pr""",
    "suggestion_blocks": f"""WITH {_B} SELECT company_key, company_name, board, board_token, occurrences AS mentions, board_jobs,
        ca_jobs, round(ca_jobs / board_jobs, 4) AS ca_share FROM pr WHERE status = 'board_found'""",
    "queue_reprobe": f"""WITH {_B} SELECT company_key, CASE WHEN status = 'board_found' THEN 'pending' ELSE status END AS status,
        status <> 'board_found' AS probed FROM pr""",
}
