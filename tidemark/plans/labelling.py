"""Evaluation, labelling and data-quality queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.terms import extract_terms
from tidemark.operators import evaluate, quality
from tidemark.plans.bindings import P_CTE, list_text, postings, table

# The extractor under test knows these words; gold has more.
KNOWN = ("red", "blue", "ring", "bolt", "gear", "small", "large", "new", "care")
SEED = 42


def _known_terms(text):
    return extract_terms(text, KNOWN)


def gold(spark, sf_dir):
    """Skills as gold labels; long lists were verified by a person."""
    p = postings(spark, sf_dir)
    return p.select(
        F.col("id").cast("string").alias("listing_id"),
        F.col("id").alias("position"),
        "title",
        "company",
        "raw_description",
        "skills",
        (F.size("skills") > 6).alias("human_verified"),
    )


def _scores(spark, sf_dir):
    return evaluate.score(evaluate.predict(gold(spark, sf_dir), _known_terms))


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def eval_rows(spark, sf_dir):
    """Predictions arrive as a table of their own."""
    texts = postings(spark, sf_dir, company=False)
    said = texts.select(
        F.col("id").cast("string").alias("listing_id"), _known_terms(F.col("raw_description")).alias("predicted")
    )
    rows = evaluate.score(evaluate.pair(said, gold(spark, sf_dir))).select(
        "listing_id", "precision", "recall", "f1", "tp",
        list_text(F.col("false_positives")).alias("false_positives"),
        list_text(F.col("false_negatives")).alias("false_negatives"),
    )
    return _rounded(rows, "precision", "recall", "f1")


def eval_summary(spark, sf_dir):
    found = evaluate.summary(_scores(spark, sf_dir))
    return _rounded(
        found, *[f"{k}_{m}" for k in ("micro", "macro") for m in ("precision", "recall", "f1")], "verified_share"
    )


def eval_worst(spark, sf_dir):
    return _rounded(evaluate.worst(_scores(spark, sf_dir)).select("listing_id", "company", "title", "f1"), "f1")


def eval_report(spark, sf_dir):
    rows = evaluate.report_rows(_scores(spark, sf_dir))
    lists = {c: list_text(F.col(c)) for c in ("wrong", "missed")}
    return _rounded(rows.withColumns(lists), "precision", "recall", "f1", "share_verified")


def label_summary(spark, sf_dir):
    """Labels as verification marks of the documents they cover, per language."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    per_lang = labels.join(docs, "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_verified")
    )
    return per_lang.withColumn("share", F.round(F.col("n_verified") / F.col("n"), 6))


def _drafts(spark, sf_dir):
    """Annotator labels beside extractor labels; the annotator lists what the extractor knows too,
    and for long postings everything."""
    everything = postings(spark, sf_dir)
    seen = F.filter("skills", lambda s: s.isin(*KNOWN))
    annotated = everything.select(
        F.col("id").cast("string").alias("listing_id"), "title", "company", "raw_description",
        F.lit("prod_db").alias("source"), F.lit("annotator").alias("annotator_model"),
        F.when(F.size("skills") > 7, F.col("skills")).otherwise(F.concat(seen, F.array(F.lit("care")))).alias("annotator_skills"),
    )
    return evaluate.draft_labels(annotated, _known_terms)


def draft_labels(spark, sf_dir):
    return _drafts(spark, sf_dir).select(
        "listing_id", list_text(F.col("annotator_skills")).alias("annotator_skills"),
        list_text(F.col("baseline_skills")).alias("baseline_skills"), "disagreement",
    )


def review_routing(spark, sf_dir):
    routed = evaluate.route_review(_drafts(spark, sf_dir), SEED)
    return routed.select("listing_id", "disagreement", "verification_method", "human_verified")


def review_routing_capped(spark, sf_dir):
    routed = evaluate.route_review(_drafts(spark, sf_dir), SEED, cap=100)
    return routed.select("listing_id", "disagreement", "verification_method", "human_verified")


def gold_rows(spark, sf_dir):
    """Decisions follow the title: urgent ones take the baseline, low ones are skipped."""
    drafts = _drafts(spark, sf_dir)
    decision = (
        F.when(F.col("title") == "1-URGENT", "baseline").when(F.col("title") == "5-LOW", "skip")
        .when(F.col("title") == "2-HIGH", "custom").otherwise("accept")
    )
    decisions = drafts.select(
        "listing_id", decision.alias("decision"), F.array(F.lit(" Forge "), F.lit("")).alias("custom_skills")
    )
    done = evaluate.gold_rows(evaluate.route_review(drafts, SEED), decisions)
    return done.select(
        "listing_id", list_text(F.col("skills")).alias("skills"), "human_verified", "verification_method",
        "disagreement_with_baseline", F.length("notes").alias("note_chars"),
    )


def unreviewed(spark, sf_dir):
    """Documents without a label yet."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("listing_id"), "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("listing_id"))
    return evaluate.unreviewed(docs, labels)


def line_duplicates(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def customer_orphans(spark, sf_dir):
    """Companies that have postings, but are not in the company dimension: those of one market segment were taken out of it."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return quality.orphans(table(spark, sf_dir, "orders"), known, "o_custkey", "c_custkey")


def posting_nulls(spark, sf_dir):
    return quality.null_counts(
        postings(spark, sf_dir), ["id", "title", "company", "location", "skills", "source_url"]
    )


QUERIES = {
    "eval_rows": eval_rows,
    "eval_summary": eval_summary,
    "eval_worst": eval_worst,
    "eval_report": eval_report,
    "label_summary": label_summary,
    "draft_labels": draft_labels,
    "review_routing": review_routing,
    "review_routing_capped": review_routing_capped,
    "gold_rows": gold_rows,
    "unreviewed": unreviewed,
    "line_duplicates": line_duplicates,
    "customer_orphans": customer_orphans,
    "posting_nulls": posting_nulls,
}

_KNOWN = "[" + ", ".join(f"'{k}'" for k in KNOWN) + "]"
_EV = f"""{P_CTE},
ev AS (SELECT *, list_sort(list_append(list_filter(skills, lambda s: list_contains({_KNOWN}, s)), 'care')) AS said FROM p),
sc AS (SELECT *, len(list_intersect(said, skills)) AS tp, len(said) AS np, len(skills) AS ng FROM ev),
pr AS (SELECT *, tp / np AS precision, CASE WHEN ng > 0 THEN tp / ng ELSE 0.0 END AS recall FROM sc),
fs AS (SELECT *, CASE WHEN tp > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  list_filter(said, lambda s: NOT list_contains(skills, s)) AS fp,
  list_filter(skills, lambda s: NOT list_contains(said, s)) AS fn FROM pr)"""
_DR = f"""{P_CTE},
dr AS (SELECT CAST(id AS VARCHAR) AS listing_id, title,
   list_sort(list_append(list_filter(skills, lambda s: list_contains({_KNOWN}, s)), 'care')) AS baseline,
   CASE WHEN len(skills) > 7 THEN skills
        ELSE list_append(list_filter(skills, lambda s: list_contains({_KNOWN}, s)), 'care') END AS annotator FROM p),
dd AS (SELECT *, list_sort(annotator) <> baseline AS disagreement, md5('{SEED}|' || listing_id) AS k FROM dr),
rk AS (SELECT *, row_number() OVER (PARTITION BY disagreement ORDER BY k, listing_id) AS r FROM dd),
n AS (SELECT count(*) FILTER (WHERE disagreement) AS nd, CAST(round_even(0.25 * count(*) FILTER (WHERE NOT disagreement), 0) AS BIGINT) AS na FROM dd),
rt AS (SELECT rk.*, disagreement OR r <= (SELECT na FROM n) AS q,
       CASE WHEN disagreement THEN r ELSE r + (SELECT nd FROM n) END AS place FROM rk)"""
_METHOD = """CASE WHEN {q} THEN 'manual_review' WHEN disagreement THEN 'auto_accept_unreviewed_disagreement'
    ELSE 'auto_accept_agreement' END"""

ORACLES = {
    "eval_rows": f"""WITH {_EV} SELECT CAST(id AS VARCHAR) AS listing_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1, CAST(tp AS INTEGER) AS tp, coalesce(array_to_string(fp, ','), '') AS false_positives,
        coalesce(array_to_string(fn, ','), '') AS false_negatives FROM fs""",
    "eval_summary": f"""WITH {_EV}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE ng > 6) AS n_human_verified,
          CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(ng - tp) AS BIGINT) AS fn,
          avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf FROM fs),
        u AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM t)
        SELECT n, n_human_verified, tp, fp, fn, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1,
          round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round(2 * p * r / (p + r), 6) AS micro_f1,
          round(n_human_verified / n, 6) AS verified_share FROM u""",
    "eval_worst": f"""WITH {_EV} SELECT CAST(id AS VARCHAR) AS listing_id, company, title, round(fs.f1, 6) AS f1
        FROM fs ORDER BY fs.f1, id LIMIT 15""",
    "eval_report": f"""WITH {_EV}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE ng > 6) / count(*) AS v,
          sum(tp) / sum(np) AS p, sum(tp) / sum(ng) AS r, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf FROM fs),
        ww AS (SELECT *, row_number() OVER (ORDER BY f1, id) AS place FROM fs)
        SELECT 'micro' AS part, 0 AS place, n || ' listings' AS subject, round(p, 6) AS precision, round(r, 6) AS recall,
          round(2 * p * r / (p + r), 6) AS f1, round(v, 6) AS share_verified, NULL AS wrong, NULL AS missed FROM t
        UNION ALL SELECT 'macro', 0, n || ' listings', round(mp, 6), round(mr, 6), round(mf, 6), round(v, 6), NULL, NULL FROM t
        UNION ALL SELECT 'poorest', place, company || ': ' || title, round(precision, 6), round(recall, 6), round(f1, 6), NULL,
          coalesce(array_to_string(fp, ','), ''), coalesce(array_to_string(fn, ','), '') FROM ww WHERE place <= 15""",
    "label_summary": """SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_verified,
        round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS share
        FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY lang""",
    "draft_labels": f"""WITH {_DR} SELECT listing_id, array_to_string(annotator, ',') AS annotator_skills,
        array_to_string(baseline, ',') AS baseline_skills, disagreement FROM dd""",
    "review_routing": f"""WITH {_DR} SELECT listing_id, disagreement, {_METHOD.format(q='q')} AS verification_method,
        q AS human_verified FROM rt""",
    "review_routing_capped": f"""WITH {_DR} SELECT listing_id, disagreement, {_METHOD.format(q='(q AND place <= 100)')} AS verification_method,
        q AND place <= 100 AS human_verified FROM rt""",
    "gold_rows": f"""WITH {_DR} SELECT listing_id, array_to_string(CASE WHEN q AND title = '1-URGENT' THEN baseline
          WHEN q AND title = '2-HIGH' THEN ['forge'] ELSE annotator END, ',') AS skills, q AS human_verified,
        {_METHOD.format(q='q')} AS verification_method, disagreement AS disagreement_with_baseline, 0 AS note_chars
        FROM rt WHERE NOT (q AND title = '5-LOW')""",
    "unreviewed": "SELECT doc_id AS listing_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "line_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "customer_orphans": """SELECT o_custkey, count(*) AS n FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') GROUP BY 1""",
    "posting_nulls": f"""WITH {P_CTE} SELECT 'id' AS column_name, 0 AS nulls UNION ALL SELECT 'title', 0 UNION ALL SELECT 'company', 0
        UNION ALL SELECT 'location', (SELECT count(*) FROM p WHERE location IS NULL)
        UNION ALL SELECT 'skills', 0 UNION ALL SELECT 'source_url', 0""",
}
