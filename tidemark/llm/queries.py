"""Registered queries of the corpus operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chosen_path,
    collocations,
    conversation_repair,
    decontamination,
    license_scan,
    line_dedup,
    near_dups,
    packing,
    quality_rules,
    secret_scan,
    token_counts,
    toxicity,
    url_reputation,
)
from tidemark.llm.common import table
from tidemark.llm.repair_sql import OP11_SQL


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "n_restored")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it holds."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "item_words")


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", near_dups.hex_print("print").alias("fingerprint"), "component_id", "n_links")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, with those kept that the forest takes for secrets; it learns from two thirds of the documents."""
    found = secret_scan.labelled_by_format(secret_scan.findings(table(spark, sf_dir, "documents")))
    model = secret_scan.train(found.where(~toxicity.held_out(F.col("doc_id"))))
    return secret_scan.judged(found, model).drop("text_hash")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
        FROM (SELECT doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS ws FROM docs)) WHERE w <> ''
), sizes AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS g,
         lead(i, 4) OVER p AS last
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE last IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS k FROM counted WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, line, lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS bare
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs)
), full_lines AS (
  SELECT doc_id, host, line, substr(md5(bare), 1, 16) AS h, length(bare) AS n FROM lines WHERE bare <> ''
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(n) AS line_chars FROM full_lines GROUP BY doc_id
), distinct_lines AS (
  SELECT DISTINCT doc_id, host, h FROM full_lines
), contexts AS (
  SELECT doc_id, md5(string_agg(h, ',' ORDER BY h)) AS context FROM distinct_lines GROUP BY doc_id
), frequent AS (
  SELECT host, h FROM distinct_lines JOIN contexts USING (doc_id) GROUP BY host, h HAVING count(DISTINCT context) >= {docs}
), lost AS (
  SELECT doc_id, sum(n) AS removed_chars FROM full_lines SEMI JOIN frequent USING (host, h) GROUP BY doc_id
), found AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_chars, 0) > {depleted} * coalesce(line_chars, 0) AS depleted
  FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN dups USING (doc_id)
  LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT depleted AS kept
FROM found
""".format(docs=quality_rules.LINE_DOCS, depleted=quality_rules.DEPLETED_SHARE)

BYTE_BPE = (
    public_tokenizers.path("byte_bpe_50k.json"),
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


#: (verdict, host, path)
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, bad of the pages whose document is labelled: a page's path ends in its document's number.

    A page is bad if any label calls its document toxic or of low quality.
    """
    labels = table(spark, sf_dir, "labels").where("doc_id is not null")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labelled = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(bad).alias("bad"))
    url = F.col("url")
    number = F.regexp_extract(url_reputation.path_of(url), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    pages = table(spark, sf_dir, "pages").select(
        url_reputation.host_of(url).alias("host"), F.when(number != "", number).cast("bigint").alias("number")
    )
    return pages.join(labelled, F.col("number") == F.col("labelled")).select("host", "bad")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_reputation.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 4).alias("bad_rate"))


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, url, strpos(url, '://') AS k FROM pages
), split AS (
  SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM cut
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(says, of, start)
), fits AS (
  SELECT page_id, max_by(of || start, length(of || start)) AS rule, max_by(says, length(of || start)) AS says
  FROM parsed JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY page_id
), labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), seen AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
         count(*) AS n, sum(bad) AS bad
  FROM parsed JOIN labelled ON try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(\.html)?/?$', 1), '') AS BIGINT) = doc_id
  GROUP BY host
), overall AS (
  SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2) AS rate FROM seen
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS c FROM seen, overall GROUP BY suffix
), m0 AS (
  SELECT (1 - share) / share AS m FROM (SELECT least(0.9, greatest(0.001, coalesce(
    (sum(n * (bad / n - c) ** 2) - sum(c * (1 - c))) / nullif(sum((n - 1) * c * (1 - c)), 0), 0.001)))::DOUBLE AS share FROM s0)
), r0 AS (SELECT suffix, (bad + m * c) / (n + m) AS rate FROM s0, m0),
s1 AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS c FROM seen JOIN r0 USING (suffix) GROUP BY domain, suffix
), m1 AS (
  SELECT (1 - share) / share AS m FROM (SELECT least(0.9, greatest(0.001, coalesce(
    (sum(n * (bad / n - c) ** 2) - sum(c * (1 - c))) / nullif(sum((n - 1) * c * (1 - c)), 0), 0.001)))::DOUBLE AS share FROM s1)
), r1 AS (SELECT domain, (bad + m * c) / (n + m) AS rate FROM s1, m1),
s2 AS (SELECT host, n, bad, rate AS c FROM seen JOIN r1 USING (domain)),
m2 AS (
  SELECT (1 - share) / share AS m FROM (SELECT least(0.9, greatest(0.001, coalesce(
    (sum(n * (bad / n - c) ** 2) - sum(c * (1 - c))) / nullif(sum((n - 1) * c * (1 - c)), 0), 0.001)))::DOUBLE AS share FROM s2)
), hosts AS (
  SELECT h.host, coalesce(s.n, 0) AS n, coalesce(s.bad, 0) AS bad, coalesce(r1.rate, r0.rate, overall.rate) AS c
  FROM (SELECT DISTINCT host FROM parsed) h CROSS JOIN overall LEFT JOIN seen s USING (host)
  LEFT JOIN r0 ON r0.suffix = string_split(h.host, '.')[-1]
  LEFT JOIN r1 ON r1.domain = array_to_string(string_split(h.host, '.')[-2:], '.')
), posterior AS (
  SELECT host, (bad + m * c) / (n + m) AS rate, n + m AS weight FROM hosts, m2
)
SELECT page_id, p.host, path, rule,
       coalesce(says, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 4) AS bad_rate
FROM parsed p JOIN posterior q ON p.host = q.host LEFT JOIN fits USING (page_id)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    docs = docs.withColumn("n_lines", (feeds + 1).cast("bigint"))
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), dropped="n_dropped")
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id
"""

def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT d, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS p
  FROM (SELECT d, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS ps FROM docs)
), split AS (
  SELECT d, lang, p, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT d, lang, p, regexp_split_to_array(piece, '[\x20\x09]+') AS ws FROM pieces)
), followed AS (
  SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM split WHERE w <> '' WINDOW o AS (PARTITION BY d, p ORDER BY i)
), occurring AS (
  SELECT lang, w AS phrase, 1 AS size FROM followed
  UNION ALL SELECT lang, w || ' ' || w2, 2 FROM followed WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3 FROM followed WHERE w3 IS NOT NULL
), counted AS (
  SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM occurring GROUP BY ALL
), candidates AS (
  SELECT lang, size, phrase, f, string_split(phrase, ' ') AS ws FROM counted WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, size, f, unnest(range(1, size)) AS k, ws FROM candidates
), measured AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, k, (1000000::HUGEINT * c.f * c.f) // (x.f * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(ws[:k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
), lowest AS (
  SELECT * FROM measured QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, f FROM candidates WHERE size = 3
  UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), f FROM candidates WHERE size = 3
), covered AS (
  SELECT DISTINCT i.lang, i.phrase FROM inside i JOIN counted c ON c.lang = i.lang AND c.phrase = i.phrase WHERE 100 * i.f >= 50 * c.f
), totals AS (
  SELECT lang, sum(f) AS n FROM counted WHERE size = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest JOIN totals USING (lang) ANTI JOIN covered USING (lang, phrase)
QUALIFY rank <= 2000
"""

def op13_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


OP13_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[\x20\x09-\x0D]+') AS ws FROM documents)
), followed AS (
  SELECT doc_id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, row_number() OVER o AS place, count(*) OVER (PARTITION BY doc_id) AS n
  FROM split WHERE w <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
  SELECT DISTINCT doc_id, concat_ws(' ', w, w2, w3) AS s FROM followed WHERE w3 IS NOT NULL OR (n < 3 AND place = 1)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, b FROM reached JOIN ways ON other = a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_near_dups": op4_near_dups,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_url_filters": op9_url_filters,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_minhash_near_dups": op13_minhash_near_dups,
}

ORACLES: dict[str, str] = {
    "op7_quality_rules": OP7_SQL,
    "op9_url_filters": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_minhash_near_dups": OP13_SQL,
}
