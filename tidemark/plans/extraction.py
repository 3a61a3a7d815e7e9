"""Extraction queries: postings with landed model responses, with their SQL twins.

The response of a posting depends on its company's nation, one fault per nation,
so that every rule of the contract meets data.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions.money import cad_annual_estimate
from tidemark.operators import candidates, components, ledger, quality, queues, taxonomy
from tidemark.plans.bindings import (
    P_CTE,
    E_CTE,
    clock,
    ledger as event_ledger,
    list_text,
    money_text,
    pick,
    postings,
    sql_pick,
    table,
    ts_text,
)
from tidemark.plans.skills import SKILLS, skill_table
from tidemark.session import pinned
from tidemark.sources import dimensions

VERSION = "v2"
MODEL = "hosted-model"

# Fault of each nation, '' for a sound response.
FAULTS = (
    "amount without currency", "minimum above maximum", "visa flag without evidence",
    "years without evidence", "years out of range", "confidence out of range",
    "unknown seniority", "unknown key", "company_canonical missing", "skills is null",
    "unreadable", "", "", "visa flag without evidence", "unknown key",
    "", "", "", "", "", "", "", "", "", "",
)
PAY = (
    '"min_amount": 50, "max_amount": 60.5', '"min_amount": 9, "max_amount": 8, "currency": "CAD", "period": "hour"',
    *['"min_amount": 60000.5, "max_amount": 71234.75, "currency": "cad", "period": "year"'] * 9,
    '"min_amount": 41.25, "currency": "USD", "period": "hour", "is_estimated": true',
    '"max_amount": 8000, "currency": "EUR", "period": "month"',
    *['"min_amount": 1000, "max_amount": 2000, "currency": "JPY", "period": "month"'] * 2,
    *['"currency": null'] * 10,
)
VISA = (
    "", "", '"sponsorship_available": false', *[""] * 8,
    '"sponsorship_available": true, "evidence": ["we sponsor", " "]', "",
    '"citizenship_or_pr_required": true, "evidence": ["  "]',
    '"surprise": 1',
    '"requires_existing_authorization": false, "evidence": ["no permit needed"]', *[""] * 9,
)
GATES = (
    "", "", "", '"min_years_experience": 5', '"min_years_experience": 41, "evidence": ["41 years"]',
    *[""] * 7, '"min_years_experience": 0, "evidence": ["", "0-2 years"]',
    *[""] * 3, '"min_years_experience": 7, "degree_required": false, "evidence": ["7+ years"]', *[""] * 8,
)
EXTRA = (
    *[""] * 5, ', "extraction_confidence": 1.5', ', "seniority": "boss"', ', "salary": 3', "",
    ', "skills": null', "", *[""] * 9, ', "posted_at": "2001-02-03", "country": "ca"',
    ', "seniority": "lead", "remote_policy": "remote", "language": "fr", "extraction_confidence": 0.25',
    *[""] * 3,
)


def _object(name: str, inner):
    return F.concat(F.lit(f', "{name}": {{'), inner, F.lit("}"))


def response(nation, with_skills=True):
    """The raw response text of a posting."""
    canonical = F.when(nation == 8, F.lit("")).otherwise(
        F.concat(F.lit(', "company_canonical": "'), F.lower("company"), F.lit('"'))
    )
    quoted = F.array_join(F.transform("skills", lambda s: F.concat(F.lit('"'), F.upper(s), F.lit('"'))), ", ")
    skills = F.when(nation == 9, F.lit("")).otherwise(
        F.concat(F.lit(', "skills": ['), quoted, F.lit('], "skills_unmapped": ["Gizmo", " Forklift "]'))
    )
    body = F.concat(
        F.lit('{"title_raw": "'), "title", F.lit('", "title_normalized": "'), F.lower("title"),
        F.lit('", "company_raw": "'), "company", F.lit('"'), canonical, skills,
        _object("compensation", pick(PAY, nation)), _object("visa", pick(VISA, nation)),
        _object("eligibility", pick(GATES, nation)), pick(EXTRA, nation),
    )
    return F.when(nation == 10, body).otherwise(F.concat(body, F.lit("}")))


def raw_listings(spark, sf_dir, skills=True):
    """Postings as raw listings; companies in debt post without a date."""
    p = postings(spark, sf_dir, skills=skills)
    return p.withColumn("posted_at", F.when(F.col("balance") >= 0, F.col("date_scraped")))


RAW_CTE = f"""{P_CTE}, raw AS (SELECT p.*, CASE WHEN balance >= 0 THEN date_scraped END AS posted_at FROM p)"""


def _responses(spark, sf_dir):
    return raw_listings(spark, sf_dir).select(
        F.col("id").alias("listing_id"), response(F.col("nation")).alias("response")
    )


def responses_judged(spark, sf_dir):
    judged = components.judge_responses(_responses(spark, sf_dir))
    return judged.select("listing_id", list_text(F.col("problems")).alias("problems"))


def responses_split(spark, sf_dir):
    accepted, rejected = components.validate(_responses(spark, sf_dir))
    reasons = rejected.groupBy(list_text(F.col("problems")).alias("reason")).agg(F.count("*").alias("n"))
    return reasons.unionByName(accepted.agg(F.count("*").alias("n")).withColumn("reason", F.lit("accepted")))


def _accepted(spark, sf_dir):
    return components.validate(_responses(spark, sf_dir))[0]


def _component_rows(spark, sf_dir):
    lookup = dimensions.lookup_terms(skill_table(spark))
    return components.flatten(
        _accepted(spark, sf_dir), raw_listings(spark, sf_dir, skills=False), lookup, VERSION, MODEL
    )


def components_flat(spark, sf_dir):
    rows = _component_rows(spark, sf_dir)
    return rows.select(
        "raw_listing_id", "prompt_version", "title_raw", "title_normalized", "seniority",
        "company_canonical", list_text(F.col("skills")).alias("skills"),
        list_text(F.col("skills_unmapped")).alias("skills_unmapped"),
        money_text(F.col("comp_min")).alias("comp_min"), money_text(F.col("comp_max")).alias("comp_max"),
        "comp_currency", "comp_period", "comp_is_estimated",
        money_text(F.col("comp_cad_annual_est")).alias("comp_cad_annual_est"),
        "location_raw", "country", "remote_policy", "visa_sponsorship_available",
        "visa_requires_existing_authorization", "min_years_experience", "degree_required",
        list_text(F.col("eligibility_evidence")).alias("eligibility_evidence"),
        list_text(F.col("visa_evidence")).alias("visa_evidence"),
        ts_text(F.col("posted_at")).alias("posted_at"), "language",
        F.col("extraction_confidence").cast("double").alias("extraction_confidence"),
    )


def visa_known(spark, sf_dir):
    return components.with_visa_signal(_component_rows(spark, sf_dir)).select("raw_listing_id")


def _attempts(spark, sf_dir):
    """Two attempts per listing.  The second one mends the first five faults; the malformed
    answers are transport errors, and one nation's model refuses at once."""
    rows = raw_listings(spark, sf_dir).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    nation, second = F.col("nation"), F.col("attempt") == 2
    mended = F.when(second & (nation < 5), F.lit(17)).otherwise(nation)
    refused = (nation == 16) & ~second
    transport = (nation == 10)
    return rows.select(
        F.col("id").alias("listing_id"),
        "attempt",
        F.when(refused, "refusal").otherwise("end_turn").alias("stop_reason"),
        F.when(transport, F.concat(F.lit("timeout "), F.col("attempt").cast("string"))).alias("transport_error"),
        F.when(~refused & ~transport, response(mended)).alias("response"),
    )


def _answer(*left_out: str, **fields) -> str:
    """A sound answer with fields replaced and left out; @ stands for a part's name."""
    sound = {
        "title_raw": "@", "title_normalized": "@", "company_raw": "Acme", "company_canonical": "acme", "skills": ["red"],
        "compensation": {"min_amount": 10, "max_amount": 20.5, "currency": "CAD", "period": "hour"},
        "eligibility": {"min_years_experience": 2, "evidence": ["two years"]},
        "visa": {"sponsorship_available": False, "evidence": ["no sponsorship"]},
    }
    return json.dumps({k: v for k, v in (sound | fields).items() if k not in left_out})


#: (the rules an answer breaks, the answer): every rule of the contract by itself, several at once, and none
RULE_CASES = (
    ("", _answer()),
    ("unknown key", _answer(salary=3)),
    ("unknown key", _answer(visa={"surprise": 1})),
    ("unknown key", _answer(eligibility={"age": 30})),
    *[(f"{name} missing", _answer(name)) for name in components.REQUIRED],
    ("title_raw missing", _answer(title_raw=None)),
    *[(f"{name} is null", _answer(**{name: None})) for name in components.NEVER_NULL],
    ("unknown seniority", _answer(seniority="boss")),
    ("unknown remote policy", _answer(remote_policy="sometimes")),
    ("unknown pay period", _answer(compensation={"min_amount": 1, "currency": "CAD", "period": "fortnight"})),
    ("amount without currency", _answer(compensation={"max_amount": 1, "currency": "", "period": "year"})),
    ("minimum above maximum", _answer(compensation={"min_amount": 2, "max_amount": 1, "currency": "EUR"})),
    ("visa flag without evidence", _answer(visa={"citizenship_or_pr_required": False, "evidence": [" "]})),
    ("years without evidence", _answer(eligibility={"min_years_experience": 0})),
    ("years out of range", _answer(eligibility={"min_years_experience": -1, "evidence": ["minus one"]})),
    ("years out of range", _answer(eligibility={"min_years_experience": 41, "evidence": ["41"]})),
    ("years not whole", _answer(eligibility={"min_years_experience": 2.5, "evidence": ["two and a half"]})),
    ("confidence out of range", _answer(extraction_confidence=-0.1)),
    ("unreadable", _answer()[:-1]),
    ("unreadable", _answer(skills="red")),
    ("unreadable", "[1, 2]"),
    ("unknown key,company_raw missing,skills is null,unknown seniority,years out of range",
     _answer("company_raw", salary=3, skills=None, seniority="boss", eligibility={"min_years_experience": 99, "evidence": ["99"]})),
    ("", _answer("skills", "visa", "eligibility", "compensation", extraction_confidence=1, seniority="senior", remote_policy="hybrid")),
    ("", _answer(eligibility={"min_years_experience": 40, "evidence": ["", "forty"]}, extraction_confidence=0)),
)


def responses_all_rules(spark, sf_dir):
    """An answer for every part, so that each of the contract's rules meets data by itself."""
    parts = table(spark, sf_dir, "part")
    answer = F.replace(pick([a for _, a in RULE_CASES], F.col("p_partkey") % len(RULE_CASES)), F.lit("@"), F.col("p_name"))
    rows = parts.select(F.col("p_partkey").alias("listing_id"), answer.alias("response"))
    judged = components.judge_responses(rows)
    title = F.col("components.title_raw")
    return judged.select("listing_id", list_text(F.col("problems")).alias("problems"), title.alias("title"))


SOUND, UNSOUND = 17, 0


def attempts_of_three(spark, sf_dir):
    """Outcomes of three attempts: mended by the third, by the second, refused at last, never sound, and lost to errors of
    5,000 characters and more, which are kept whole."""
    rows = raw_listings(spark, sf_dir).withColumn("attempt", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])))
    kind, attempt = F.col("id") % 5, F.col("attempt")
    lost = (kind == 1) | ((kind == 0) & (attempt == 2))
    refused = (kind == 2) & (attempt == 3)
    sound = ((kind == 0) & (attempt == 3)) | ((kind == 3) & (attempt >= 2))
    long_error = F.concat(F.lit("timeout "), F.repeat(F.lit("x"), F.col("id").cast("int") % 100 + 5000), attempt.cast("string"))
    answers = rows.select(
        F.col("id").alias("listing_id"),
        "attempt",
        F.when(refused, "refusal").otherwise("end_turn").alias("stop_reason"),
        F.when(lost, long_error).alias("transport_error"),
        F.when(~lost & ~refused, response(F.when(sound, F.lit(SOUND)).otherwise(F.lit(UNSOUND)))).alias("response"),
    )
    found = components.resolve_attempts(answers)
    return found.select(
        "listing_id", "outcome", "attempts", F.length("error").cast("bigint").alias("error_length"), F.md5("error").alias("error_digest"),
        F.col("components").isNotNull().alias("has_components"), F.col("raw_response").isNotNull().alias("has_raw"),
    )


def component_orphans(spark, sf_dir):
    """Components whose listing is gone: the listings of companies in debt were deleted."""
    raw = raw_listings(spark, sf_dir, skills=False)
    rows = raw.select(F.col("id").alias("raw_listing_id"), F.col("nation"))
    accepted = rows.where(pick(FAULTS, F.col("nation")) == "").select("raw_listing_id")
    return quality.orphans(accepted, raw.where("balance >= 0").select("id"), "raw_listing_id", "id")


def attempt_outcomes(spark, sf_dir):
    found = components.resolve_attempts(_attempts(spark, sf_dir))
    return found.select(
        "listing_id", "outcome", "attempts", "error", F.col("components").isNotNull().alias("has_components"),
        F.col("raw_response").isNotNull().alias("has_raw"),
    )


def dead_letter_rows(spark, sf_dir):
    outcomes = components.resolve_attempts(_attempts(spark, sf_dir))
    now = F.lit("2002-01-01 00:00:00").cast("timestamp")
    dead = components.dead_letters(outcomes, raw_listings(spark, sf_dir, skills=False), VERSION, MODEL, now)
    return dead.select(
        "kind", "raw_listing_id", "error", "attempts", ts_text(F.col("created_at")).alias("created_at"),
        F.get_json_object("payload", "$.source_url").alias("source_url"),
        F.get_json_object("payload", "$.prompt_version").alias("prompt_version"),
    )


def run_statistics(spark, sf_dir):
    """A run per source over resolved attempts."""
    outcomes = components.resolve_attempts(_attempts(spark, sf_dir))
    raw = raw_listings(spark, sf_dir, skills=False).select(
        F.col("id").alias("listing_id"), F.col("source_type").alias("run_id"),
        F.col("pay").cast("decimal(12,2)").alias("cost_usd"),
    )
    signal = F.coalesce(components.any_flag(F.col("components.visa")), F.lit(False))
    words = F.concat("components.skills", "components.skills_unmapped")
    # read for the counters and for the words, so written once, without answers and errors
    told = pinned(outcomes.select("listing_id", "outcome", "attempts", signal.alias("has_visa_signal"), words.alias("words")))
    rows = told.join(raw, "listing_id")
    # a queue that knows one of the words nobody maps
    queue = spark.createDataFrame([("hot",)], "skill string")
    # which run says a word is asked, not how often
    raw_words = pinned(rows.select("run_id", F.explode("words").alias("raw")).distinct())
    resolved = taxonomy.resolve_mentions(raw_words, dimensions.lookup_terms(skill_table(spark)))
    said = resolved.where("skill_id is null").select("run_id", F.col("folded").alias("skill"))
    found = ledger.run_statistics(rows, queues.first_unmapped(said, queue))
    return found.withColumn("cost_usd", money_text(F.col("cost_usd")))


def _versions(spark, sf_dir):
    """Component rows of two versions: all listings at v1, the sound ones at v2."""
    raw = raw_listings(spark, sf_dir, skills=False).withColumn("sound", pick(FAULTS, F.col("nation")) == "")
    flags = F.when(F.col("nation") == 11, True)
    def at(version, day, rows):
        return rows.select(
            F.col("id").alias("raw_listing_id"), F.lit(version).alias("prompt_version"),
            F.lit(f"2001-09-0{day} 00:00:00").cast("timestamp").alias("extracted_at"),
            F.concat_ws(" ", F.lit(version), "title").alias("title_normalized"),
            flags.alias("visa_sponsorship_available"),
            F.lit(None).cast("boolean").alias("visa_requires_existing_authorization"),
            F.lit(None).cast("boolean").alias("visa_citizenship_or_pr_required"),
        )

    return at("v1", 1, raw).unionByName(at("v2", 2, raw.where("sound")))


def latest_components(spark, sf_dir):
    found = components.latest_components(_versions(spark, sf_dir))
    return found.select("raw_listing_id", "prompt_version", "title_normalized")


def pending_listings(spark, sf_dir):
    raw = raw_listings(spark, sf_dir, skills=False)
    found = candidates.pending(
        raw, _versions(spark, sf_dir), VERSION, clock(raw, "date_scraped"), 365, ("furniture", "household")
    )
    return found.select("id", "source_type", ts_text(F.col("posted_at")).alias("posted_at"))


def pending_first(spark, sf_dir):
    raw = raw_listings(spark, sf_dir, skills=False)
    found = candidates.pending(
        raw, _versions(spark, sf_dir), VERSION, clock(raw, "date_scraped"), 365, ("furniture", "household"), 200
    )
    return found.select("id", ts_text(F.col("posted_at")).alias("posted_at"))


def extraction_status(spark, sf_dir):
    found = ledger.extraction_status(
        raw_listings(spark, sf_dir, skills=False), _versions(spark, sf_dir), _event_dead(spark, sf_dir),
        event_ledger(spark, sf_dir), VERSION, "error",
    )
    return found.withColumn("spend_usd_total", money_text(F.col("spend_usd_total"))).withColumn(
        "spend_usd_last_run", money_text(F.col("spend_usd_last_run"))
    )


def _event_dead(spark, sf_dir):
    """Events as failures; the dearer ones are resolved."""
    e = table(spark, sf_dir, "events")
    created = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("raw_listing_id"),
        created.alias("created_at"), F.when(F.col("value") > 40, created).alias("resolved_at"),
    )


def dead_letters_open(spark, sf_dir):
    dead = queues.list_dead_letters(_event_dead(spark, sf_dir), "error", limit=500)
    return dead.select("id", "kind", ts_text(F.col("created_at")).alias("created_at"))


def dead_letters_all(spark, sf_dir):
    dead = queues.list_dead_letters(_event_dead(spark, sf_dir), include_resolved=True)
    return dead.select("id", "kind", F.col("resolved_at").isNotNull().alias("resolved"))


def dead_letters_unresolved(spark, sf_dir):
    return queues.count_unresolved(_event_dead(spark, sf_dir), "error")


def dead_letters_requeued(spark, sf_dir):
    """Every failed purchase is requested; only the open ones change."""
    dead = _event_dead(spark, sf_dir)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    found = queues.requeue(dead, dead.where(F.col("kind") == "purchase"), now)
    return found.select("id", "requeued", ts_text(F.col("resolved_at")).alias("resolved_at"))


def cad_estimate(spark, sf_dir):
    p = postings(spark, sf_dir, skills=False)
    currency = pick(("CAD", "usd", "EUR", "GBP", "JPY"), F.length("title") % 5)
    period = F.when(F.col("source_type") == "building", "hour").when(F.col("source_type") == "furniture", "month").otherwise("year")
    low = F.when(F.col("title") != "2-HIGH", F.col("pay"))
    high = F.when(F.col("title") != "3-MEDIUM", F.col("pay") + 1000)
    return p.select("id", money_text(cad_annual_estimate(low, high, currency, period)).alias("estimate"))


def evidence_verbatim(spark, sf_dir):
    raw = raw_listings(spark, sf_dir)
    quotes = F.array(
        F.lit("We  look\nfor"),
        F.when(F.col("nation") % 2 == 0, F.array_join(F.slice("skills", 1, 2), ",  ")).otherwise("care and"),
    )
    return raw.select("id", components.verbatim(quotes, F.col("raw_description")).alias("verbatim"))


SENTENCES = (
    "Needs 3-5 years of experience and 10+ yrs of luck.", "Requires 5+ years.", "A minimum 7 years in trade.",
    "Visa sponsorship is not available.", "We sponsor work permits.", "Must be legally entitled to work in Canada.",
    "Canadian citizenship or permanent residence required.", "New grads welcome.", "A co-op term.",
    "Founded 120 years ago.", "Nothing else.",
)


def mined_eligibility(spark, sf_dir):
    raw = raw_listings(spark, sf_dir)
    said = F.concat_ws(" ", "raw_description", pick(SENTENCES, F.col("nation") % 11), pick(SENTENCES, F.length("title") % 11))
    mined = components.mine_eligibility(said)
    return raw.select("id", mined.alias("m")).select(
        "id", "m.min_years_experience", "m.sponsorship_available", "m.requires_existing_authorization",
        "m.citizenship_or_pr_required", "m.is_new_grad_friendly", "m.is_internship_or_coop",
        F.size("m.evidence").alias("quotes"),
    )


QUERIES = {
    "responses_judged": responses_judged,
    "responses_split": responses_split,
    "components_flat": components_flat,
    "visa_known": visa_known,
    "attempt_outcomes": attempt_outcomes,
    "attempts_of_three": attempts_of_three,
    "responses_all_rules": responses_all_rules,
    "component_orphans": component_orphans,
    "dead_letter_rows": dead_letter_rows,
    "run_statistics": run_statistics,
    "latest_components": latest_components,
    "pending_listings": pending_listings,
    "pending_first": pending_first,
    "extraction_status": extraction_status,
    "dead_letters_open": dead_letters_open,
    "dead_letters_all": dead_letters_all,
    "dead_letters_unresolved": dead_letters_unresolved,
    "dead_letters_requeued": dead_letters_requeued,
    "cad_estimate": cad_estimate,
    "evidence_verbatim": evidence_verbatim,
    "mined_eligibility": mined_eligibility,
}

_FAULT = sql_pick(FAULTS, "nation")
_MAP = ", ".join(f"('{w}', '{i}')" for i, _, _ in SKILLS for w in ([i, "gizmo"] if i == "widget" else [i]))
_SOUND = f"{_FAULT} = ''"
_CAD = "CAST(CAST({} AS DECIMAL(18,6)) AS VARCHAR)"


def _at(values: dict, otherwise: str = "NULL") -> str:
    return "CASE nation " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


_OUTCOME = f"""out AS (SELECT id, source_type, source_url, pay, nation,
    CASE WHEN nation = 16 THEN 'refused' WHEN {_SOUND} OR nation < 5 THEN 'accepted' ELSE 'failed' END AS outcome,
    CASE WHEN nation = 16 OR {_SOUND} THEN 1 ELSE 2 END AS attempts,
    CASE WHEN nation = 16 THEN 'model refused' WHEN {_SOUND} OR nation < 5 THEN NULL
         WHEN nation = 10 THEN 'extraction failed after 2 attempts: timeout 2'
         ELSE 'extraction failed after 2 attempts: ' || {_FAULT} END AS error FROM raw)"""
_PENDING = f"""raw2 AS (SELECT * FROM raw WHERE source_type NOT IN ('furniture', 'household') AND NOT {_SOUND}
    AND (posted_at IS NULL OR posted_at >= (SELECT t FROM now_p) - INTERVAL 365 DAY))"""
_DEAD = """dl AS (SELECT event_id AS id, event_type AS kind, ts AS created_at,
    CASE WHEN value > 40 THEN ts END AS resolved_at FROM events)"""
_MINED = f"""said AS (SELECT id, raw_description || ' ' || {sql_pick(SENTENCES, 'nation % 11')} || ' ' ||
    {sql_pick(SENTENCES, 'length(title) % 11')} AS t FROM raw),
yrs AS (SELECT id, t, list_transform(regexp_extract_all(t, '\\b(\\d{{1,2}})(\\+|-\\d{{1,2}}\\+?)? (years|yrs)', 1), lambda y: CAST(y AS INTEGER)) AS ys,
   regexp_extract_all(t, '\\b\\d{{1,2}}(\\+|-\\d{{1,2}}\\+?)? (years|yrs)') AS quoted FROM said)"""

ORACLES = {
    "responses_judged": f"WITH {RAW_CTE} SELECT id AS listing_id, {_FAULT} AS problems FROM raw",
    "responses_split": f"""WITH {RAW_CTE} SELECT CASE WHEN {_SOUND} THEN 'accepted' ELSE {_FAULT} END AS reason,
        count(*) AS n FROM raw GROUP BY 1""",
    "components_flat": f"""WITH {RAW_CTE}, sp(word, skill_id) AS (VALUES {_MAP}),
        m AS (SELECT id, unnest(list_append(skills, 'gizmo')) AS word FROM raw),
        ms AS (SELECT id, string_agg(DISTINCT skill_id, ',' ORDER BY skill_id) AS mapped,
              string_agg(DISTINCT CASE WHEN skill_id IS NULL THEN m.word END, ',') AS missing
            FROM m LEFT JOIN sp ON sp.word = m.word GROUP BY id),
        un AS (SELECT id, array_to_string(list_sort(list_append(list_filter(skills, lambda s: s IN ('hot', 'cold')), 'forklift')), ',') AS unmapped FROM raw)
        SELECT raw.id AS raw_listing_id, 'v2' AS prompt_version, title AS title_raw, lower(title) AS title_normalized,
          {_at({21: "'lead'"}, "'unknown'")} AS seniority, lower(company) AS company_canonical,
          mapped AS skills, unmapped AS skills_unmapped,
          {_at({11: "'41.250000'"})} AS comp_min, {_at({12: "'8000.000000'"})} AS comp_max,
          {_at({11: "'USD'", 12: "'EUR'"})} AS comp_currency, {_at({11: "'hour'", 12: "'month'"})} AS comp_period,
          nation = 11 AS comp_is_estimated,
          {_at({11: "'117546.000000'", 12: "'142080.000000'"})} AS comp_cad_annual_est,
          location AS location_raw, {_at({20: "'CA'"})} AS country, {_at({21: "'remote'"}, "'unknown'")} AS remote_policy,
          {_at({11: "true"})} AS visa_sponsorship_available, {_at({15: "false"})} AS visa_requires_existing_authorization,
          {_at({12: "0", 16: "7"})} AS min_years_experience, {_at({16: "false"})} AS degree_required,
          {_at({12: "'0-2 years'", 16: "'7+ years'"}, "''")} AS eligibility_evidence,
          {_at({11: "'we sponsor'", 15: "'no permit needed'"}, "''")} AS visa_evidence,
          CASE WHEN nation = 20 THEN '2001-02-03 00:00:00' ELSE strftime(posted_at, '%Y-%m-%d %H:%M:%S') END AS posted_at,
          {_at({21: "'fr'"}, "'en'")} AS language, CAST({_at({21: "0.25"}, "0.5")} AS DOUBLE) AS extraction_confidence
        FROM raw JOIN ms ON ms.id = raw.id JOIN un ON un.id = raw.id WHERE {_SOUND}""",
    "visa_known": f"WITH {RAW_CTE} SELECT id AS raw_listing_id FROM raw WHERE nation IN (11, 15)",
    "attempt_outcomes": "",
    "dead_letter_rows": f"""WITH {RAW_CTE}, {_OUTCOME} SELECT 'extraction' AS kind, id AS raw_listing_id, error, attempts,
        '2002-01-01 00:00:00' AS created_at, source_url, 'v2' AS prompt_version FROM out WHERE outcome <> 'accepted'""",
    "run_statistics": f"""WITH {RAW_CTE}, {_OUTCOME},
        said AS (SELECT source_type, unnest(list_append(skills, 'forklift')) AS skill FROM raw
          WHERE id IN (SELECT id FROM out WHERE outcome = 'accepted')),
        firsts AS (SELECT skill, min(source_type) AS run FROM said WHERE skill NOT IN ('hot', 'gizmo')
          AND skill NOT IN ({", ".join(f"'{i}'" for i, _, _ in SKILLS)}) GROUP BY skill)
        SELECT source_type AS run_id, (SELECT count(*) FROM firsts WHERE run = source_type) AS unmapped_new, count(*) AS considered,
        count(*) FILTER (WHERE outcome = 'accepted') AS extracted, count(*) FILTER (WHERE outcome <> 'accepted') AS dead_lettered,
        count(*) FILTER (WHERE outcome = 'accepted' AND attempts > 1) AS retried,
        CAST(CAST(sum(CAST(pay AS DECIMAL(12,2))) AS DECIMAL(18,6)) AS VARCHAR) AS cost_usd,
        count(*) FILTER (WHERE outcome = 'accepted' AND nation IN (11, 15)) AS visa_signals_found FROM out GROUP BY 1""",
    "latest_components": f"""WITH {RAW_CTE} SELECT id AS raw_listing_id, CASE WHEN {_SOUND} THEN 'v2' ELSE 'v1' END AS prompt_version,
        CASE WHEN {_SOUND} THEN 'v2 ' ELSE 'v1 ' END || title AS title_normalized FROM raw""",
    "pending_listings": f"""WITH {RAW_CTE}, {_PENDING} SELECT id, source_type, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at
        FROM raw2""",
    "pending_first": f"""WITH {RAW_CTE}, {_PENDING} SELECT id, strftime(raw2.posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at
        FROM raw2 ORDER BY raw2.posted_at DESC NULLS LAST, id LIMIT 200""",
    "extraction_status": f"""WITH {RAW_CTE}, {E_CTE}, {_DEAD}, n AS (SELECT count(*) AS r, count(*) FILTER (WHERE {_SOUND}) AS x,
          count(*) FILTER (WHERE nation = 11) AS visa FROM raw),
        last AS (SELECT run_id FROM e WHERE purpose = 'error' ORDER BY created_at DESC, id DESC LIMIT 1)
        SELECT 'v2' AS prompt_version, r AS raw_listings, x AS extracted, r - x AS pending,
          round_even(CAST(100 * x AS DECIMAL(18,6)) / r, 1) AS coverage_pct, visa AS with_visa_signals,
          (SELECT count(*) FROM dl WHERE kind = 'error' AND resolved_at IS NULL) AS unresolved_dead_letters,
          (SELECT CAST(sum(cost_usd) AS VARCHAR) FROM e WHERE purpose = 'error') AS spend_usd_total,
          (SELECT CAST(sum(cost_usd) AS VARCHAR) FROM e WHERE run_id = (SELECT run_id FROM last)) AS spend_usd_last_run,
          (SELECT run_id FROM last) AS last_run_id FROM n""",
    "dead_letters_open": f"""WITH {_DEAD} SELECT id, kind, strftime(dl.created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM dl
        WHERE kind = 'error' AND resolved_at IS NULL ORDER BY dl.created_at DESC, id DESC LIMIT 500""",
    "dead_letters_all": f"""WITH {_DEAD} SELECT id, kind, resolved_at IS NOT NULL AS resolved FROM dl
        ORDER BY created_at DESC, id DESC LIMIT 50""",
    "dead_letters_unresolved": f"""WITH {_DEAD} SELECT count(*) AS total_unresolved FROM dl
        WHERE kind = 'error' AND resolved_at IS NULL""",
    "dead_letters_requeued": f"""WITH {_DEAD} SELECT id, kind = 'purchase' AND resolved_at IS NULL AS requeued,
        CASE WHEN kind = 'purchase' AND resolved_at IS NULL THEN '2024-03-01 00:00:00'
             ELSE strftime(resolved_at, '%Y-%m-%d %H:%M:%S') END AS resolved_at FROM dl""",
    "cad_estimate": f"""WITH {P_CTE}, x AS (SELECT id, CASE WHEN title <> '2-HIGH' THEN CAST(pay AS DECIMAL(18,6)) END AS lo,
          CASE WHEN title <> '3-MEDIUM' THEN CAST(pay + 1000 AS DECIMAL(18,6)) END AS hi,
          (['CAD', 'USD', 'EUR', 'GBP', 'JPY'])[length(title) % 5 + 1] AS cur,
          CASE source_type WHEN 'building' THEN 2080 WHEN 'furniture' THEN 12 ELSE 1 END AS times FROM p),
        r(cur, rate) AS (VALUES ('CAD', 1.00), ('USD', 1.37), ('EUR', 1.48), ('GBP', 1.73)),
        y AS (SELECT id, coalesce(lo, hi) + coalesce(hi, lo) AS twice, times, rate FROM x LEFT JOIN r ON r.cur = x.cur)
        SELECT id, CAST(CAST(round_even(CAST(twice * 5 * times AS DECIMAL(26,6)) * CAST(rate AS DECIMAL(5,2)) * CAST(0.1 AS DECIMAL(2,1)), 2) AS DECIMAL(18,6)) AS VARCHAR) AS estimate FROM y""",
    "evidence_verbatim": f"""WITH {RAW_CTE} SELECT id, nation % 2 = 0 AS verbatim FROM raw""",
    "mined_eligibility": f"""WITH {RAW_CTE}, {_MINED} SELECT id,
        CASE WHEN list_min(ys) <= 40 THEN list_min(ys) END AS min_years_experience,
        CASE WHEN contains(t, 'sponsorship is not available') THEN false WHEN contains(t, 'We sponsor work') THEN true END AS sponsorship_available,
        CASE WHEN contains(t, 'Must be legally') THEN true END AS requires_existing_authorization,
        CASE WHEN contains(t, 'Canadian citizenship') THEN true END AS citizenship_or_pr_required,
        CASE WHEN contains(t, 'New grads') THEN true END AS is_new_grad_friendly,
        CASE WHEN contains(t, 'co-op term') THEN true END AS is_internship_or_coop,
        CAST(len(quoted) + contains(t, 'sponsor')::INT + contains(t, 'Must be legally')::INT + contains(t, 'Canadian citizenship')::INT
          + contains(t, 'New grads')::INT + contains(t, 'co-op term')::INT AS INTEGER) AS quotes FROM yrs""",
}
ORACLES["attempt_outcomes"] = f"""WITH {RAW_CTE}, {_OUTCOME} SELECT id AS listing_id, outcome, attempts, error,
    outcome = 'accepted' AS has_components, outcome = 'failed' AND nation <> 10 AS has_raw FROM out"""
_KIND = "id % 5"
_LONG = "'timeout ' || repeat('x', CAST(id % 100 + 5000 AS INTEGER)) || '3'"
ORACLES["attempts_of_three"] = f"""WITH {RAW_CTE}, o AS (SELECT id, {sql_pick(('accepted', 'failed', 'refused', 'accepted', 'failed'), _KIND)} AS outcome,
    CASE WHEN {_KIND} = 3 THEN 2 ELSE 3 END AS attempts,
    CASE {_KIND} WHEN 1 THEN 'extraction failed after 3 attempts: ' || {_LONG} WHEN 2 THEN 'model refused'
      WHEN 4 THEN 'extraction failed after 3 attempts: {FAULTS[UNSOUND]}' END AS error FROM raw)
    SELECT id AS listing_id, outcome, attempts, length(error) AS error_length, md5(error) AS error_digest,
      outcome = 'accepted' AS has_components, id % 5 = 4 AS has_raw FROM o"""
_BROKEN = sql_pick([rules for rules, _ in RULE_CASES], f"p_partkey % {len(RULE_CASES)}")
ORACLES["responses_all_rules"] = f"""SELECT p_partkey AS listing_id, {_BROKEN} AS problems,
    CASE WHEN {_BROKEN} = '' THEN p_name END AS title FROM part"""
ORACLES["component_orphans"] = f"""WITH {RAW_CTE} SELECT id AS raw_listing_id, count(*) AS n FROM raw
    WHERE {_SOUND} AND NOT balance >= 0 GROUP BY 1"""
