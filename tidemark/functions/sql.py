"""The scalar functions that have a plain SQL body, as temporary SQL functions.

register(spark) makes them callable from spark.sql; each gives what the Column
function of the same name gives, and is inlined into the plan like it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark import fixed_values as fv
from tidemark.functions import geo
from tidemark.functions.text import SPACE_CHARS, SPACE_CLASS


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPACES = _text(f"[{SPACE_CLASS}]+")
_RATES = " ".join(f"WHEN '{c}' THEN {rate}BD" for c, rate in fv.CAD_PER_UNIT.items())
_TIMES = " ".join(f"WHEN '{p}' THEN {n}" for p, n in fv.PERIODS_PER_YEAR.items())


def _collapsed(c: str) -> str:
    return f"btrim(regexp_replace({c}, {_SPACES}, ' '), ' ')"


def _kind(segment: str) -> str:
    """geo.segment_kind of a lower-case SQL expression."""
    def matches(pattern: str) -> str:
        return f"{segment} RLIKE {_text(pattern)}"

    rest = f"regexp_replace({segment}, {_text(geo._ARRANGEMENT)}, ' ')"
    canadian = " OR ".join(map(matches, (geo._CANADA, geo._PROVINCE_CODE, geo._INCLUSIVE)))
    foreign = " OR ".join(map(matches, (geo._FOREIGN, geo._US, geo._STATE_CODE)))
    return (
        f"CASE WHEN {canadian} THEN 'ca' WHEN {foreign} THEN 'foreign' WHEN {matches(geo._CITY)} THEN 'ca'"
        f" WHEN NOT {rest} RLIKE '[a-z]' THEN 'arrangement' WHEN {matches(geo._ARRANGEMENT)} THEN 'foreign' ELSE 'unknown' END"
    )


_SEGMENTS = f"filter(split(location, '[|;]'), s -> btrim(s, {_text(SPACE_CHARS)}) <> '')"
_KINDS = f"transform(transform({_SEGMENTS}, s -> lower(s)), s -> {_kind('s')})"

# name -> (parameters, result type, body)
FUNCTIONS = {
    "strip_ws": ("c STRING", "STRING", f"btrim(c, {_text(SPACE_CHARS)})"),
    "collapse_ws": ("c STRING", "STRING", _collapsed("c")),
    "match_key": ("c STRING", "STRING", f"regexp_replace(lower(c), {_text(fv.MATCH_KEY_DROPPED)}, '')"),
    "content_hash": (
        "title STRING, company STRING, location STRING, description STRING",
        "STRING",
        "sha2(concat_ws('\\u001f', "
        + ", ".join(
            f"lower({_collapsed(c)})"
            for c in ("title", "company", "coalesce(location, '')", "description")
        )
        + "), 256)",
    ),
    "parse_ts": (
        "c STRING",
        "TIMESTAMP",
        f"try_cast(CASE WHEN c RLIKE {_text(chr(94) + r'\d{4}-\d{2}-\d{2}(?:$|[T ].*)')} THEN c END AS TIMESTAMP)",
    ),
    "strip_query": ("url STRING", "STRING", "split_part(url, '?', 1)"),
    "long_id": (
        "url STRING",
        "STRING",
        f"nullif(regexp_extract(url, {_text(fv.LONG_ID_PATTERN)}, 1), '')",
    ),
    "cad_annual_estimate": (
        "low DOUBLE, high DOUBLE, currency STRING, period STRING",
        "DECIMAL(20,2)",
        "CAST(bround(CAST((coalesce(CAST(low AS DECIMAL(20,6)), CAST(high AS DECIMAL(20,6)))"
        " + coalesce(CAST(high AS DECIMAL(20,6)), CAST(low AS DECIMAL(20,6)))) * 0.5BD AS DECIMAL(20,7))"
        f" * CAST(CASE period {_TIMES} END AS DECIMAL(5,0))"
        f" * CAST(CASE upper(currency) {_RATES} END AS DECIMAL(5,2)), 2) AS DECIMAL(20,2))",
    ),
    "looks_canadian": (
        "location STRING",
        "BOOLEAN",
        f"coalesce(transform(array({_KINDS}), k -> array_contains(k, 'ca') OR NOT (array_contains(k, 'foreign')"
        " OR (array_contains(k, 'arrangement') AND array_contains(k, 'unknown'))))[0], true)",
    ),
    "price_call": (
        "in_tokens BIGINT, out_tokens BIGINT, in_rate DECIMAL(10,4), out_rate DECIMAL(10,4), batch BOOLEAN",
        "DECIMAL(24,12)",
        "CAST((CAST(in_tokens AS DECIMAL(14,0)) * in_rate + CAST(out_tokens AS DECIMAL(14,0)) * out_rate) * 0.000001BD"
        " * CASE WHEN batch THEN 0.5BD ELSE 1.0BD END AS DECIMAL(24,12))",
    ),
    "week_of": ("ts TIMESTAMP", "DATE", "to_date(date_trunc('week', ts))"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
