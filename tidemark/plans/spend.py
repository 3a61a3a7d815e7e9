"""Ledger queries over events, with their SQL twins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.plans.bindings import E_CTE, ledger as event_ledger, money_text, table
from tidemark.schemas import PRICE

PRICES = (("view", "3.00", "15.00"), ("click", "1.00", "5.00"), ("purchase", "5.00", "25.00"))
CAP = Decimal("15.00")


def run_spend(spark, sf_dir):
    return ledger.run_spend(event_ledger(spark, sf_dir)).withColumn("spent", money_text(F.col("spent")))


def within_cap(spark, sf_dir):
    kept = ledger.within_cap(event_ledger(spark, sf_dir), CAP)
    return kept.select("id", "run_id", money_text(F.col("spent_before")).alias("spent_before"))


def within_large_cap(spark, sf_dir):
    """The whole ledger as one run, its total cut into eight slices."""
    one_run = event_ledger(spark, sf_dir).withColumn("run_id", F.lit(1))
    kept = ledger.within_cap(one_run, Decimal("100000"), slices=8)
    return kept.select("id", money_text(F.col("spent_before")).alias("spent_before"))


def priced_calls(spark, sf_dir):
    """Event types as models, two of them without a price."""
    e = table(spark, sf_dir, "events")
    calls = e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("model"),
        (F.col("value").cast("decimal(12,2)") * 1000).cast("bigint").alias("input_tokens"),
        (F.col("user_id") * 10).alias("output_tokens"),
        (F.col("user_id") % 2 == 0).alias("batch"),
    )
    prices = spark.createDataFrame([(m, Decimal(i), Decimal(o)) for m, i, o in PRICES], PRICE)
    priced = ledger.price_calls(calls, prices)
    return priced.select("id", "model", F.col("cost_usd").cast("decimal(24,7)").cast("string").alias("cost_usd"))


QUERIES = {
    "run_spend": run_spend,
    "within_cap": within_cap,
    "within_large_cap": within_large_cap,
    "priced_calls": priced_calls,
}

_BEFORE = """coalesce(sum(cost_usd) OVER ({} ORDER BY created_at, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
_CAPPED = f"""WITH {E_CTE}, x AS (SELECT id, run_id, CAST({{}} AS DECIMAL(18,6)) AS b FROM e)
    SELECT {{}}, CAST(b AS VARCHAR) AS spent_before FROM x WHERE b < {{}}"""
_RATES = ", ".join(f"('{m}', CAST({i} AS DECIMAL(10,2)), CAST({o} AS DECIMAL(10,2)))" for m, i, o in PRICES)

ORACLES = {
    "run_spend": f"WITH {E_CTE} SELECT run_id, CAST(sum(cost_usd) AS VARCHAR) AS spent, count(*) AS calls FROM e GROUP BY run_id",
    "within_cap": _CAPPED.format(_BEFORE.format("PARTITION BY run_id"), "id, run_id", "15"),
    "within_large_cap": _CAPPED.format(_BEFORE.format(""), "id", "100000"),
    "priced_calls": f"""WITH r(model, i, o) AS (VALUES {_RATES}),
        c AS (SELECT event_id AS id, event_type AS model, CAST(CAST(value AS DECIMAL(12,2)) * 1000 AS BIGINT) AS it,
              user_id * 10 AS ot, user_id % 2 = 0 AS batch FROM events)
        SELECT id, c.model, CAST(CAST((CAST(it AS DECIMAL(14,0)) * coalesce(i, 5.00) + CAST(ot AS DECIMAL(14,0)) * coalesce(o, 25.00))
          * CASE WHEN batch THEN 5 ELSE 10 END AS DECIMAL(24,7)) * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(24,7))::VARCHAR AS cost_usd
        FROM c LEFT JOIN r ON r.model = c.model""",
}
