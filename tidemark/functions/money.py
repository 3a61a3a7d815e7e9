"""Pay estimates and call prices, in decimals throughout."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv


def _lookup(key: Column, table: dict, cast: str) -> Column:
    out = F.lit(None).cast(cast)
    for name, value in table.items():
        out = F.when(key == name, F.lit(Decimal(value)).cast(cast)).otherwise(out)
    return out


def cad_annual_estimate(
    min_amount: Column, max_amount: Column, currency: Column, period: Column
) -> Column:
    """Midpoint of the stated bounds as CAD per year, 2 places half-even.

    NULL without an amount, a currency of the rate table and a period.
    """
    low, high = (a.cast("decimal(20,6)") for a in (min_amount, max_amount))
    middle = (
        F.when(low.isNotNull() & high.isNotNull(), (low + high) * F.lit(Decimal("0.5")))
        .otherwise(F.coalesce(low, high))
        .cast("decimal(20,7)")
    )
    rate = _lookup(F.upper(currency), fv.CAD_PER_UNIT, "decimal(5,2)")
    times = _lookup(period, fv.PERIODS_PER_YEAR, "decimal(5,0)")
    return F.bround(middle * times * rate, 2).cast("decimal(20,2)")


def price_call(
    in_tokens: Column, out_tokens: Column, in_rate: Column, out_rate: Column, batch: Column
) -> Column:
    """USD of one call from its tokens and the rates per million; a batch call is half price."""
    def part(tokens: Column, rate: Column) -> Column:
        return tokens.cast("decimal(14,0)") * rate.cast("decimal(10,4)")

    per_million = F.lit(Decimal("0.000001"))
    full = (part(in_tokens, in_rate) + part(out_tokens, out_rate)) * per_million
    share = F.when(batch, F.lit(Decimal("0.5"))).otherwise(F.lit(Decimal("1.0")))
    return (full * share).cast("decimal(24,12)")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one place, half-even; 0 when there is no whole."""
    exact = F.lit(100).cast("decimal(20,0)") * part / whole.cast("decimal(20,0)")
    return F.when(whole > 0, F.bround(exact, 1).cast("double")).otherwise(F.lit(0.0))


def prf1(predicted: Column, gold: Column) -> Column:
    """struct(precision, recall, f1) of two distinct arrays; both empty is a perfect row."""
    n_pred, n_gold = F.size(predicted), F.size(gold)
    hits = F.size(F.array_intersect(predicted, gold))
    precision = F.when(n_pred > 0, hits / n_pred).otherwise(F.lit(0.0))
    recall = F.when(n_gold > 0, hits / n_gold).otherwise(F.lit(0.0))
    f1 = F.when(hits > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    perfect = (n_pred == 0) & (n_gold == 0)
    return F.struct(
        *[
            F.when(perfect, F.lit(1.0)).otherwise(value).alias(name)
            for name, value in (("precision", precision), ("recall", recall), ("f1", f1))
        ]
    )
