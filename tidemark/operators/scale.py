"""Ordered and first-of-key operations that do not depend on group size.

A window over a group sorts the whole group in one task.  These helpers give
the same answers when one key holds a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import pinned


def first_seqs(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """keys and their smallest seq.  Partial aggregation absorbs hot keys."""
    return rows.groupBy(*keys).agg(F.min(seq).alias(seq))


def first_rows(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row with the smallest seq of each key, whole.

    seq tells the rows of a key apart.  Joining back on keys and seq together
    spreads the rows of a hot key over all tasks, and the first pass reads
    nothing but keys and seq.
    """
    return rows.join(first_seqs(rows, keys, seq), [*keys, seq], "left_semi")


def running_before(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, Column],
    slices: int | None = None,
) -> DataFrame:
    """Adds, per entry of values, the sum over the rows of the same key that come earlier.

    The order columns must tell any two rows of a key apart.  Rows are cut into
    ranges of (keys, order); a range total and a short window over the totals
    give each range its starting value, and only a range is ever sorted in one
    task.  The cut is written to the checkpoint folder, because totals and rows
    must agree on it even when tasks are run again; pass the columns that are
    needed, not whole texts.
    """
    inputs = {f"_v_{name}": value for name, value in values.items()}
    ranged = rows.select("*", *[v.alias(n) for n, v in inputs.items()])
    # without a number, small neighbouring ranges are merged at run time
    cut = [slices] if slices else []
    ranged = pinned(
        ranged.repartitionByRange(*cut, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    totals = ranged.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(f"_t{n}") for n in inputs])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[F.sum(f"_t{n}").over(earlier).alias(f"_o{n}") for n in inputs],
    )
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    local = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = {
        name: F.coalesce(F.col(f"_o_v_{name}"), F.lit(0)) + F.coalesce(F.sum(f"_v_{name}").over(local), F.lit(0))
        for name in values
    }
    return ranged.join(offsets, same, "left").select(
        *[F.col(c) for c in rows.columns], *[c.alias(n) for n, c in before.items()]
    )


def ranked(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "rank"
) -> DataFrame:
    """1-based position of each row within its key, in the given order."""
    counted = running_before(rows, keys, order, {out: F.lit(1).cast("bigint")})
    return counted.withColumn(out, F.col(out) + 1)
