"""Ranks and quantiles over whole tables without a single-task sort.

Equal values are collapsed to (value, count) first, so a value held by a third of all rows is one
row. Cut points of equal depth come from a mergeable quantile sketch; they only decide how
the work is split, so ranks and quantiles are exact whatever the sketch's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_positions(df: DataFrame, value: str, slices: int = 256) -> DataFrame:
    """Distinct non-null values of `value` with `_n` copies, `_before` rows ahead, `_total` rows.

    Each slice is ordered by its own task; the running totals over slices are at most
    `slices + 1` rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    slices = max(slices, 2)
    points = [i / slices for i in range(1, slices)]
    cuts = counts.agg(
        F.percentile_approx(value, F.array(*[F.lit(p) for p in points]), F.lit(slices * 40))
    ).scalar()
    sliced = (
        counts.withColumn("_cuts", cuts)
        .withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
        .drop("_cuts")
    )
    by_slice = sliced.groupBy("_slice").agg(F.sum("_n").alias("_rows"))
    # at most `slices` rows reach this unpartitioned window
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = F.broadcast(
        by_slice.withColumn("_ahead", F.sum("_rows").over(ahead) - F.col("_rows")).select(
            "_slice", "_ahead"
        )
    )
    total = counts.agg(F.sum("_n")).scalar()
    inside = Window.partitionBy("_slice").orderBy(value)
    return (
        sliced.join(offsets, "_slice")
        .withColumn(
            "_before",
            F.col("_ahead")
            + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            - F.col("_n"),
        )
        .select(value, "_n", "_before", total.alias("_total"))
    )


def percent_rank() -> Column:
    """Average-rank percentile: (rank of the first copy + half the spread of its ties) / rows."""
    first = (F.col("_before") + 1).cast("double")
    return (first + (F.col("_n") - 1).cast("double") / 2.0) / F.col("_total").cast("double")


def quantile_at(measure: str, q: float) -> Column:
    """Aggregate over value positions: linear-interpolated quantile of `measure`.

    `measure` must rise with the value the positions were built on.
    """
    at = (F.col("_total") - 1).cast("double") * F.lit(q)
    low = F.floor(at)

    def holding(index: Column) -> Column:
        inside = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_n"))
        return F.max(F.when(inside, F.col(measure)))

    lo, hi = holding(low), holding(F.least(low + 1, F.col("_total") - 1))
    return lo + (hi - lo) * F.max(at - low.cast("double"))
