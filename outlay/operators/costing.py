"""Cost measures of invoice lines and the should-cost build-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import MONEY, RATE, as_double

# Fixed values of the cost model.
BASELINE_MARKUP = "1.08"
CAPITAL_RATE = 0.05
DAYS_PER_YEAR = 365.0


def derive_cost_measures(lines: DataFrame) -> DataFrame:
    """Add baseline_unit_price, savings_realized, payment_terms_cost and tco_amount.

    Needs actual_unit_price, contracted_unit_price, qty, invoice_amount, freight_cost,
    quality_cost, payment_terms_days; takes the payment cost on `cost_basis` where that column
    exists, else on invoice_amount.
    """
    basis = F.col("cost_basis" if "cost_basis" in lines.columns else "invoice_amount")
    baseline = F.round(
        F.col("contracted_unit_price") * F.lit(BASELINE_MARKUP).cast("decimal(3,2)"), 4
    ).cast(RATE)
    saved = F.round((F.col("baseline_unit_price") - F.col("actual_unit_price")) * F.col("qty"), 2)
    carrying = (
        F.floor(
            as_double(basis)
            * (F.col("payment_terms_days").cast("double") / DAYS_PER_YEAR)
            * CAPITAL_RATE
            * 100.0
            + 0.5
        ).cast("double")
        / 100.0
    )
    return (
        lines.withColumn("baseline_unit_price", baseline)
        .withColumn("savings_realized", F.greatest(F.lit(0).cast(MONEY), saved.cast(MONEY)))
        .withColumn("payment_terms_cost", carrying.cast(MONEY))
        .withColumn(
            "tco_amount",
            (
                F.col("invoice_amount")
                + F.col("freight_cost")
                + F.col("quality_cost")
                + F.col("payment_terms_cost")
            ).cast(MONEY),
        )
    )


def should_cost_buildup(components: DataFrame) -> DataFrame:
    """Add should_cost_unit, the sum of the five cost components."""
    parts = ("material_cost", "labor_cost", "overhead_cost", "freight_cost", "quality_cost")
    total = F.col(parts[0])
    for part in parts[1:]:
        total = total + F.col(part)
    return components.withColumn("should_cost_unit", total.cast(MONEY))
