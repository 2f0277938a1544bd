"""Governed views over the star schema. None of them sees negative amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import as_double, half_up, sum_if
from outlay.operators.pvm import v_pvm_monthly

# Fixed values.
VARIANCE_LIMIT = "1.05"
RISK_COST = {"High": "0.080", "Medium": "0.040"}
RISK_COST_ELSE = "0.015"
SWITCHING_COST = {"High": "0.05", "Medium": "0.02"}
SWITCHING_COST_ELSE = "0.01"


def _billed(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("invoice_amount") >= 0)


def _month() -> Column:
    return F.trunc("spend_date", "MM").alias("period_month")


def _supplier_names(suppliers: DataFrame, *extra: str) -> DataFrame:
    return suppliers.select("supplier_id", F.col("name").alias("supplier_name"), *extra)


def _category_names(categories: DataFrame, *extra: str) -> DataFrame:
    return categories.select("category_id", F.col("name").alias("category_name"), *extra)


def _over_limit() -> Column:
    """More than 5% above a known positive rate, as a product so that it is exact."""
    limit = F.col("negotiated_rate") * F.lit(VARIANCE_LIMIT).cast("decimal(3,2)")
    return F.coalesce(
        (F.col("negotiated_rate") > 0) & (F.col("actual_rate") > limit), F.lit(False)
    )


def v_spend_cube(fact: DataFrame, suppliers: DataFrame, categories: DataFrame) -> DataFrame:
    """Month by supplier by category by cost centre. Summed on the keys, then named."""
    sums = (
        _billed(fact)
        .groupBy(_month(), "supplier_id", "category_id", "cost_center")
        .agg(
            F.count("*").alias("txn_count"),
            F.sum("quantity").alias("volume"),
            F.sum("invoice_amount").alias("spend"),
            _mean_rate("actual_rate"),
            _mean_rate("negotiated_rate"),
        )
    )
    return (
        sums.join(_supplier_names(suppliers, "risk_tier", "region"), "supplier_id")
        .join(_category_names(categories, "parent_category", "direct_or_indirect"), "category_id")
        .select(
            "period_month",
            "supplier_id",
            "supplier_name",
            "risk_tier",
            "region",
            "category_id",
            "category_name",
            "parent_category",
            "direct_or_indirect",
            "cost_center",
            "txn_count",
            "volume",
            F.round("spend", 2).alias("spend"),
            "avg_actual_rate",
            "avg_negotiated_rate",
        )
    )


def supplier_category_spend(
    fact: DataFrame, suppliers: DataFrame, categories: DataFrame
) -> DataFrame:
    """The cube's spend without month and cost centre, for questions that ask for neither.

    Amounts have two places, so rounding cube rows first would change nothing.
    """
    sums = _billed(fact).groupBy("supplier_id", "category_id").agg(
        F.sum("invoice_amount").alias("spend")
    )
    return (
        sums.join(_supplier_names(suppliers, "risk_tier", "region"), "supplier_id")
        .join(_category_names(categories, "parent_category", "direct_or_indirect"), "category_id")
        .drop("supplier_id", "category_id")
    )


def _mean_rate(column: str) -> Column:
    mean = as_double(F.sum(column)) / F.nullif(F.count(column).cast("double"), F.lit(0.0))
    return half_up(mean, 4).alias(f"avg_{column}")


def variance_lines(fact: DataFrame) -> DataFrame:
    """Contract lines with a negotiated rate, with their variance columns; no names yet."""
    above = F.col("actual_rate") - F.col("negotiated_rate")
    share = above * 100 / F.nullif(F.col("negotiated_rate"), F.lit(0).cast("decimal(14,4)"))
    return (
        _billed(fact)
        .where(F.col("contract_id").isNotNull() & F.col("negotiated_rate").isNotNull())
        .select(
            "transaction_id",
            "spend_date",
            _month(),
            "supplier_id",
            "category_id",
            "po_number",
            "contract_id",
            "quantity",
            "negotiated_rate",
            "actual_rate",
            F.round(above, 4).alias("rate_variance"),
            F.round(share, 2).alias("variance_pct"),
            F.round(above * F.col("quantity"), 2).alias("leakage_amount"),
            _over_limit().alias("variance_flag"),
        )
    )


def v_price_variance(fact: DataFrame, suppliers: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        variance_lines(fact)
        .join(_supplier_names(suppliers), "supplier_id")
        .join(_category_names(categories, "direct_or_indirect"), "category_id")
        .select(
            "transaction_id",
            "spend_date",
            "period_month",
            "supplier_id",
            "supplier_name",
            "category_name",
            "direct_or_indirect",
            "po_number",
            "contract_id",
            "quantity",
            "negotiated_rate",
            "actual_rate",
            "rate_variance",
            "variance_pct",
            "leakage_amount",
            "variance_flag",
        )
    )


def v_tco_by_supplier(fact: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Spend with quality-risk and switching cost by risk tier; a tier that is missing or
    unknown takes the lowest rates. The total is rounded once, from the unrounded sum."""
    sums = _billed(fact).groupBy("supplier_id").agg(F.sum("invoice_amount").alias("spend"))
    named = sums.join(_supplier_names(suppliers, "risk_tier", "region"), "supplier_id")

    def rate(by_tier: dict[str, str], other: str) -> Column:
        expr = None
        for tier, value in by_tier.items():
            cond, val = F.col("risk_tier") == tier, F.lit(value).cast("decimal(4,3)")
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return expr.otherwise(F.lit(other).cast("decimal(4,3)"))

    spend = F.col("spend")
    at_risk = spend * rate(RISK_COST, RISK_COST_ELSE)
    switching = spend * rate(SWITCHING_COST, SWITCHING_COST_ELSE)
    return named.select(
        "supplier_id",
        "supplier_name",
        "risk_tier",
        "region",
        F.round(spend, 2).alias("invoice_spend"),
        F.round(at_risk, 2).alias("risk_quality_cost"),
        F.round(switching, 2).alias("switching_cost_est"),
        F.round(spend + at_risk + switching, 2).alias("tco"),
    )


def maverick_lines(fact: DataFrame) -> DataFrame:
    return _billed(fact).where(F.col("is_maverick"))


def v_maverick_spend(fact: DataFrame, suppliers: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        maverick_lines(fact)
        .join(_supplier_names(suppliers), "supplier_id")
        .join(_category_names(categories, "direct_or_indirect"), "category_id")
        .select(
            "transaction_id",
            "spend_date",
            _month(),
            "supplier_id",
            "supplier_name",
            "category_name",
            "direct_or_indirect",
            "po_number",
            "cost_center",
            F.round("invoice_amount", 2).alias("spend"),
            "is_maverick",
        )
    )


def v_executive_monthly(fact: DataFrame, categories: DataFrame) -> DataFrame:
    """Monthly totals. Lines are folded to month and category before the category is looked up."""
    amount = F.col("invoice_amount")
    over = F.col("contract_id").isNotNull() & _above_rate()
    leaked = (F.col("actual_rate") - F.col("negotiated_rate")) * F.col("quantity")
    sums = (
        _billed(fact)
        .groupBy(_month(), "category_id")
        .agg(
            F.sum(amount).alias("spend"),
            sum_if(F.col("is_maverick"), amount).alias("maverick"),
            sum_if(over, leaked).alias("leaked"),
            F.count("*").alias("lines"),
        )
    )
    kinds = categories.select("category_id", "direct_or_indirect")
    spend = F.col("spend")
    return (
        sums.join(kinds, "category_id")
        .groupBy("period_month")
        .agg(
            F.round(F.sum(spend), 2).alias("total_spend"),
            F.round(sum_if(F.col("direct_or_indirect") == "Direct", spend), 2).alias(
                "direct_spend"
            ),
            F.round(sum_if(F.col("direct_or_indirect") == "Indirect", spend), 2).alias(
                "indirect_spend"
            ),
            F.round(F.sum("maverick"), 2).alias("maverick_spend"),
            F.round(F.sum("leaked"), 2).alias("rate_leakage"),
            F.sum("lines").alias("txn_count"),
        )
    )


def _above_rate() -> Column:
    """The 5% rule of the monthly view, which does not ask for a positive rate."""
    limit = F.col("negotiated_rate") * F.lit(VARIANCE_LIMIT).cast("decimal(3,2)")
    return F.coalesce(F.col("actual_rate") > limit, F.lit(False))


def semantic_views(
    fact: DataFrame, suppliers: DataFrame, categories: DataFrame
) -> dict[str, DataFrame]:
    """The six governed views by name, in publishing order."""
    return {
        "v_spend_cube": v_spend_cube(fact, suppliers, categories),
        "v_price_variance": v_price_variance(fact, suppliers, categories),
        "v_tco_by_supplier": v_tco_by_supplier(fact, suppliers),
        "v_maverick_spend": v_maverick_spend(fact, suppliers, categories),
        "v_executive_monthly": v_executive_monthly(fact, categories),
        "v_pvm_monthly": v_pvm_monthly(fact, categories),
    }
