"""Gold marts over the invoice-line fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import as_double, percent, ratio, sum_if

CUBE_KEYS = (
    "period_month",
    "spend_type",
    "category_l2",
    "category_l3",
    "category_id",
    "supplier_id",
    "business_unit",
    "cost_center_id",
    "on_contract",
    "maverick_flag",
)


def _mean(column: str) -> Column:
    return as_double(F.sum(column)) / F.nullif(F.count(column).cast("double"), F.lit(0.0))


def line_count(rows: DataFrame) -> Column:
    """Lines of a group, of lines or of sums over lines that count them in `lines`."""
    return F.sum("lines") if "lines" in rows.columns else F.count("*")


def spend_cube(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*CUBE_KEYS).agg(
        F.sum("qty").alias("volume"),
        F.sum("invoice_amount").alias("spend"),
        F.sum("po_amount").alias("po_spend"),
        F.sum("contracted_amount").alias("contracted_spend"),
        F.sum("should_cost_amount").alias("should_cost_spend"),
        F.sum("price_variance").alias("rate_leakage"),
        F.sum("should_cost_gap").alias("should_cost_gap"),
        F.sum("savings_realized").alias("savings_realized"),
        F.sum("tco_amount").alias("tco_spend"),
        F.count("*").alias("invoice_lines"),
        _mean("actual_unit_price").alias("avg_unit_price"),
        _mean("contracted_unit_price").alias("avg_contract_price"),
    )


def _monthly_measures() -> dict[str, Column]:
    amount = F.col("invoice_amount")
    return {
        "total_spend": F.sum(amount),
        "direct_spend": sum_if(F.col("spend_type") == "Direct", amount),
        "indirect_spend": sum_if(F.col("spend_type") == "Indirect", amount),
        "on_contract_spend": sum_if(F.col("on_contract"), amount),
        "off_contract_spend": sum_if(~F.col("on_contract"), amount),
        "maverick_spend": sum_if(F.col("maverick_flag"), amount),
        "rate_leakage": F.sum("price_variance"),
        "should_cost_gap": F.sum("should_cost_gap"),
        "savings_realized": F.sum("savings_realized"),
        "tco_spend": F.sum("tco_amount"),
    }


def monthly_sums(rows: DataFrame) -> DataFrame:
    """The monthly view without its distinct counts, from lines or from sums over lines."""
    return rows.groupBy("period_month").agg(*[m.alias(name) for name, m in _monthly_measures().items()])


def mart_monthly_executive(fact: DataFrame) -> DataFrame:
    """Lines are summed per month, supplier and category first; suppliers and categories of a month
    are then counted on those sums, so no line is copied for a distinct count."""
    measures = _monthly_measures()
    sums = fact.groupBy("period_month", "supplier_id", "category_id").agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    return (
        sums.groupBy("period_month")
        .agg(
            *[F.sum(name).alias(name) for name in measures],
            F.countDistinct("supplier_id").alias("active_suppliers"),
            F.countDistinct("category_id").alias("active_categories"),
        )
        .orderBy(F.asc_nulls_last("period_month"))
    )


def mart_supplier_performance(fact: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Spend, leakage and compliance per supplier with any invoice line.

    Lines are summed per supplier before the supplier attributes come in, so the join moves one
    row per supplier and a supplier with a third of all lines is folded map-side.
    """
    amount = F.col("invoice_amount")
    sums = fact.groupBy("supplier_id").agg(
        F.sum(amount).alias("total_spend"),
        F.sum("price_variance").alias("rate_leakage"),
        F.sum("should_cost_gap").alias("should_cost_gap"),
        sum_if(F.col("on_contract"), amount).alias("covered"),
        sum_if(F.col("maverick_flag"), amount).alias("maverick_spend"),
        line_count(fact).alias("invoice_lines"),
    )
    return sums.join(suppliers, "supplier_id").select(
        "supplier_id",
        "supplier_name",
        "supplier_tier",
        "supplier_country",
        "diversity_flag",
        "total_spend",
        "rate_leakage",
        "should_cost_gap",
        ratio(F.col("covered"), F.col("total_spend")).alias("contract_compliance_rate"),
        "maverick_spend",
        as_double(F.col("on_time_delivery_hist")).alias("otd_rate"),
        as_double(F.col("quality_ppm_hist")).alias("quality_ppm"),
        "invoice_lines",
    )


def category_sums(rows: DataFrame) -> DataFrame:
    """The category mart without its distinct count, from lines or from sums over lines."""
    amount = F.col("invoice_amount")
    return rows.groupBy("spend_type", "category_l2", "category_l3", "category_id").agg(*_category_measures(amount))


def _category_measures(amount: Column) -> list[Column]:
    return [
        F.sum(amount).alias("total_spend"),
        F.sum("price_variance").alias("rate_leakage"),
        F.sum("should_cost_gap").alias("should_cost_gap"),
        F.sum("savings_realized").alias("savings_realized"),
        ratio(sum_if(F.col("on_contract"), amount), F.sum(amount)).alias("contract_compliance_rate"),
    ]


def mart_category_spend(fact: DataFrame) -> DataFrame:
    return fact.groupBy("spend_type", "category_l2", "category_l3", "category_id").agg(
        *_category_measures(F.col("invoice_amount")),
        F.countDistinct("supplier_id").alias("supplier_count"),
    )


def mart_finance_alignment(
    gl_actuals: DataFrame, cost_centers: DataFrame, categories: DataFrame
) -> DataFrame:
    """Ledger actuals against budget and forecast. Postings are summed on their own keys first;
    cost-centre and category names are looked up for the sums."""
    keys = ("gl_period", "cost_center_id", "category_id", "gl_account")
    sums = gl_actuals.groupBy(*keys).agg(
        F.sum("actual_amount").alias("actual_amount"),
        F.sum("budget_amount").alias("budget_amount"),
        F.sum("forecast_amount").alias("forecast_amount"),
    )
    centers = cost_centers.select("cost_center_id", "cost_center_name", "business_unit")
    levels = categories.select("category_id", "category_l1", "category_l3")
    return (
        sums.join(centers, "cost_center_id", "left")
        .join(levels, "category_id", "left")
        .select(
            "gl_period",
            "cost_center_id",
            "cost_center_name",
            "business_unit",
            "category_id",
            "category_l1",
            "category_l3",
            "gl_account",
            "actual_amount",
            "budget_amount",
            "forecast_amount",
            (F.col("actual_amount") - F.col("budget_amount")).alias("budget_variance"),
        )
    )


def spend_under_management(fact: DataFrame) -> DataFrame:
    """Spend and covered spend by spend type, with the covered share in percent."""
    amount = F.col("invoice_amount")
    return (
        fact.groupBy("spend_type")
        .agg(
            F.sum(amount).alias("spend"),
            sum_if(F.col("on_contract"), amount).alias("on_contract_spend"),
        )
        .withColumn(
            "compliance_pct",
            percent(F.col("on_contract_spend"), F.col("spend"), 2),
        )
    )


def top_leakage_suppliers(fact: DataFrame, suppliers: DataFrame, limit: int = 50) -> DataFrame:
    """Supplier names and tiers with positive total leakage, largest first."""
    sums = fact.groupBy("supplier_id").agg(
        F.sum("price_variance").alias("leaked"), F.sum("invoice_amount").alias("paid")
    )
    return (
        sums.join(suppliers.select("supplier_id", "supplier_name", "supplier_tier"), "supplier_id")
        .groupBy("supplier_name", "supplier_tier")
        .agg(F.sum("leaked").alias("leaked"), F.sum("paid").alias("paid"))
        .where("leaked > 0")
        .select(
            "supplier_name",
            "supplier_tier",
            F.round("leaked", 2).alias("rate_leakage"),
            F.round("paid", 2).alias("spend"),
        )
        .orderBy(F.desc_nulls_last("rate_leakage"), "supplier_name", "supplier_tier")
        .limit(limit)
    )
