"""Rate leakage, total cost of ownership and the savings opportunity stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import ratio, sum_if
from outlay.functions.relations import constants_stacked

# Action text of each opportunity type.
PLAYBOOKS = {
    "rate_leakage": "Bridge paid unit price to contracted rate",
    "should_cost_gap": "Renegotiate or redesign where actual > should-cost",
    "maverick_spend": "Route off-PO spend to preferred suppliers / catalogs",
    "off_contract_spend": "Increase contract coverage and enablement",
}


def leakage(fact: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Supplier by category leakage where spend is positive; rates are fractions.

    A line whose contract flag is unknown counts as off contract here. Lines are summed per
    supplier and category before supplier names are joined.
    """
    amount = F.col("invoice_amount")
    covered = F.coalesce(F.col("on_contract"), F.lit(False))
    sums = (
        fact.groupBy("supplier_id", "spend_type", "category_l3")
        .agg(
            F.sum(amount).alias("spend"),
            F.sum("price_variance").alias("rate_leakage"),
            F.sum("should_cost_gap").alias("should_cost_gap"),
            F.sum(
                F.when(F.col("maverick_flag"), amount).when(
                    ~F.col("maverick_flag"), F.lit(0).cast("decimal(1,0)")
                )
            ).alias("maverick_spend"),
            sum_if(~covered, amount).alias("off_contract_spend"),
        )
        .where("spend > 0")
    )
    names = suppliers.select("supplier_id", "supplier_name", "supplier_tier")
    return (
        sums.join(names, "supplier_id")
        .select(
            "supplier_id",
            "supplier_name",
            "supplier_tier",
            "spend_type",
            "category_l3",
            "spend",
            "rate_leakage",
            "should_cost_gap",
            "maverick_spend",
            "off_contract_spend",
            ratio(F.col("rate_leakage"), F.col("spend")).alias("leakage_rate_pct"),
            ratio(F.col("should_cost_gap"), F.col("spend")).alias("should_cost_gap_pct"),
        )
        .orderBy(F.desc_nulls_last("rate_leakage"))
    )


def tco(fact: DataFrame) -> DataFrame:
    """Invoice spend and the cost on top of it by category; the uplift share is a fraction."""
    return (
        fact.groupBy("spend_type", "category_l3")
        .agg(
            F.sum("invoice_amount").alias("invoice_spend"),
            F.sum("freight_cost").alias("freight"),
            F.sum("quality_cost").alias("quality"),
            F.sum("payment_terms_cost").alias("payment_terms"),
            F.sum("tco_amount").alias("tco"),
        )
        .withColumn("tco_uplift", F.col("tco") - F.col("invoice_spend"))
        .withColumn("tco_uplift_pct", ratio(F.col("tco_uplift"), F.col("invoice_spend")))
        .orderBy(F.desc_nulls_last("tco"))
    )


def opportunity(fact: DataFrame) -> DataFrame:
    """Four savings levers with their amounts, from one pass over the fact, or over sums that hold what
    is above zero line by line."""
    amount = F.col("invoice_amount")
    wide = "decimal(38,6)"

    def above_zero(summed: str, measure: str) -> Column:
        if summed in fact.columns:
            return F.coalesce(F.sum(summed), F.lit(0).cast("decimal(1,0)"))
        return sum_if(F.col(measure) > 0, F.col(measure))

    levers = {
        "rate_leakage": above_zero("leakage_above_zero", "price_variance"),
        "should_cost_gap": above_zero("gap_above_zero", "should_cost_gap"),
        "maverick_spend": sum_if(F.col("maverick_flag"), amount),
        "off_contract_spend": sum_if(~F.col("on_contract"), amount),
    }
    totals = fact.agg(*[expr.cast(wide).alias(name) for name, expr in levers.items()])
    return constants_stacked(
        totals,
        [(name, F.col(name), text) for name, text in PLAYBOOKS.items()],
        ("opportunity_type", "opportunity_usd", "playbook"),
    )
