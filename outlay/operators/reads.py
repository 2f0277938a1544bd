"""Parameterised reads of the data products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import as_double, half_up, percent, ratio, sum_if
from outlay.functions.relations import constants_stacked
from outlay.operators.pvm import latest_month

# Row limits of the reads.
CUBE_LIMIT = 200
VARIANCE_LIMIT, TCO_LIMIT, PVM_LIMIT = 100, 25, 20
LEAKAGE_LIMIT, ANOMALY_LIMIT, TOP_LEAK_LIMIT = 25, 50, 15


def kpi_executive(monthly: DataFrame, fact: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row of headline figures.

    The year-on-year change compares the last month with the 13th row from the end, and is null
    with fewer rows or a zero there. Covered spend counts credit memos, the total does not.
    """
    zero = F.lit(0).cast("decimal(1,0)")
    series = F.sort_array(
        F.collect_list(F.struct("period_month", "total_spend")), asc=False
    )  # one entry per month
    months = monthly.agg(
        *[
            F.coalesce(F.sum(c), zero).alias(c)
            for c in ("total_spend", "rate_leakage", "maverick_spend")
        ],
        series.alias("series"),
    )
    amount = F.col("invoice_amount")
    lines = fact.agg(
        sum_if(F.col("contract_id").isNotNull(), amount).alias("covered"),
        sum_if(amount >= 0, amount).alias("billed"),
        F.count(F.when(amount >= 0, 1)).alias("transactions"),
    )
    latest = as_double(F.try_element_at("series", F.lit(1))["total_spend"])
    prior = as_double(F.try_element_at("series", F.lit(13))["total_spend"])
    totals = lines.select(F.struct("covered", "billed", "transactions")).scalar()
    return months.withColumn("lines", totals).select(
        "total_spend",
        half_up((latest - prior) / F.nullif(prior, F.lit(0.0)) * 100.0, 2).alias("yoy_change_pct"),
        F.coalesce(percent(F.col("lines.covered"), F.col("lines.billed"), 2), F.lit(0.0)).alias(
            "contract_compliance_pct"
        ),
        "rate_leakage",
        "maverick_spend",
        suppliers.agg(F.count("*")).scalar().alias("supplier_count"),
        F.col("lines.transactions").alias("transaction_count"),
    )


def read_spend_cube(
    cube: DataFrame, direct_or_indirect: str | None = None, limit: int = CUBE_LIMIT
) -> DataFrame:
    if direct_or_indirect:
        cube = cube.where(F.col("direct_or_indirect") == direct_or_indirect)
    return (
        cube.orderBy(
            F.desc_nulls_first("spend"), "period_month", "supplier_id", "category_id", "cost_center"
        )
        .limit(limit)
        .select(
            "period_month",
            "supplier_name",
            "category_name",
            "parent_category",
            "direct_or_indirect",
            "cost_center",
            "txn_count",
            "volume",
            "spend",
        )
    )


def read_price_variance(
    variance: DataFrame, flagged_only: bool = True, limit: int = VARIANCE_LIMIT
) -> DataFrame:
    rows = variance.where("variance_flag") if flagged_only else variance
    return (
        rows.orderBy(
            F.desc_nulls_last("leakage_amount"),
            "transaction_id",
            "supplier_id",
            "actual_rate",
            "negotiated_rate",
        )
        .limit(limit)
        .select(
            "spend_date",
            "supplier_name",
            "category_name",
            "po_number",
            "negotiated_rate",
            "actual_rate",
            "variance_pct",
            "leakage_amount",
            "variance_flag",
        )
    )


def read_executive_monthly(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "period_month",
        "total_spend",
        "direct_spend",
        "indirect_spend",
        "rate_leakage",
        "maverick_spend",
        "txn_count",
    ).orderBy(F.asc_nulls_last("period_month"))


def read_pvm_latest(pvm: DataFrame, limit: int = PVM_LIMIT) -> DataFrame:
    return (
        latest_month(pvm, "category_id")
        .orderBy(F.abs("spend_change").desc_nulls_first(), "category_id")
        .limit(limit)
        .select(
            "category_name",
            "direct_or_indirect",
            "spend",
            "spend_change",
            "price_effect",
            "volume_effect",
            "mix_effect",
        )
    )


def read_tco(tco: DataFrame, limit: int = TCO_LIMIT) -> DataFrame:
    return (
        tco.orderBy(F.desc_nulls_first("tco"), "supplier_id")
        .limit(limit)
        .select(
            "supplier_name",
            "risk_tier",
            "region",
            "invoice_spend",
            "risk_quality_cost",
            "switching_cost_est",
            "tco",
        )
    )


def kpi_marts(monthly: DataFrame) -> DataFrame:
    """Totals over the monthly mart with the compliance share in percent."""
    return monthly.agg(
        F.sum("total_spend").alias("total_spend"),
        F.sum("rate_leakage").alias("rate_leakage"),
        F.sum("maverick_spend").alias("maverick_spend"),
        (ratio(F.sum("on_contract_spend"), F.sum("total_spend")) * 100.0).alias("compliance_pct"),
        F.sum("savings_realized").alias("savings_realized"),
        F.sum("should_cost_gap").alias("should_cost_gap"),
    )


def leak_top_suppliers(variance_rows: DataFrame, limit: int = TOP_LEAK_LIMIT) -> DataFrame:
    """Leakage per supplier name over the given variance rows, largest first."""
    return (
        variance_rows.groupBy("supplier_name")
        .agg(F.sum("leakage_amount").alias("leakage_amount"))
        .orderBy(F.desc_nulls_last("leakage_amount"), "supplier_name")
        .limit(limit)
    )


def pvm_bridge(
    effects: DataFrame, labels: tuple[str, str, str] = ("Price", "Volume", "Mix")
) -> DataFrame:
    """Three bridge rows, each also carrying the net change."""
    names = ("price_effect", "volume_effect", "mix_effect")
    wide = "decimal(38,6)"
    sums = effects.agg(
        *[F.sum(n).cast(wide).alias(n) for n in names],
        F.sum("spend_change").alias("net_change"),
    )
    rows = [(label, F.col(name), F.col("net_change")) for label, name in zip(labels, names)]
    return constants_stacked(sums, rows, ("component", "usd", "net_change"))


def category_listing(categories: DataFrame) -> DataFrame:
    return categories.orderBy(F.desc_nulls_last("total_spend"), "category_id").select(
        "spend_type",
        "category_l2",
        "category_l3",
        "total_spend",
        "rate_leakage",
        "should_cost_gap",
        "contract_compliance_rate",
        "supplier_count",
    )


def hierarchy_rollup(
    rows: DataFrame, levels: tuple[str, str, str], size: str, colour: str
) -> DataFrame:
    """Every node of a three-level hierarchy: its size, and the size-weighted mean of `colour`.

    A node's level is the number of hierarchy columns it has; the grand total is level 0.
    """
    weight = F.col(size).cast("decimal(19,2)") * F.col(colour).cast("decimal(19,4)")
    missing = sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return (
        rows.withColumn("_weighted", weight)
        .rollup(*levels)
        .agg(
            (F.lit(len(levels)) - missing).cast("bigint").alias("level"),
            F.sum(size).alias("node_size"),
            half_up(ratio(F.sum("_weighted"), F.sum(size)), 2).alias("node_colour"),
        )
    )


def hierarchy_rollup_dk(categories: DataFrame) -> DataFrame:
    return hierarchy_rollup(
        categories, ("spend_type", "category_l2", "category_l3"), "total_spend", "rate_leakage"
    )


def hierarchy_rollup_pg(cube: DataFrame) -> DataFrame:
    levels = ("direct_or_indirect", "parent_category", "category_name")
    leaves = cube.groupBy(*levels).agg(F.sum("spend").alias("spend"))
    return hierarchy_rollup(leaves, levels, "spend", "spend")


def opportunity_ranked(opportunity: DataFrame) -> DataFrame:
    return opportunity.orderBy(F.desc_nulls_last("opportunity_usd"), "opportunity_type")


def tco_ranked(tco: DataFrame) -> DataFrame:
    return tco.orderBy(F.desc_nulls_last("tco"), "spend_type", "category_l3")


def leakage_top25(leakage: DataFrame, limit: int = LEAKAGE_LIMIT) -> DataFrame:
    return (
        leakage.orderBy(F.desc_nulls_last("rate_leakage"), "supplier_id", "spend_type", "category_l3")
        .limit(limit)
        .select(
            "supplier_name",
            "category_l3",
            "spend",
            "rate_leakage",
            "should_cost_gap",
            "maverick_spend",
            "leakage_rate_pct",
        )
    )


def pvm_latest_ranked(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.abs("spend_change").desc_nulls_last(), "spend_type", "category_l3")


def risk_ranked(risk: DataFrame) -> DataFrame:
    return risk.orderBy(F.desc_nulls_last("supplier_risk_score"), "supplier_id").select(
        "supplier_name",
        "supplier_tier",
        "supplier_country",
        "risk_tier",
        "supplier_risk_score",
        "total_spend",
        "rate_leakage",
        "contract_compliance_rate",
        "otd_rate",
        "quality_ppm",
    )


def anomaly_top50(anomalies: DataFrame, limit: int = ANOMALY_LIMIT) -> DataFrame:
    return (
        anomalies.where("is_anomaly")
        .orderBy(F.desc_nulls_last("anomaly_score"), "invoice_id", "invoice_line")
        .limit(limit)
        .select(
            "invoice_id",
            "invoice_date",
            "supplier_id",
            "category_l3",
            "invoice_amount",
            "price_variance",
            "anomaly_score",
        )
    )


def finance_bu_rollup(finance: DataFrame) -> DataFrame:
    measures = {
        "actual": "actual_amount",
        "budget": "budget_amount",
        "forecast": "forecast_amount",
        "budget_variance": "budget_variance",
    }
    aggs: list[Column] = [F.sum(source).alias(name) for name, source in measures.items()]
    return (
        finance.groupBy("gl_period", "business_unit")
        .agg(*aggs)
        .orderBy(F.asc_nulls_last("gl_period"), F.asc_nulls_last("business_unit"))
    )
