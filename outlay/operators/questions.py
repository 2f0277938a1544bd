"""Curated answers to governed questions.

`mart_*` answers read the gold marts, `view_*` answers the governed views of the star schema.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.functions.numeric import as_double, half_up, percent
from outlay.operators.pvm import latest_month
from outlay.operators.views import maverick_lines, variance_lines


def _sums(*columns: str) -> list[Column]:
    return [F.round(F.sum(c), 2).alias(c) for c in columns]


# ---- over the marts


def mart_total_spend(monthly: DataFrame) -> DataFrame:
    return monthly.agg(*_sums("total_spend", "direct_spend", "indirect_spend"))


def mart_maverick(monthly: DataFrame) -> DataFrame:
    share = percent(F.sum("maverick_spend"), F.sum("total_spend"), 2)
    return monthly.agg(*_sums("maverick_spend"), share.alias("maverick_pct"))


def mart_compliance(monthly: DataFrame) -> DataFrame:
    share = percent(F.sum("on_contract_spend"), F.sum("total_spend"), 2)
    return monthly.agg(
        share.alias("compliance_pct"), *_sums("on_contract_spend", "off_contract_spend")
    )


def mart_leakage(leakage: DataFrame, limit: int = 10) -> DataFrame:
    rounded = leakage.withColumn("rate_leakage", F.round("rate_leakage", 2))
    return (
        rounded.orderBy(F.desc_nulls_last("rate_leakage"), "supplier_id", "spend_type", "category_l3")
        .limit(limit)
        .select("supplier_name", "category_l3", "rate_leakage", F.round("spend", 2).alias("spend"))
    )


def mart_should_cost(categories: DataFrame, limit: int = 10) -> DataFrame:
    rounded = categories.withColumn("should_cost_gap", F.round("should_cost_gap", 2))
    return (
        rounded.orderBy(F.desc_nulls_last("should_cost_gap"), "category_id")
        .limit(limit)
        .select(
            "category_l3",
            "spend_type",
            "should_cost_gap",
            F.round("total_spend", 2).alias("spend"),
        )
    )


def mart_top_suppliers(performance: DataFrame, limit: int = 10) -> DataFrame:
    return (
        performance.orderBy(F.desc_nulls_last("total_spend"), "supplier_id")
        .limit(limit)
        .select(
            "supplier_name",
            "supplier_tier",
            F.round("total_spend", 2).alias("total_spend"),
            half_up(F.col("contract_compliance_rate") * 100.0, 1).alias("compliance_pct"),
        )
    )


def mart_direct_vs_indirect(monthly: DataFrame) -> DataFrame:
    share = percent(F.sum("direct_spend"), F.sum("total_spend"), 1)
    return monthly.agg(*_sums("direct_spend", "indirect_spend"), share.alias("direct_pct"))


def mart_savings(monthly: DataFrame) -> DataFrame:
    return monthly.agg(
        *_sums("savings_realized"), F.round(F.sum("rate_leakage"), 2).alias("rate_leakage_offset")
    )


def mart_risk(risk: DataFrame, limit: int = 10) -> DataFrame:
    return (
        risk.where(F.col("risk_tier") == "High")
        .orderBy(F.desc_nulls_last("supplier_risk_score"), "supplier_id")
        .limit(limit)
        .select(
            "supplier_name",
            "risk_tier",
            half_up(F.col("supplier_risk_score"), 3).alias("risk_score"),
            F.round("total_spend", 2).alias("total_spend"),
        )
    )


def mart_opportunity(opportunity: DataFrame) -> DataFrame:
    return opportunity.withColumn("opportunity_usd", F.round("opportunity_usd", 2)).orderBy(
        F.desc_nulls_last("opportunity_usd"), "opportunity_type"
    )


def mart_pvm(summary: DataFrame) -> DataFrame:
    return summary.agg(*_sums("price_effect", "volume_effect", "mix_effect", "spend_change"))


# ---- over the governed views


def view_total_spend(monthly: DataFrame) -> DataFrame:
    return monthly.agg(*_sums("total_spend", "direct_spend", "indirect_spend"))


def _named(sums: DataFrame, suppliers: DataFrame, categories: DataFrame) -> DataFrame:
    return sums.join(
        suppliers.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id"
    ).join(categories.select("category_id", F.col("name").alias("category_name")), "category_id")


def view_leakage(
    fact: DataFrame, suppliers: DataFrame, categories: DataFrame, limit: int = 15
) -> DataFrame:
    """Flagged variance by supplier and category name. Lines keep their own rounding; they are
    summed per key before the names are joined."""
    sums = (
        variance_lines(fact)
        .where("variance_flag")
        .groupBy("supplier_id", "category_id")
        .agg(
            F.sum("leakage_amount").alias("leaked"),
            F.sum("variance_pct").alias("pct_sum"),
            F.count("variance_pct").alias("pct_n"),
            F.count("*").alias("lines"),
        )
    )
    mean = as_double(F.sum("pct_sum")) / F.nullif(as_double(F.sum("pct_n")), F.lit(0.0))
    return (
        _named(sums, suppliers, categories)
        .groupBy("supplier_name", "category_name")
        .agg(
            F.round(F.sum("leaked"), 2).alias("leakage_amount"),
            half_up(mean, 2).alias("avg_variance_pct"),
            F.sum("lines").alias("flagged_txns"),
        )
        .orderBy(F.desc_nulls_first("leakage_amount"), "supplier_name", "category_name")
        .limit(limit)
    )


def view_maverick(
    fact: DataFrame, suppliers: DataFrame, categories: DataFrame, limit: int = 15
) -> DataFrame:
    sums = (
        maverick_lines(fact)
        .groupBy("supplier_id", "category_id")
        .agg(F.sum("invoice_amount").alias("spend"), F.count("*").alias("lines"))
    )
    return (
        _named(sums, suppliers, categories)
        .groupBy("supplier_name", "category_name")
        .agg(
            F.round(F.sum("spend"), 2).alias("maverick_spend"), F.sum("lines").alias("txn_count")
        )
        .orderBy(F.desc_nulls_first("maverick_spend"), "supplier_name", "category_name")
        .limit(limit)
    )


def view_tco(tco: DataFrame, limit: int = 15) -> DataFrame:
    return (
        tco.orderBy(F.desc_nulls_first("tco"), "supplier_id")
        .limit(limit)
        .select(
            "supplier_name",
            "risk_tier",
            "invoice_spend",
            "risk_quality_cost",
            "switching_cost_est",
            "tco",
        )
    )


def view_pvm(pvm: DataFrame) -> DataFrame:
    return latest_month(pvm, "category_id").agg(
        *_sums("price_effect", "volume_effect", "mix_effect", "spend_change")
    )


def view_top_suppliers(cube: DataFrame, limit: int = 10) -> DataFrame:
    return (
        cube.groupBy("supplier_name", "risk_tier", "region")
        .agg(*_sums("spend"))
        .orderBy(F.desc_nulls_first("spend"), "supplier_name", "risk_tier", "region")
        .limit(limit)
    )


def view_category(cube: DataFrame, limit: int = 15) -> DataFrame:
    return (
        cube.groupBy("category_name", "direct_or_indirect")
        .agg(*_sums("spend"))
        .orderBy(F.desc_nulls_first("spend"), "category_name", "direct_or_indirect")
        .limit(limit)
    )


def view_executive_trend(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "period_month",
        "total_spend",
        "direct_spend",
        "indirect_spend",
        "rate_leakage",
        "maverick_spend",
    ).orderBy(F.asc_nulls_last("period_month"))


def answer_rows(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Answers of all intents in one shape: (intent, item, field, value). The item joins a row's
    texts and dates, and every number of the row is a field."""
    parts = []
    for intent, frame in frames.items():
        numbers = [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType)]
        texts = [F.col(f.name).cast("string") for f in frame.schema if f.name not in numbers]
        values = F.array(
            *[F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("value")) for n in numbers]
        )
        parts.append(
            frame.select(F.lit(intent).alias("intent"), F.concat_ws("/", *texts).alias("item"), F.inline(values))
        )
    return reduce(DataFrame.unionByName, parts)


def answered(routed: DataFrame, answers: DataFrame) -> DataFrame:
    """Every routed question with the rows of its intent's answer, nulls where it has no intent.
    Each answer is computed once, however many questions ask for it."""
    return routed.join(answers, "intent", "left").select(
        "conv_id", "turn", "intent", "item", "field", "value"
    )
