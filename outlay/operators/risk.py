"""Composite supplier risk: operational, commercial and concentration, ranked over all suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import as_double, ratio
from outlay.functions.ordering import percent_rank, quantile_at, value_positions
from outlay.functions.relations import lookup
from outlay.sources.storage import written

# Defaults for unknown history, caps and weights of the score.
DEFAULT_OTD, DEFAULT_PPM, DEFAULT_COMPLIANCE, SPEND_FLOOR = 0.9, 300.0, 0.5, 1.0
PPM_CAP, SHARE_CAP, LEAKAGE_GAIN, MAVERICK_GAIN = 800.0, 0.10, 4.0, 2.0
OTD_WEIGHT, QUALITY_WEIGHT = 0.55, 0.45
LEAKAGE_WEIGHT, COMPLIANCE_WEIGHT, MAVERICK_WEIGHT = 0.4, 0.35, 0.25
OPERATIONAL_WEIGHT, COMMERCIAL_WEIGHT, CONCENTRATION_WEIGHT = 0.30, 0.50, 0.20
LOW_UP_TO, MEDIUM_UP_TO = 0.5, 0.8


def _clip(col: Column) -> Column:
    """Into [0, 1]; null stays null."""
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.least(col, F.lit(1.0))))


def supplier_spend_share(performance: DataFrame) -> DataFrame:
    """Add each supplier's share of all spend. The total is a scalar, not a one-task window."""
    total = performance.agg(F.sum("total_spend")).scalar()
    return performance.withColumn("spend_share", ratio(F.col("total_spend"), total))


def supplier_risk_components(performance: DataFrame) -> DataFrame:
    spend = F.greatest(as_double(F.col("total_spend")), F.lit(SPEND_FLOOR))
    late = 1.0 - F.coalesce("otd_rate", F.lit(DEFAULT_OTD))
    defects = _clip(F.coalesce("quality_ppm", F.lit(DEFAULT_PPM)) / PPM_CAP)
    leaked = F.greatest(F.coalesce(as_double(F.col("rate_leakage")), F.lit(0.0)), F.lit(0.0))
    overpaid = _clip(leaked / spend * LEAKAGE_GAIN)
    stray = _clip(
        F.coalesce(as_double(F.col("maverick_spend")), F.lit(0.0)) / spend * MAVERICK_GAIN
    )
    uncovered = 1.0 - _clip(F.coalesce("contract_compliance_rate", F.lit(DEFAULT_COMPLIANCE)))
    return (
        supplier_spend_share(performance)
        .withColumn("risk_operational", OTD_WEIGHT * late + QUALITY_WEIGHT * defects)
        .withColumn(
            "risk_commercial",
            LEAKAGE_WEIGHT * overpaid + COMPLIANCE_WEIGHT * uncovered + MAVERICK_WEIGHT * stray,
        )
        .withColumn("risk_concentration", _clip(F.col("spend_share") / SHARE_CAP))
    )


def supplier_risk(performance: DataFrame) -> DataFrame:
    """Components, the average-rank percentile of their weighted sum, and a tier by quantiles.

    The per-supplier sums and scores are written once each: shares read the sums twice and ranks
    read the scores several times, and neither must go back to the fact.
    """
    raw = (
        OPERATIONAL_WEIGHT * F.col("risk_operational")
        + COMMERCIAL_WEIGHT * F.col("risk_commercial")
        + CONCENTRATION_WEIGHT * F.col("risk_concentration")
    )
    sums = written(performance, "supplier-sums")
    scored = written(
        supplier_risk_components(sums).withColumn("_raw", _clip(raw)), "supplier-scores"
    )
    ranked = value_positions(scored, "_raw").withColumn("supplier_risk_score", percent_rank())
    cuts = ranked.agg(
        F.struct(
            quantile_at("supplier_risk_score", LOW_UP_TO).alias("low"),
            quantile_at("supplier_risk_score", MEDIUM_UP_TO).alias("medium"),
        )
    ).scalar()
    score = F.col("supplier_risk_score")
    return (
        lookup(scored, ranked.select("_raw", "supplier_risk_score"), {"_raw": F.col("_raw")})
        .withColumn("_cuts", cuts)
        .withColumn(
            "risk_tier",
            F.when(score <= F.col("_cuts.low"), "Low")
            .when(score <= F.col("_cuts.medium"), "Medium")
            .when(score.isNotNull(), "High"),
        )
        .drop("_raw", "_cuts")
        .orderBy(F.desc_nulls_last("supplier_risk_score"))
    )
