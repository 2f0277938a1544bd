"""Silver layer: cleansed and conformed extracts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import MONEY, RATE
from outlay.functions.relations import lookup
from outlay.sources.schemas import EXTRACTS

# Fixed values.
SPEND_TYPES = ("Direct", "Indirect")
KEY_NOISE = "[^A-Z0-9]"


def name_key(strict: bool = False) -> Column:
    """Matching key of a supplier name or alias. The default strips all but capitals and
    digits before upper-casing, so lower-case letters do not count; strict upper-cases first."""
    name = F.coalesce(F.col("supplier_name_alias"), F.col("supplier_name"))
    if strict:
        return F.regexp_replace(F.upper(name), KEY_NOISE, "")
    return F.upper(F.regexp_replace(name, KEY_NOISE, ""))


def silver_suppliers(bronze: DataFrame, strict: bool = False) -> DataFrame:
    """Trimmed suppliers with their name key; keys held by several suppliers are flagged.

    The repeated keys are counted first and joined back, so a key shared by many suppliers
    (an empty one, say) is one row on the counting side and no supplier meets another.
    """
    base = (
        bronze.where(F.col("supplier_id").isNotNull() & F.col("supplier_name").isNotNull())
        .withColumn("name_key", name_key(strict))
        .withColumn("supplier_name", F.trim("supplier_name"))
        .select(
            "supplier_id",
            "supplier_name",
            "supplier_name_alias",
            "name_key",
            "country",
            "tier",
            "primary_category_id",
            "payment_terms_days",
            F.col("diversity_flag").cast("boolean").alias("diversity_flag"),
            F.col("active_flag").cast("boolean").alias("active_flag"),
            "risk_score_seed",
            "on_time_delivery_hist",
            "quality_ppm_hist",
            "_loaded_at_utc",
        )
    )
    repeated = (
        base.groupBy("name_key")
        .agg(F.count("*").alias("holders"))
        .where("holders > 1")
        .select("name_key", F.lit(True).alias("repeated"))
    )
    flagged = lookup(base, repeated, {"name_key": F.col("name_key")})
    return flagged.select(
        *base.columns, F.coalesce("repeated", F.lit(False)).alias("potential_duplicate_flag")
    )


def silver_categories(bronze: DataFrame) -> DataFrame:
    return bronze.where(F.col("category_id").isNotNull()).select(
        *EXTRACTS["categories"][1].names,
        F.col("category_l1").isin(*SPEND_TYPES).alias("hierarchy_valid"),
    )


def silver_contracts(bronze: DataFrame, as_of: dt.date) -> DataFrame:
    """Contracts with a positive price; status follows from the dates at `as_of`."""
    today = F.lit(as_of).cast("date")
    dated = bronze.where(F.col("unit_price") > 0).select(
        *[
            F.col(c).cast("date").alias(c) if c in ("start_date", "end_date") else F.col(c)
            for c in EXTRACTS["contracts"][1].names
        ]
    )
    stated = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("Active"))
    return dated.withColumn(
        "status",
        F.when(F.col("end_date") < today, "Expired")
        .when(F.col("start_date") > today, "Future")
        .otherwise(stated),
    ).withColumn("unit_price", F.col("unit_price").cast(RATE))


def silver_should_cost(bronze: DataFrame) -> DataFrame:
    return bronze.select(*EXTRACTS["should_cost"][1].names)


def silver_cost_centers(bronze: DataFrame) -> DataFrame:
    return bronze.select("*")


def silver_purchase_orders(bronze: DataFrame) -> DataFrame:
    kept = bronze.where((F.col("qty") > 0) & (F.col("unit_price") >= 0))
    types = {"po_date": "date", "qty": MONEY, "unit_price": RATE, "po_amount": MONEY}
    return kept.select(
        *[
            F.col(c).cast(types[c]).alias(c) if c in types else F.col(c)
            for c in EXTRACTS["purchase_orders"][1].names
        ]
    )


def silver_invoices(bronze: DataFrame) -> DataFrame:
    """Invoices that have an amount and either a purchase order or the maverick flag."""
    flag = F.col("maverick_flag").cast("boolean")
    kept = bronze.where(F.col("invoice_amount").isNotNull() & (F.col("po_id").isNotNull() | flag))
    day = F.col("invoice_date").cast("date")
    return kept.select(
        "invoice_id",
        "invoice_line",
        day.alias("invoice_date"),
        "po_id",
        "supplier_id",
        "category_id",
        "contract_id",
        "cost_center_id",
        "business_unit",
        F.col("qty").cast(MONEY).alias("qty"),
        F.col("unit_price").cast(RATE).alias("actual_unit_price"),
        F.col("invoice_amount").cast(MONEY).alias("invoice_amount"),
        "currency",
        "payment_status",
        flag.alias("maverick_flag"),
        F.col("contracted_unit_price").cast(RATE).alias("contracted_unit_price"),
        F.col("baseline_unit_price").cast(RATE).alias("baseline_unit_price"),
        F.col("should_cost_unit").cast(RATE).alias("should_cost_unit"),
        *[
            F.col(c).cast(MONEY).alias(c)
            for c in (
                "savings_realized",
                "freight_cost",
                "quality_cost",
                "payment_terms_cost",
                "tco_amount",
            )
        ],
        F.col("on_contract").cast("boolean").alias("on_contract"),
        F.trunc(day, "MM").alias("period_month"),
    )


def silver_gl_actuals(bronze: DataFrame) -> DataFrame:
    amounts = ("actual_amount", "budget_amount", "forecast_amount")
    return bronze.select(
        "gl_period",
        "cost_center_id",
        "category_id",
        "gl_account",
        *[F.col(c).cast(MONEY).alias(c) for c in amounts],
    )
