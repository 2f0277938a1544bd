"""Gold layer: dimensions, calendar and the invoice-line spend fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import MONEY
from outlay.functions.relations import lookup, unique_by


def dim_supplier(suppliers: DataFrame) -> DataFrame:
    return suppliers.select(
        "supplier_id",
        "supplier_name",
        F.col("country").alias("supplier_country"),
        F.col("tier").alias("supplier_tier"),
        "primary_category_id",
        "payment_terms_days",
        "diversity_flag",
        "active_flag",
        "potential_duplicate_flag",
        "risk_score_seed",
        "on_time_delivery_hist",
        "quality_ppm_hist",
    )


def dim_category(categories: DataFrame) -> DataFrame:
    return categories.select(
        "category_id",
        "category_code",
        F.col("category_l1").alias("spend_type"),
        "category_l1",
        "category_l2",
        "category_l3",
        "unspsc_stub",
    )


def dim_contract(contracts: DataFrame) -> DataFrame:
    return contracts.select(
        "contract_id",
        "supplier_id",
        "category_id",
        "contract_name",
        "start_date",
        "end_date",
        F.col("status").alias("contract_status"),
        F.col("unit_price").alias("contracted_rate"),
        "volume_commitment",
        "rebate_pct",
        "escalation_pct",
    )


def dim_cost_center(cost_centers: DataFrame) -> DataFrame:
    return cost_centers.select("*")


def dim_calendar(invoices: DataFrame) -> DataFrame:
    """Every day from the first to the last invoice date; fiscal periods follow the calendar."""
    return calendar(invoices.agg(F.min("invoice_date").alias("first"), F.max("invoice_date").alias("last")))


def calendar(span: DataFrame) -> DataFrame:
    """The days of a span, one row with `first` and `last`."""
    days = span.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("calendar_date")
    )
    return days.select(
        F.date_format("calendar_date", "yyyyMMdd").cast("int").alias("date_key"),
        "calendar_date",
        F.trunc("calendar_date", "MM").alias("month_start"),
        F.year("calendar_date").alias("fiscal_year"),
        F.quarter("calendar_date").alias("fiscal_quarter"),
        F.month("calendar_date").alias("fiscal_month"),
        F.date_format("calendar_date", "yyyy-MM").alias("year_month"),
    )


def order_amounts(purchase_orders: DataFrame) -> DataFrame:
    """One ordered amount per purchase-order line, so a repeated line cannot multiply invoices."""
    return purchase_orders.groupBy("po_id", "po_line").agg(
        F.sum("po_amount").cast(MONEY).alias("ordered")
    )


def category_levels(categories: DataFrame) -> DataFrame:
    """One row per category with its three levels, the first as spend_type."""
    levels = categories.select(
        "category_id", F.col("category_l1").alias("spend_type"), "category_l2", "category_l3"
    )
    return unique_by(levels, "category_id")


def order_key() -> Column:
    """The purchase order of an invoice line. Lines without one would all meet under their null key;
    they are spread by invoice number instead, under a key no order can have."""
    return F.coalesce(F.col("po_id"), F.concat(F.lit("\u0000"), F.col("invoice_id")))


def fact_spend(invoices: DataFrame, purchase_orders: DataFrame, levels: DataFrame) -> DataFrame:
    """Invoice lines with the ordered amount, the category levels and the derived amounts.

    Both joined sides are unique on their key, so products that read none of their columns skip the
    join.
    """
    with_order = lookup(
        invoices,
        order_amounts(purchase_orders),
        {"po_id": order_key(), "po_line": F.col("invoice_line")},
    )
    return _fact(with_order, levels)


#: What the fact takes over from invoice lines.
INVOICE_COLUMNS = (
    "invoice_id",
    "invoice_line",
    "invoice_date",
    "period_month",
    "po_id",
    "supplier_id",
    "category_id",
    "contract_id",
    "cost_center_id",
    "business_unit",
    "qty",
    "actual_unit_price",
    "contracted_unit_price",
    "baseline_unit_price",
    "should_cost_unit",
    "invoice_amount",
    "savings_realized",
    "freight_cost",
    "quality_cost",
    "payment_terms_cost",
    "tco_amount",
    "on_contract",
    "maverick_flag",
    "payment_status",
)

#: What both sides of the co-located join are bucketed on.
ORDER_BUCKETS = ("order_key", "order_line")


def invoices_for_orders(invoices: DataFrame) -> DataFrame:
    """What the fact holds of invoice lines, with the columns that `colocated_fact` joins on, to be stored
    in buckets. The key of a line that has an order is the order's number, which is not stored twice."""
    columns = [c for c in INVOICE_COLUMNS if c not in ("po_id", "invoice_line")]
    return invoices.select(
        order_key().alias("order_key"),
        F.col("invoice_line").alias("order_line"),
        F.col("po_id").isNotNull().alias("has_order"),
        *columns,
    )


def orders_for_invoices(purchase_orders: DataFrame) -> DataFrame:
    """Order lines by the same columns, to be stored in as many buckets."""
    return purchase_orders.select(
        F.col("po_id").alias("order_key"), F.col("po_line").alias("order_line"), "po_amount"
    )


def colocated_fact(invoices: DataFrame, orders: DataFrame, levels: DataFrame) -> DataFrame:
    """The fact from sides that are stored in equal buckets of the order line: neither is exchanged.

    A bucket is read by one task, so an order line with a large share of all invoices is better
    joined by `fact_spend`, which splits it.
    """
    ordered = orders.groupBy(*ORDER_BUCKETS).agg(F.sum("po_amount").cast(MONEY).alias("ordered"))
    joined = invoices.join(ordered, list(ORDER_BUCKETS), "left").withColumns(
        {"po_id": F.when(F.col("has_order"), F.col("order_key")), "invoice_line": F.col("order_line")}
    )
    return _fact(joined, levels)


def _fact(with_order: DataFrame, levels: DataFrame) -> DataFrame:
    joined = lookup(with_order, levels, {"category_id": F.col("category_id")})
    qty, paid = F.col("qty"), F.col("actual_unit_price")
    return joined.select(
        "invoice_id",
        "invoice_line",
        "invoice_date",
        F.date_format("invoice_date", "yyyyMMdd").cast("int").alias("date_key"),
        "period_month",
        "po_id",
        "supplier_id",
        "category_id",
        "contract_id",
        "cost_center_id",
        "business_unit",
        "qty",
        "actual_unit_price",
        "contracted_unit_price",
        "baseline_unit_price",
        "should_cost_unit",
        "invoice_amount",
        F.coalesce("ordered", F.lit(0).cast(MONEY)).alias("po_amount"),
        (F.col("contracted_unit_price") * qty).alias("contracted_amount"),
        (F.col("should_cost_unit") * qty).alias("should_cost_amount"),
        ((paid - F.col("contracted_unit_price")) * qty).alias("price_variance"),
        ((paid - F.col("should_cost_unit")) * qty).alias("should_cost_gap"),
        "savings_realized",
        "freight_cost",
        "quality_cost",
        "payment_terms_cost",
        "tco_amount",
        "on_contract",
        "maverick_flag",
        "payment_status",
        "spend_type",
        "category_l2",
        "category_l3",
    )
