"""Registry of governed measures, metrics and dimensions over the invoice-line fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import ratio


@dataclass(frozen=True)
class Metric:
    """Sum of `value`, or that sum over the sum of `over`."""

    value: str
    over: str | None = None


@dataclass(frozen=True)
class Dimension:
    """A column of a dimension table reached from the fact by a key."""

    table: str
    key: str
    column: str


COVERED = "case when on_contract then invoice_amount else 0 end"
UNCOVERED = "case when not on_contract then invoice_amount else 0 end"

# Definitions of the registry.
MEASURES: dict[str, Metric] = {
    "invoice_amount": Metric("invoice_amount"),
    "po_amount": Metric("po_amount"),
    "contracted_amount": Metric("qty * contracted_unit_price"),
    "volume": Metric("qty"),
    "price_variance": Metric("(actual_unit_price - contracted_unit_price) * qty"),
    "savings_realized": Metric("savings_realized"),
    "tco_amount": Metric("tco_amount"),
}
METRICS: dict[str, Metric] = {
    "total_spend": MEASURES["invoice_amount"],
    "contract_compliance_rate": Metric(COVERED, over="invoice_amount"),
    "maverick_spend_pct": Metric(UNCOVERED, over="invoice_amount"),
    "rate_leakage": MEASURES["price_variance"],
    "should_cost_gap": Metric("invoice_amount - should_cost_amount"),
}
REGISTRY: dict[str, Metric] = {**MEASURES, **METRICS}
DIMENSIONS: dict[str, Dimension] = {
    "supplier_name": Dimension("dim_supplier", "supplier_id", "supplier_name"),
    "supplier_tier": Dimension("dim_supplier", "supplier_id", "supplier_tier"),
    "supplier_country": Dimension("dim_supplier", "supplier_id", "supplier_country"),
    "category_l1": Dimension("dim_category", "category_id", "category_l1"),
    "category_l2": Dimension("dim_category", "category_id", "category_l2"),
    "category_l3": Dimension("dim_category", "category_id", "category_l3"),
    "contract_status": Dimension("dim_contract", "contract_id", "contract_status"),
    "spend_type": Dimension("dim_category", "category_id", "spend_type"),
    "cost_center": Dimension("dim_cost_center", "cost_center_id", "cost_center_name"),
    "business_unit": Dimension("dim_cost_center", "cost_center_id", "business_unit"),
    "fiscal_year": Dimension("dim_calendar", "date_key", "fiscal_year"),
    "fiscal_quarter": Dimension("dim_calendar", "date_key", "fiscal_quarter"),
    "fiscal_month": Dimension("dim_calendar", "date_key", "fiscal_month"),
}
#: Calendar dimensions follow from the month of the line.
CALENDAR = {"fiscal_year": F.year, "fiscal_quarter": F.quarter, "fiscal_month": F.month}


def metric_query(
    fact: DataFrame,
    dims: Mapping[str, DataFrame],
    metrics: Sequence[str],
    by: Sequence[str] = (),
    where: Mapping[str, object] | None = None,
    rollup: bool = False,
) -> DataFrame:
    """Metrics by dimensions, one row per combination of `by`.

    `where` maps a dimension to a value or a list of values. Filters come before the sum: those on
    the calendar are conditions on the fact's month, which prune a fact stored by month, and
    others keep the lines whose key is among the dimension's matching rows. The fact is summed
    on the keys of the dimensions in `by` before those are joined; calendar columns are
    computed from the month. With `rollup` the subtotals of the leading dimensions are added,
    with a `level` column.
    """
    unknown = [n for n in metrics if n not in REGISTRY]
    unknown += [n for n in (*by, *(where or {})) if n not in DIMENSIONS]
    if unknown:
        raise KeyError(f"not in the registry: {', '.join(unknown)}")
    terms = sorted({t for m in metrics for t in (REGISTRY[m].value, REGISTRY[m].over) if t})
    alias = {term: f"_term{i}" for i, term in enumerate(terms)}
    for name, wanted in (where or {}).items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        dim = DIMENSIONS[name]
        if name in CALENDAR:
            fact = fact.where(CALENDAR[name](F.col("period_month")).isin(*values))
        else:
            chosen = dims[dim.table].where(F.col(dim.column).isin(*values)).select(dim.key)
            fact = fact.join(chosen, dim.key, "left_semi")
    columns_of: dict[tuple[str, str], list[str]] = {}
    for name in dict.fromkeys(by):
        dim = DIMENSIONS[name]
        if name not in CALENDAR:
            columns_of.setdefault((dim.table, dim.key), []).append(name)

    keys = [key for _, key in columns_of]
    periods = [CALENDAR[n](F.col("period_month")).alias(n) for n in by if n in CALENDAR]
    sums = fact.groupBy(*keys, *periods).agg(*[F.sum(F.expr(t)).alias(a) for t, a in alias.items()])
    for (table, key), names in columns_of.items():
        side = dims[table].select(key, *[F.col(DIMENSIONS[n].column).alias(n) for n in names])
        sums = sums.join(side, key, "left")

    totals: list[Column] = [F.sum(a).alias(a) for a in alias.values()]
    if rollup:
        missing = sum((F.grouping(c).cast("int") for c in by), F.lit(0))
        grouped = sums.rollup(*by).agg((F.lit(len(by)) - missing).cast("bigint").alias("level"), *totals)
        heads = [*by, "level"]
    else:
        grouped = sums.groupBy(*by).agg(*totals)
        heads = list(by)
    return grouped.select(*heads, *[_value(REGISTRY[m], alias).alias(m) for m in metrics])


def _value(metric: Metric, alias: Mapping[str, str]) -> Column:
    value = F.col(alias[metric.value])
    return ratio(value, F.col(alias[metric.over])) if metric.over else value


def metric_by_month(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    return metric_query(fact, dims, list(METRICS), by=("fiscal_year", "fiscal_month"))


def metric_by_hierarchy(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    levels = ("category_l1", "category_l2", "category_l3")
    return metric_query(
        fact, dims, ("total_spend", "rate_leakage", "volume"), by=levels, rollup=True
    )


def metric_by_supplier_tier(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    return metric_query(
        fact,
        dims,
        ("total_spend", "contract_compliance_rate", "maverick_spend_pct", "should_cost_gap"),
        by=("supplier_tier",),
    )
