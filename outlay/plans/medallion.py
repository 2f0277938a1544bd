"""Lazy products of the medallion side: bronze frames in, marts and analytics out.

Every attribute is a DataFrame built on first use, and building it runs nothing. The scores
(`supplier_risk`, `spend_anomalies`) pass over their input several times and write it when they are called.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from outlay.operators import anomaly, conform, leakage, marts, model, pvm, quality, risk, rollup
from outlay.sources.storage import in_buckets, new_folder, remove, written


#: What the marts and analytics read of a line, but for the cube and the finance mart.
LINE_COLUMNS = (
    "period_month",
    "supplier_id",
    "category_id",
    "spend_type",
    "category_l2",
    "category_l3",
    "qty",
    "invoice_amount",
    "price_variance",
    "should_cost_gap",
    "savings_realized",
    "freight_cost",
    "quality_cost",
    "payment_terms_cost",
    "tco_amount",
    "on_contract",
    "maverick_flag",
)


#: What the cube and the sums over its grain read of a line.
CUBE_COLUMNS = (*marts.CUBE_KEYS, *rollup.SUMMED, *rollup.PRICES)


class Medallion:
    def __init__(
        self,
        bronze: Mapping[str, DataFrame],
        as_of: dt.date,
        stored_fact: DataFrame | None = None,
        strict_names: bool = False,
    ):
        """`stored_fact` replaces the derived fact where it was already written."""
        self.bronze = bronze
        self.as_of = as_of
        self.stored_fact = stored_fact
        self.strict_names = strict_names

    # ---- silver

    @cached_property
    def suppliers(self) -> DataFrame:
        return conform.silver_suppliers(self.bronze["suppliers"], self.strict_names)

    @cached_property
    def categories(self) -> DataFrame:
        return conform.silver_categories(self.bronze["categories"])

    @cached_property
    def contracts(self) -> DataFrame:
        return conform.silver_contracts(self.bronze["contracts"], self.as_of)

    @cached_property
    def should_cost(self) -> DataFrame:
        return conform.silver_should_cost(self.bronze["should_cost"])

    @cached_property
    def cost_centers(self) -> DataFrame:
        return conform.silver_cost_centers(self.bronze["cost_centers"])

    @cached_property
    def purchase_orders(self) -> DataFrame:
        return conform.silver_purchase_orders(self.bronze["purchase_orders"])

    @cached_property
    def invoices(self) -> DataFrame:
        return conform.silver_invoices(self.bronze["invoices"])

    @cached_property
    def gl_actuals(self) -> DataFrame:
        return conform.silver_gl_actuals(self.bronze["gl_actuals"])

    @cached_property
    def silver_quality(self) -> DataFrame:
        return quality.dq_silver(self.bronze, self.suppliers, self.invoices, self.categories)

    def silver(self) -> dict[str, DataFrame]:
        return {
            "suppliers": self.suppliers,
            "categories": self.categories,
            "contracts": self.contracts,
            "should_cost": self.should_cost,
            "cost_centers": self.cost_centers,
            "purchase_orders": self.purchase_orders,
            "invoices": self.invoices,
            "gl_actuals": self.gl_actuals,
            "data_quality_results": self.silver_quality,
        }

    # ---- gold

    @cached_property
    def dim_supplier(self) -> DataFrame:
        return model.dim_supplier(self.suppliers)

    @cached_property
    def dim_category(self) -> DataFrame:
        return model.dim_category(self.categories)

    @cached_property
    def dim_contract(self) -> DataFrame:
        return model.dim_contract(self.contracts)

    @cached_property
    def dim_cost_center(self) -> DataFrame:
        return model.dim_cost_center(self.cost_centers)

    @cached_property
    def dim_calendar(self) -> DataFrame:
        return model.dim_calendar(self.invoices)

    def dims(self) -> dict[str, DataFrame]:
        return {
            "dim_supplier": self.dim_supplier,
            "dim_category": self.dim_category,
            "dim_contract": self.dim_contract,
            "dim_cost_center": self.dim_cost_center,
            "dim_calendar": self.dim_calendar,
        }

    @cached_property
    def fact(self) -> DataFrame:
        if self.stored_fact is not None:
            return self.stored_fact
        levels = model.category_levels(self.categories)
        return model.fact_spend(self.invoices, self.purchase_orders, levels)

    def over(self, fact: DataFrame) -> Medallion:
        """The same products over a stored fact."""
        products = Medallion(self.bronze, self.as_of, fact, self.strict_names)
        products.dim_supplier = self.dim_supplier
        return products

    def over_written_lines(self) -> Medallion:
        """The same products over lines that are written once with LINE_COLUMNS, for jobs that take several."""
        return self.over(written(self.fact.select(*LINE_COLUMNS), "lines"))

    def over_stored_sides(self, buckets: int, folder: str | None = None) -> Medallion:
        """The same products over a fact whose invoices and order lines are stored first, in equal buckets: wide
        lines go to storage in columns, which take half the room of an exchange, and are joined where they lie."""
        spark = self.invoices.sparkSession
        folder = folder or new_folder(spark, "sides")
        sides = {
            "invoices": model.invoices_for_orders(self.invoices),
            "orders": model.orders_for_invoices(self.purchase_orders),
        }
        stored = {n: in_buckets(df, f"{folder}/{n}", model.ORDER_BUCKETS, buckets) for n, df in sides.items()}
        # stored, their size is known before the fact is joined to them; else it would be exchanged by category
        levels = written(model.category_levels(self.categories), "levels")
        return self.over(model.colocated_fact(stored["invoices"], stored["orders"], levels))

    def over_cube_lines(self, buckets: int, folder: str | None = None) -> Medallion:
        """The same products over lines with CUBE_COLUMNS in buckets of the cube's keys, which are summed where
        they lie: almost every line is a cell of its own, so partial sums would be wider than the lines."""
        spark = self.invoices.sparkSession
        sides = new_folder(spark, "sides")
        fact = self.over_stored_sides(buckets, sides).fact
        folder = folder or new_folder(spark, "cube-lines")
        lines = in_buckets(fact.select(*CUBE_COLUMNS), folder, marts.CUBE_KEYS, buckets)
        remove(spark, sides)
        return self.over(lines)

    @cached_property
    def monthly(self) -> DataFrame:
        return marts.mart_monthly_executive(self.fact)

    @cached_property
    def performance(self) -> DataFrame:
        return marts.mart_supplier_performance(self.fact, self.dim_supplier)

    @cached_property
    def category_spend(self) -> DataFrame:
        return marts.mart_category_spend(self.fact)

    @cached_property
    def finance(self) -> DataFrame:
        return marts.mart_finance_alignment(self.gl_actuals, self.dim_cost_center, self.dim_category)

    @cached_property
    def cube(self) -> DataFrame:
        return marts.spend_cube(self.fact)

    def gold(self) -> dict[str, DataFrame]:
        return {
            **self.dims(),
            "spend_cube": self.cube,
            "mart_monthly_executive": self.monthly,
            "mart_supplier_performance": self.performance,
            "mart_category_spend": self.category_spend,
            "mart_finance_alignment": self.finance,
        }

    # ---- analytics and scores

    @cached_property
    def leakage(self) -> DataFrame:
        return leakage.leakage(self.fact, self.dim_supplier)

    @cached_property
    def tco(self) -> DataFrame:
        return leakage.tco(self.fact)

    @cached_property
    def opportunity(self) -> DataFrame:
        return leakage.opportunity(self.fact)

    @cached_property
    def pvm(self) -> DataFrame:
        return pvm.pvm_category_monthly(self.fact)

    @cached_property
    def pvm_summary(self) -> DataFrame:
        return pvm.pvm_latest_summary(self.pvm)

    def analytics(self) -> dict[str, DataFrame]:
        return {
            "leakage": self.leakage,
            "tco": self.tco,
            "opportunity": self.opportunity,
            "pvm_category_monthly": self.pvm,
            "pvm_latest_summary": self.pvm_summary,
        }

    def supplier_risk(self) -> DataFrame:
        return risk.supplier_risk(self.performance)

    def spend_anomalies(self) -> DataFrame:
        """Detection passes over its lines three times; a derived fact is written once for it."""
        fact = self.stored_fact
        if fact is None:
            fact = written(self.fact.select(*anomaly.FACT_COLUMNS), "anomaly-lines")
        return anomaly.spend_anomalies(fact)

    def rule_tables(self) -> dict[str, DataFrame]:
        """Tables the declared quality rules name."""
        return {
            "silver_suppliers": self.suppliers,
            "silver_invoices": self.invoices,
            "silver_categories": self.categories,
            "silver_po_lines": self.purchase_orders,
            "silver_contracts": self.contracts,
        }
