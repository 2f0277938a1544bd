"""Products of the medallion side from stored sums instead of lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.operators import leakage, marts, pvm, rollup
from outlay.operators.rollup import CATEGORY_GRAIN, MONTHLY_GRAIN, SUPPLIER_GRAIN, Rollup
from outlay.plans.medallion import Medallion


class RolledMedallion(Medallion):
    """Additive products come from a lattice of stored sums; the fact is read once, for its base.

    `store` writes a frame under a name and reads it back. Making this object writes the base; three
    coarser grains and the member sets are each written when the first product that needs them is built.
    `deal` brings the rows of the supplier grain together, which has few rows a group.
    """

    def __init__(
        self,
        bronze: Mapping[str, DataFrame],
        as_of: dt.date,
        fact: DataFrame,
        store: Callable[[str, DataFrame], DataFrame],
        strict_names: bool = False,
        deal: rollup.Deal = rollup.undealt,
    ):
        super().__init__(bronze, as_of, stored_fact=fact, strict_names=strict_names)
        self.store, self.deal = store, deal
        self.rollup = Rollup(store("spend_base", rollup.base_sums(fact)), store)

    @cached_property
    def months(self) -> DataFrame:
        return self.rollup.keep("spend_by_month", *MONTHLY_GRAIN)

    @cached_property
    def by_supplier(self) -> DataFrame:
        return self.rollup.keep("spend_by_supplier", *SUPPLIER_GRAIN, deal=self.deal)

    @cached_property
    def by_category(self) -> DataFrame:
        return self.rollup.keep("spend_by_category", *CATEGORY_GRAIN)

    def _members(self, name: str, member: str, *keys: str) -> DataFrame:
        return self.store(name, self.rollup.member_sets(member, *keys))

    @cached_property
    def month_suppliers(self) -> DataFrame:
        return self._members("month_suppliers", "supplier_id", "period_month")

    @cached_property
    def month_categories(self) -> DataFrame:
        return self._members("month_categories", "category_id", "period_month")

    @cached_property
    def category_suppliers(self) -> DataFrame:
        return self._members("category_suppliers", "supplier_id", *rollup.LEVELS)

    @cached_property
    def cube(self) -> DataFrame:
        return rollup.cube(self.rollup.at(*marts.CUBE_KEYS))

    @cached_property
    def monthly(self) -> DataFrame:
        sums = marts.monthly_sums(self.months)
        for name, sets in (
            ("active_suppliers", self.month_suppliers),
            ("active_categories", self.month_categories),
        ):
            sizes = rollup.set_sizes(sets, name, "period_month")
            sums = rollup.with_sizes(sums, sizes, name, "period_month")
        return sums.orderBy(F.asc_nulls_last("period_month"))

    @cached_property
    def performance(self) -> DataFrame:
        return marts.mart_supplier_performance(self.by_supplier, self.dim_supplier)

    @cached_property
    def category_spend(self) -> DataFrame:
        keys = rollup.LEVELS
        sizes = rollup.set_sizes(self.category_suppliers, "supplier_count", *keys)
        return rollup.with_sizes(marts.category_sums(self.by_category), sizes, "supplier_count", *keys)

    @cached_property
    def leakage(self) -> DataFrame:
        return leakage.leakage(self.by_supplier, self.dim_supplier)

    @cached_property
    def tco(self) -> DataFrame:
        return leakage.tco(self.by_category)

    @cached_property
    def opportunity(self) -> DataFrame:
        return leakage.opportunity(self.by_category)

    @cached_property
    def pvm(self) -> DataFrame:
        return pvm.pvm_category_monthly(self.months)

    @cached_property
    def by_quarter(self) -> DataFrame:
        return rollup.by_quarter(self.rollup, self.month_suppliers, self.month_categories)

    @cached_property
    def by_level(self) -> DataFrame:
        return rollup.by_level(self.rollup, self.category_suppliers)
