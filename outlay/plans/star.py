"""Lazy products of the star-schema side: star tables in, governed views out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from outlay.operators import quality, views
from outlay.sources.storage import publish_views


class Star:
    def __init__(self, tables: Mapping[str, DataFrame], as_of: dt.date):
        """`tables` holds fact_spend, dim_supplier, dim_category and dim_contract."""
        self.tables = tables
        self.as_of = as_of

    @property
    def fact(self) -> DataFrame:
        return self.tables["fact_spend"]

    @property
    def suppliers(self) -> DataFrame:
        return self.tables["dim_supplier"]

    @property
    def categories(self) -> DataFrame:
        return self.tables["dim_category"]

    @property
    def contracts(self) -> DataFrame:
        return self.tables["dim_contract"]

    @cached_property
    def cube(self) -> DataFrame:
        return views.v_spend_cube(self.fact, self.suppliers, self.categories)

    @cached_property
    def supplier_category(self) -> DataFrame:
        return views.supplier_category_spend(self.fact, self.suppliers, self.categories)

    @cached_property
    def variance(self) -> DataFrame:
        return views.v_price_variance(self.fact, self.suppliers, self.categories)

    @cached_property
    def tco(self) -> DataFrame:
        return views.v_tco_by_supplier(self.fact, self.suppliers)

    @cached_property
    def maverick(self) -> DataFrame:
        return views.v_maverick_spend(self.fact, self.suppliers, self.categories)

    @cached_property
    def monthly(self) -> DataFrame:
        return views.v_executive_monthly(self.fact, self.categories)

    @cached_property
    def pvm(self) -> DataFrame:
        return views.v_pvm_monthly(self.fact, self.categories)

    @cached_property
    def dq_report(self) -> DataFrame:
        return quality.dq_report(self.fact, self.as_of)

    def publish(self) -> list[str]:
        """Publish the six governed views, replacing earlier ones."""
        return publish_views(views.semantic_views(self.fact, self.suppliers, self.categories))
