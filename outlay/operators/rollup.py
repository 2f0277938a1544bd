"""Sums that merge upwards: one aggregation of the fact, every additive product from it.

The base has the grain of the spend cube. A coarser grain is derived from the narrowest grain at hand
that holds its keys, never from the fact. Members of a group (suppliers of a month) are bitmaps over member
numbers; bitmaps merge by OR, so a coarser group's distinct count comes from finer groups too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import AbstractContextManager, nullcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.numeric import as_double, sum_if
from outlay.functions.relations import lookup
from outlay.operators.marts import CUBE_KEYS

#: Columns of the fact that are summed under their own names, so a product reads sums as it reads lines.
SUMMED = (
    "qty",
    "invoice_amount",
    "po_amount",
    "contracted_amount",
    "should_cost_amount",
    "price_variance",
    "should_cost_gap",
    "savings_realized",
    "freight_cost",
    "quality_cost",
    "payment_terms_cost",
    "tco_amount",
)
PRICES = ("actual_unit_price", "contracted_unit_price")
#: What is decided line by line and only then summed.
PER_LINE = ("lines", "leakage_above_zero", "gap_above_zero", *[f"{p}_{x}" for p in PRICES for x in ("total", "count")])
MEASURES = (*SUMMED, *PER_LINE)

LEVELS = ("spend_type", "category_l2", "category_l3", "category_id")
FLAGS = ("on_contract", "maverick_flag")
#: Grains that are stored beside the base: months of categories, and suppliers by category.
MONTHLY_GRAIN = ("period_month", *LEVELS, *FLAGS)
SUPPLIER_GRAIN = ("supplier_id", "spend_type", "category_l3", *FLAGS)
CATEGORY_GRAIN = (*LEVELS, *FLAGS)


def base_sums(fact: DataFrame) -> DataFrame:
    """The only pass over the fact."""
    prices = [
        c
        for p in PRICES
        for c in (F.sum(p).alias(f"{p}_total"), F.count(p).alias(f"{p}_count"))
    ]
    return fact.groupBy(*CUBE_KEYS).agg(
        *[F.sum(c).alias(c) for c in SUMMED],
        F.count("*").alias("lines"),
        sum_if(F.col("price_variance") > 0, F.col("price_variance")).alias("leakage_above_zero"),
        sum_if(F.col("should_cost_gap") > 0, F.col("should_cost_gap")).alias("gap_above_zero"),
        *prices,
    )


#: Rows of a frame brought together by keys, for as long as they are summed.
Deal = Callable[[DataFrame, Sequence[str]], AbstractContextManager[DataFrame]]


def undealt(rows: DataFrame, keys: Sequence[str]) -> AbstractContextManager[DataFrame]:
    """As they lie; partial sums are exchanged, which suits groups of many rows."""
    return nullcontext(rows)


class Rollup:
    """A lattice of grains over one base; `store` writes a frame under a name and reads it back."""

    def __init__(self, base: DataFrame, store: Callable[[str, DataFrame], DataFrame], keys: Sequence[str] = CUBE_KEYS):
        self.grains: dict[tuple[str, ...], DataFrame] = {tuple(keys): base}
        self.store = store
        self.numbers: dict[str, DataFrame] = {}

    def parent(self, keys: Sequence[str]) -> tuple[str, ...]:
        """The narrowest grain at hand that holds the keys."""
        holding = [g for g in self.grains if set(keys) <= set(g)]
        if not holding:
            raise KeyError(f"no grain holds {', '.join(keys)}")
        return min(holding, key=len)

    def at(self, *keys: str) -> DataFrame:
        """The sums at a grain."""
        parent = self.parent(keys)
        if set(parent) == set(keys):
            return self.grains[parent]
        return _summed(self.grains[parent], keys)

    def keep(self, name: str, *keys: str, deal: Deal = undealt) -> DataFrame:
        """Store a grain; coarser ones are derived from it from now on. `deal` is for grains whose groups
        are few rows each: their partial sums would be as many as the rows and wider."""
        with deal(self.grains[self.parent(keys)].select(*keys, *MEASURES), keys) as rows:
            self.grains[keys] = self.store(name, _summed(rows, keys))
        return self.grains[keys]

    def numbered(self, member: str) -> DataFrame:
        """Members with a number each, dense within every stored part, so bitmaps are well filled."""
        if member not in self.numbers:
            members = self.at(*self.parent((member,))).select(member).where(F.col(member).isNotNull()).distinct()
            numbers = members.select(member, (F.monotonically_increasing_id() + 1).alias("number"))
            self.numbers[member] = self.store(f"{member}_numbers", numbers)
        return self.numbers[member]

    def member_sets(self, member: str, *keys: str) -> DataFrame:
        """Bitmaps of the members of every group: keys, bucket, members."""
        pairs = self.at(*self.parent((member, *keys))).select(*keys, member).distinct()
        number = F.col("number")
        found = lookup(pairs, self.numbered(member), {member: F.col(member)}).where(number.isNotNull())
        return found.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("members")
        )


def _summed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def merged_sets(sets: DataFrame, *keys: str | Column) -> DataFrame:
    """Member sets of a coarser grouping."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("members").alias("members"))


def set_sizes(sets: DataFrame, name: str, *keys: str) -> DataFrame:
    """Distinct members of every group."""
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("members")).alias(name))


def with_sizes(df: DataFrame, sizes: DataFrame, name: str, *keys: str) -> DataFrame:
    """df with the distinct members of its groups; a group without members has 0."""
    inner = sizes.withColumnRenamed(name, "_size")
    joined = lookup(df, inner, {k: F.col(k) for k in keys}, null_safe=True)
    return joined.withColumn(name, F.coalesce("_size", F.lit(0).cast("bigint"))).drop("_size")


def cube(base: DataFrame) -> DataFrame:
    """The spend cube is the base under other names."""
    def mean(price: str) -> Column:
        return as_double(F.col(f"{price}_total")) / F.nullif(F.col(f"{price}_count").cast("double"), F.lit(0.0))

    return base.select(
        *CUBE_KEYS,
        F.col("qty").alias("volume"),
        F.col("invoice_amount").alias("spend"),
        F.col("po_amount").alias("po_spend"),
        F.col("contracted_amount").alias("contracted_spend"),
        F.col("should_cost_amount").alias("should_cost_spend"),
        F.col("price_variance").alias("rate_leakage"),
        "should_cost_gap",
        "savings_realized",
        F.col("tco_amount").alias("tco_spend"),
        F.col("lines").alias("invoice_lines"),
        mean("actual_unit_price").alias("avg_unit_price"),
        mean("contracted_unit_price").alias("avg_contract_price"),
    )


def by_quarter(rollup: Rollup, month_suppliers: DataFrame, month_categories: DataFrame) -> DataFrame:
    """Spend, leakage and active suppliers and categories per calendar quarter, from months."""
    quarter = F.trunc("period_month", "quarter").alias("quarter")
    months = rollup.at("period_month").withColumn("quarter", quarter)
    sums = months.groupBy("quarter").agg(
        F.sum("invoice_amount").alias("total_spend"),
        F.sum("price_variance").alias("rate_leakage"),
        F.sum("lines").alias("invoice_lines"),
    )
    for name, sets in (("active_suppliers", month_suppliers), ("active_categories", month_categories)):
        merged = merged_sets(sets.withColumn("quarter", quarter), "quarter")
        sums = with_sizes(sums, set_sizes(merged, name, "quarter"), name, "quarter")
    return sums


def by_level(rollup: Rollup, category_suppliers: DataFrame) -> DataFrame:
    """Spend and suppliers per spend type and category level 2, from categories."""
    keys = ("spend_type", "category_l2")
    sums = rollup.at(*keys).select(
        *keys, F.col("invoice_amount").alias("total_spend"), F.col("lines").alias("invoice_lines")
    )
    merged = merged_sets(category_suppliers, *keys)
    return with_sizes(sums, set_sizes(merged, "supplier_count", *keys), "supplier_count", *keys)
