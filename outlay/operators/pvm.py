"""Price, volume and mix effects between consecutive months of a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions.numeric import ratio

EFFECTS = ("price_effect", "volume_effect", "mix_effect")


def pvm_monthly_base(fact: DataFrame) -> DataFrame:
    """Volume, spend and average price per month and category."""
    return fact.groupBy("period_month", "category_id").agg(
        F.max("category_l3").alias("category_l3"),
        F.max("spend_type").alias("spend_type"),
        F.sum("qty").alias("volume"),
        F.sum("invoice_amount").alias("spend"),
        ratio(F.sum("invoice_amount"), F.sum("qty")).alias("avg_price"),
    )


def with_prior_month(monthly: DataFrame) -> DataFrame:
    """Add the values of the previous month the category has, however far back it lies.

    A category has one row per month here, so a window partition stays small.
    """
    w = Window.partitionBy("category_id").orderBy("period_month")
    return (
        monthly.withColumn("prev_volume", F.lag("volume").over(w))
        .withColumn("prev_spend", F.lag("spend").over(w))
        .withColumn("prev_price", F.lag("avg_price").over(w))
    )


def _effects() -> dict[str, Column]:
    """Effects as decimals at six places: the month's quantities at last month's price are rounded
    once, so price and volume effect add up to the change exactly and nothing is left for mix."""
    at_prior_price = (
        F.col("prev_spend").cast("decimal(19,2)") * F.col("volume").cast("decimal(18,2)")
    ).cast("decimal(38,4)")
    carried = (at_prior_price / F.nullif(F.col("prev_volume"), F.lit(0)).cast("decimal(18,2)")).cast(
        "decimal(38,6)"
    )
    price = F.col("spend") - carried
    volume = carried - F.col("prev_spend")
    change = F.col("spend") - F.col("prev_spend")
    return {
        "price_effect": price,
        "volume_effect": volume,
        "spend_change": change,
        "mix_effect": change - price - volume,
    }


def pvm_category_monthly(fact: DataFrame) -> DataFrame:
    """Effects per month and category; rows without prior volume or prior price are left out,
    credit memos are kept."""
    prior = with_prior_month(pvm_monthly_base(fact)).where(
        F.col("category_id").isNotNull()
        & F.col("prev_volume").isNotNull()
        & F.col("prev_price").isNotNull()
    )
    effects = _effects()
    return prior.select(
        "period_month",
        "category_id",
        "category_l3",
        "spend_type",
        "volume",
        "spend",
        "avg_price",
        "prev_volume",
        "prev_spend",
        "prev_price",
        *[effects[name].alias(name) for name in (*EFFECTS, "spend_change")],
    )


def latest_month(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of the last month present; `rows` has one per month and `keys`.

    Every key is folded to its own last month, then the keys that reach the last month of all stay.
    The second step is one short list, a row per category, so nothing is written or read twice.
    """
    own = rows.where(F.col("period_month").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct(*rows.columns), "period_month").alias("row")
    )
    folded = own.agg(F.max("row.period_month").alias("last"), F.collect_list("row").alias("rows"))
    return folded.select(F.inline(F.filter("rows", lambda r: r["period_month"] == F.col("last"))))


def pvm_latest_summary(pvm: DataFrame) -> DataFrame:
    """Effects of the last month by spend type and category level 3; categories without either are
    summed under null, so the summary adds up to the month."""
    measures = ("spend", "spend_change", *EFFECTS)
    return (
        latest_month(pvm, "category_id")
        .groupBy("spend_type", "category_l3")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .orderBy(F.desc_nulls_last("spend_change"))
    )


def v_pvm_monthly(fact: DataFrame, categories: DataFrame) -> DataFrame:
    """Star-schema variant: no negative amounts, effects rounded to cents; a row with a prior
    month of zero volume stays, with null effects."""
    sums = (
        fact.where(F.col("invoice_amount") >= 0)
        .groupBy(F.trunc("spend_date", "MM").alias("period_month"), "category_id")
        .agg(
            F.sum("quantity").alias("volume"),
            F.sum("invoice_amount").alias("spend"),
            ratio(F.sum("invoice_amount"), F.sum("quantity")).alias("avg_price"),
        )
    )
    named = sums.join(categories, "category_id").withColumnRenamed("name", "category_name")
    effects = _effects()
    return (
        with_prior_month(named)
        .where(F.col("prev_volume").isNotNull())
        .select(
            "period_month",
            "category_id",
            "category_name",
            "direct_or_indirect",
            F.round("spend", 2).alias("spend"),
            F.round(effects["spend_change"], 2).alias("spend_change"),
            *[F.round(effects[name], 2).cast("decimal(38,2)").alias(name) for name in EFFECTS],
        )
    )
