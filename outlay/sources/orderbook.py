"""Adapter: order-book tables (lineitem, orders, part, supplier, nation, region) as spend data.

`raw_*` functions give the eight raw extracts, `star_*` functions the star tables. Order and
part attributes come in by left joins to sides that are unique on their key, so a product that
reads no such attribute does not pay for the join.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.functions.numeric import MONEY, RATE
from outlay.functions.relations import (
    LazyFrames,
    lookup,
    unique_by,
)
from outlay.operators.costing import derive_cost_measures, should_cost_buildup
from outlay.sources.schemas import EXTRACTS, ORDER_BOOK

# Fixed values of the mapping.
INDIRECT_TYPES = ("ECONOMY", "STANDARD", "PROMO")
PERCENT = "decimal(4,2)"

#: What tells one line of an order from another.
ORDER_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _keyed(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _by_remainder(key: str, modulus: int, *steps: tuple[int, object], last) -> Column:
    """First value whose bound exceeds key % modulus."""
    rest = F.col(key) % modulus
    expr = F.when(rest < steps[0][0], F.lit(steps[0][1]))
    for bound, value in steps[1:]:
        expr = expr.when(rest < bound, F.lit(value))
    return expr.otherwise(F.lit(last))


class OrderBook:
    """Lazily read tables of one directory and the spend frames derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(ORDER_BOOK[name]).parquet(f"{self.path}/{name}.parquet")

    # ---- shared parts

    @cached_property
    def _parts(self) -> DataFrame:
        part = self.table("part").select(
            "p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("category_id"), "p_size"
        )
        return unique_by(part, "p_partkey")

    @cached_property
    def _orders(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
        return unique_by(orders, "o_orderkey")

    @cached_property
    def _taxonomy(self) -> DataFrame:
        """Part types and brands in use, with the highest retail price and part count of each."""
        return (
            self.table("part")
            .groupBy("p_type", "p_brand")
            .agg(
                F.max(F.col("p_retailprice").cast(MONEY)).alias("top_price"),
                F.count("*").alias("parts"),
            )
            .withColumn("category_id", F.concat_ws("/", "p_type", "p_brand"))
            .withColumn(
                "l1",
                F.when(F.col("p_type").isin(*INDIRECT_TYPES), "Indirect").otherwise("Direct"),
            )
        )

    @cached_property
    def _dealt(self) -> DataFrame:
        """Order lines dealt out on the order line: every core gets its share, and grouping by order line
        needs no further exchange."""
        return self.table("lineitem").repartition(*ORDER_LINE)

    @cached_property
    def _items(self) -> DataFrame:
        """Order lines that are not grouped: dealt out only where they are read in fewer parts than there are
        cores. The joins to come exchange large tables anyway."""
        items = self.table("lineitem")
        return items if items.rdd.getNumPartitions() >= self.spark.sparkContext.defaultParallelism else self._dealt

    @staticmethod
    def _priced(items: DataFrame) -> DataFrame:
        """Order lines with their rates and amounts, by numeric keys alone, and what was looked up for them."""
        found = [c for c in items.columns if not c.startswith("l_")]
        cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
        per_unit = F.floor(cents * 100 / F.nullif("l_quantity", F.lit(0.0)))
        ext = F.col("l_extendedprice").cast(MONEY)
        credit = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
        lines = items.select(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            F.col("l_quantity").cast(MONEY).alias("qty"),
            ext.alias("ext"),
            F.when(credit, -ext).otherwise(ext).cast(MONEY).alias("amt"),
            F.col("l_discount").cast(PERCENT).alias("disc"),
            F.col("l_tax").cast(PERCENT).alias("tax"),
            (per_unit.cast("decimal(18,0)") * F.lit("0.0001").cast(RATE)).cast(RATE).alias("unit"),
            (F.col("l_returnflag") != "R").alias("covered"),
            ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("maverick"),
            F.col("l_shipdate").cast("date").alias("day"),
            *found,
        )
        # some suppliers grant no discount, so their lines are paid above the agreed rate
        discount = F.when(F.col("l_suppkey") % 10 == 3, F.lit(0).cast(PERCENT)).otherwise(F.col("disc"))
        paid = F.round(F.col("unit") * (F.lit(1).cast(PERCENT) + F.col("tax") - discount), 4)
        return lines.withColumn("act", paid.cast(RATE))

    def _described(self, lines: DataFrame) -> DataFrame:
        """Lines with the attributes of their part and order."""
        with_part = lookup(lines, self._parts, {"p_partkey": F.col("l_partkey")})
        return lookup(with_part, self._orders, {"o_orderkey": F.col("l_orderkey")})

    @cached_property
    def _lines(self) -> DataFrame:
        """Lines go through the exchanges of their lookups as they were read; rates and amounts are worked out behind them."""
        return self._priced(self._described(self._items))

    @staticmethod
    def _document(prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey"))

    @staticmethod
    def _business_unit(priority: str) -> Column:
        level = F.substring(priority, 1, 1)
        return (
            F.when(level.isin("1", "2"), "Manufacturing")
            .when(level == "3", "Corporate")
            .when(level == "4", "Aftermarket")
            .when(level == "5", "R&D")
        )

    def _agreements(self) -> DataFrame:
        """Two to four agreements per supplier that follow each other by half a year and overlap,
        priced by the part with the supplier's key; every second one is for all categories."""
        priced = self.table("part").select(
            F.col("p_partkey").alias("s_suppkey"),
            F.concat_ws("/", "p_type", "p_brand").alias("part_category"),
            F.col("p_retailprice").cast(RATE).alias("rate"),
        )
        key = F.col("s_suppkey")
        return (
            self.table("supplier")
            .select("s_suppkey", "s_name")
            .join(unique_by(priced, "s_suppkey"), "s_suppkey", "left")
            .withColumn("nr", F.explode(F.sequence(F.lit(0), (1 + key % 3).cast("int"))))
            .withColumn(
                "starts",
                F.date_add(F.lit("1995-01-01").cast("date"), (key % 365 + 180 * F.col("nr")).cast("int")),
            )
            .withColumn("ends", F.date_add("starts", (365 * (1 + (key + F.col("nr")) % 6)).cast("int")))
            .withColumn(
                "scope", F.when((key + F.col("nr")) % 2 == 0, None).otherwise(F.col("part_category"))
            )
        )

    # ---- raw extracts

    def raw_suppliers(self) -> DataFrame:
        key = F.col("s_suppkey")
        nation = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        category = self.table("part").select(
            F.col("p_partkey").alias("s_suppkey"),
            F.concat_ws("/", "p_type", "p_brand").alias("primary_category_id"),
        )
        return (
            self.table("supplier")
            .join(unique_by(nation, "s_nationkey"), "s_nationkey", "left")
            .join(unique_by(category, "s_suppkey"), "s_suppkey", "left")
            .select(
                _keyed("SUP-", "s_suppkey").alias("supplier_id"),
                F.col("s_name").alias("supplier_name"),
                F.when(
                    key % 10 >= 8,
                    F.concat(F.lit("GROUP"), F.floor(key / 10).cast("string")),
                ).alias("supplier_name_alias"),
                F.col("n_name").alias("country"),
                _by_remainder(
                    "s_suppkey",
                    20,
                    (3, "Strategic"),
                    (10, "Preferred"),
                    (17, "Approved"),
                    last="Tactical",
                ).alias("tier"),
                "primary_category_id",
                self._terms_days("s_suppkey").alias("payment_terms_days"),
                (key % 5 == 0).alias("diversity_flag"),
                (key % 20 != 0).alias("active_flag"),
                ((key % 100).cast("double") / 100.0).alias("risk_score_seed"),
                F.when(key % 25 != 24, (60 + (key * 37) % 40).cast("double") / 100.0).alias(
                    "on_time_delivery_hist"
                ),
                F.when(key % 25 != 23, ((key * 53) % 800).cast("int")).alias("quality_ppm_hist"),
            )
        )

    @staticmethod
    def _terms_days(key: str) -> Column:
        return _by_remainder(key, 10, (4, 30), (7, 45), (9, 60), last=90)

    def raw_categories(self) -> DataFrame:
        number = F.regexp_extract("p_brand", r"(\d+)", 1)
        return self._taxonomy.select(
            "category_id",
            F.concat_ws("-", F.substring("p_type", 1, 3), number).alias("category_code"),
            F.col("l1").alias("category_l1"),
            F.col("p_type").alias("category_l2"),
            F.col("p_brand").alias("category_l3"),
            F.concat(F.lit("10"), F.lpad(number, 6, "0")).alias("unspsc_stub"),
            F.lit("USD").alias("preferred_currency"),
        )

    def raw_contracts(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._agreements().select(
            F.when(F.col("nr") == 0, _keyed("CTR-", "s_suppkey"))
            .otherwise(F.concat(_keyed("CTR-", "s_suppkey"), F.lit("-"), F.col("nr").cast("string")))
            .alias("contract_id"),
            _keyed("SUP-", "s_suppkey").alias("supplier_id"),
            F.col("scope").alias("category_id"),
            F.concat("s_name", F.lit(" MSA")).alias("contract_name"),
            F.col("starts").alias("start_date"),
            F.col("ends").alias("end_date"),
            F.when(key % 4 == 0, None)
            .when(key % 4 == 1, "Active")
            .otherwise("Renewal")
            .alias("status"),
            F.when(key % 25 == 22, F.lit(0).cast(RATE)).otherwise(F.col("rate")).alias("unit_price"),
            F.lit("USD").alias("currency"),
            (500 + (key * 97) % 49500).cast("int").alias("volume_commitment"),
            ((key % 4).cast("double") / 100.0).alias("rebate_pct"),
            ((key % 3).cast("double") / 100.0).alias("escalation_pct"),
        )

    def raw_should_cost(self) -> DataFrame:
        def share(text: str) -> Column:
            return F.round(F.col("top_price") * F.lit(text).cast("decimal(3,2)"), 2).cast(MONEY)

        parts = self._taxonomy.select(
            "category_id",
            share("0.40").alias("material_cost"),
            share("0.15").alias("labor_cost"),
            share("0.10").alias("overhead_cost"),
            share("0.05").alias("freight_cost"),
            share("0.03").alias("quality_cost"),
            F.lit("2025.Q4").alias("model_version"),
            ((65 + F.col("parts") % 30).cast("double") / 100.0).alias("confidence"),
        )
        return should_cost_buildup(parts).select(*EXTRACTS["should_cost"][1].names)

    def raw_cost_centers(self) -> DataFrame:
        return (
            self.table("orders")
            .select(F.col("o_orderpriority").alias("cost_center_id"))
            .distinct()
            .select(
                "cost_center_id",
                F.concat(F.lit("Centre "), F.col("cost_center_id")).alias("cost_center_name"),
                self._business_unit("cost_center_id").alias("business_unit"),
            )
        )

    def raw_purchase_orders(self) -> DataFrame:
        """One row per order line, grouped by numeric keys where the lines already lie together;
        texts come after the grouping, which is then a hash aggregation without an exchange."""
        grouped = self._priced(self._dealt).groupBy(*ORDER_LINE).agg(
            F.min("day").alias("po_date"),
            F.max("covered").alias("covered"),
            F.sum("qty").cast(MONEY).alias("qty"),
            F.max("act").alias("unit_price"),
            F.sum("ext").cast(MONEY).alias("po_amount"),
        )
        return self._described(grouped).select(
            self._document("PO-").alias("po_id"),
            F.col("l_linenumber").alias("po_line"),
            "po_date",
            _keyed("SUP-", "l_suppkey").alias("supplier_id"),
            "category_id",
            F.when(F.col("covered"), _keyed("CTR-", "l_suppkey")).alias("contract_id"),
            F.col("o_orderpriority").alias("cost_center_id"),
            self._business_unit("o_orderpriority").alias("business_unit"),
            "qty",
            F.lit("EA").alias("uom"),
            "unit_price",
            "po_amount",
            F.lit("USD").alias("currency"),
            F.concat(
                F.lit("BUY-"), F.lpad((1 + F.col("l_suppkey") % 11).cast("string"), 2, "0")
            ).alias("buyer_id"),
            F.when(F.col("o_orderstatus") == "F", "Closed")
            .when(F.col("o_orderstatus") == "P", "Received")
            .otherwise("Open")
            .alias("status"),
        )

    def raw_invoices(self) -> DataFrame:
        def money_share(base: Column, factor: Column) -> Column:
            return F.round(base * factor, 2).cast(MONEY)

        size_factor = F.lit("0.85").cast("decimal(8,4)") + F.lit("0.005").cast(
            "decimal(8,4)"
        ) * F.col("p_size").cast("decimal(8,0)")
        lines = self._lines.select(
            self._document("INV-").alias("invoice_id"),
            F.col("l_linenumber").alias("invoice_line"),
            F.col("day").alias("invoice_date"),
            F.when(~F.col("maverick"), self._document("PO-")).alias("po_id"),
            _keyed("SUP-", "l_suppkey").alias("supplier_id"),
            "category_id",
            F.when(F.col("covered"), _keyed("CTR-", "l_suppkey")).alias("contract_id"),
            F.col("o_orderpriority").alias("cost_center_id"),
            self._business_unit("o_orderpriority").alias("business_unit"),
            "qty",
            F.col("act").alias("actual_unit_price"),
            F.col("amt").alias("invoice_amount"),
            F.lit("USD").alias("currency"),
            F.when(F.col("o_orderstatus") == "F", "Paid")
            .when(F.col("o_orderstatus") == "O", "Open")
            .when(F.col("o_orderstatus") == "P", "Disputed")
            .alias("payment_status"),
            F.col("maverick").alias("maverick_flag"),
            F.col("unit").alias("contracted_unit_price"),
            F.round(F.col("unit") * size_factor, 4).cast(RATE).alias("should_cost_unit"),
            money_share(F.col("ext"), F.col("tax") * F.lit("0.5").cast("decimal(2,1)")).alias(
                "freight_cost"
            ),
            money_share(F.col("ext"), F.lit("0.02").cast("decimal(3,2)")).alias("quality_cost"),
            F.col("ext").alias("cost_basis"),
            self._terms_days("l_suppkey").alias("payment_terms_days"),
            F.col("covered").alias("on_contract"),
        )
        return (
            derive_cost_measures(lines)
            .withColumnRenamed("actual_unit_price", "unit_price")
            .select(*EXTRACTS["invoices"][1].names)
        )

    def raw_gl_actuals(self) -> DataFrame:
        def planned(factor: Column) -> Column:
            return F.round(F.col("amt") * factor, 2).cast(MONEY)

        l2 = F.split_part("category_id", F.lit("/"), F.lit(1))
        half = F.lit("0.5").cast("decimal(2,1)")
        return self._lines.select(
            F.date_format("day", "yyyy-MM").alias("gl_period"),
            F.col("o_orderpriority").alias("cost_center_id"),
            "category_id",
            F.when(l2.isin(*INDIRECT_TYPES), "6200-OpEx")
            .otherwise("5100-Materials")
            .alias("gl_account"),
            F.col("amt").alias("actual_amount"),
            planned(F.lit("1.04").cast("decimal(4,2)") - F.col("disc")).alias("budget_amount"),
            planned(F.lit("1.02").cast("decimal(4,2)") - F.col("tax") * half).alias(
                "forecast_amount"
            ),
        )

    def raw(self) -> LazyFrames:
        """All eight extracts by name, each built when it is asked for."""
        return LazyFrames({name: getattr(self, f"raw_{name}") for name in EXTRACTS})

    # ---- star tables

    def star(self) -> LazyFrames:
        """The star tables by name, each built when it is asked for."""
        return LazyFrames(
            {
                "fact_spend": lambda: self.star_fact,
                "dim_supplier": lambda: self.star_supplier,
                "dim_category": lambda: self.star_category,
                "dim_contract": lambda: self.star_contract,
            }
        )

    @cached_property
    def star_supplier(self) -> DataFrame:
        """Supplier dimension."""
        place = (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("region"))
        )
        named = self.table("supplier").join(unique_by(place, "s_nationkey"), "s_nationkey", "left")
        tier = _by_remainder("s_suppkey", 5, (2, "Low"), (4, "Medium"), last="High")
        return named.select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("name"),
            tier.alias("risk_tier"),
            "region",
        )

    @cached_property
    def star_category(self) -> DataFrame:
        """Category dimension."""
        return self._taxonomy.select(
            "category_id",
            F.col("p_brand").alias("name"),
            F.col("p_type").alias("parent_category"),
            F.col("l1").alias("direct_or_indirect"),
        )

    @cached_property
    def star_contract(self) -> DataFrame:
        return self._agreements().select(
            # the first keeps the supplier's key, by which lines name it
            F.when(F.col("nr") == 0, F.col("s_suppkey"))
            .otherwise(-(F.col("s_suppkey") * 10 + F.col("nr")))
            .alias("contract_id"),
            F.col("s_suppkey").alias("supplier_id"),
            F.col("rate").alias("negotiated_rate"),
            F.col("starts").alias("start_date"),
            F.col("ends").alias("end_date"),
            F.col("scope").alias("category_id"),
        )

    @cached_property
    def star_fact(self) -> DataFrame:
        return self._lines.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
            F.col("l_suppkey").alias("supplier_id"),
            "category_id",
            F.when(F.col("covered"), F.col("l_suppkey")).alias("contract_id"),
            _keyed("PO-", "l_orderkey").alias("po_number"),
            F.col("l_linenumber").alias("line_number"),
            F.col("amt").alias("invoice_amount"),
            F.when(F.col("covered"), F.col("unit")).alias("negotiated_rate"),
            F.col("act").alias("actual_rate"),
            F.col("qty").alias("quantity"),
            F.col("day").alias("spend_date"),
            F.col("o_orderpriority").alias("cost_center"),
            F.col("maverick").alias("is_maverick"),
        )
