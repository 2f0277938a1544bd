"""Data-quality reports. Each table is read once per report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from outlay.functions.numeric import count_if
from outlay.functions.relations import constants_stacked

# Name, status when any row is hit, and text of each fact check, in order.
FACT_CHECKS: tuple[tuple[str, str, str], ...] = (
    ("null_supplier_or_category", "fail", "Fact rows missing supplier or category keys"),
    ("negative_invoice_amounts", "warn", "Negative invoice amounts require finance review"),
    ("duplicate_po_lines", "fail", "Duplicate PO line grain violations"),
    ("actual_rate_null", "fail", "Actual rate required for variance analytics"),
    ("future_dated_spend", "warn", "Spend dated more than 30 days in the future"),
)
FUTURE_DAYS = 30

# Declared rules as (name, table, predicate).
DECLARED_RULES: tuple[tuple[str, str, str], ...] = (
    (
        "supplier_master_completeness",
        "silver_suppliers",
        "supplier_id is not null and supplier_name is not null",
    ),
    ("invoice_po_referential", "silver_invoices", "po_id is not null or maverick_flag = true"),
    ("category_hierarchy_valid", "silver_categories", "category_l1 in ('Direct','Indirect')"),
    ("negative_qty_block", "silver_po_lines", "qty > 0"),
    ("contract_rate_positive", "silver_contracts", "unit_price > 0"),
)


def _row_checks(as_of: dt.date) -> dict[str, Column]:
    horizon = F.date_add(F.lit(as_of).cast("date"), FUTURE_DAYS)
    return {
        "null_supplier_or_category": F.col("supplier_id").isNull() | F.col("category_id").isNull(),
        "negative_invoice_amounts": F.col("invoice_amount") < 0,
        "actual_rate_null": F.col("actual_rate").isNull(),
        "future_dated_spend": F.col("spend_date") > horizon,
    }


def dq_row_check(fact: DataFrame, check: str, as_of: dt.date) -> DataFrame:
    """One row `row_count`: fact rows hit by one of the row-level checks."""
    return fact.agg(count_if(_row_checks(as_of)[check]).alias("row_count"))


def dq_null_keys(fact: DataFrame, as_of: dt.date) -> DataFrame:
    return dq_row_check(fact, "null_supplier_or_category", as_of)


def dq_negative_amount(fact: DataFrame, as_of: dt.date) -> DataFrame:
    return dq_row_check(fact, "negative_invoice_amounts", as_of)


def dq_null_rate(fact: DataFrame, as_of: dt.date) -> DataFrame:
    return dq_row_check(fact, "actual_rate_null", as_of)


def dq_future_dated(fact: DataFrame, as_of: dt.date) -> DataFrame:
    return dq_row_check(fact, "future_dated_spend", as_of)


def dq_duplicate_lines(fact: DataFrame) -> DataFrame:
    """One row `row_count`: (po_number, line_number) groups with more than one row."""
    groups = fact.groupBy("po_number", "line_number").agg(F.count("*").alias("copies"))
    return groups.agg(count_if(F.col("copies") > 1).alias("row_count"))


def dq_report(fact: DataFrame, as_of: dt.date) -> DataFrame:
    """The five fact checks: check_name, status, row_count, detail, with their order check_no.

    One grouping by purchase-order line carries the row-level counts along, so the fact is read
    and shuffled once for all five.
    """
    rows = _row_checks(as_of)
    groups = fact.groupBy("po_number", "line_number").agg(
        F.count("*").alias("copies"), *[count_if(cond).alias(name) for name, cond in rows.items()]
    )
    totals = groups.agg(
        count_if(F.col("copies") > 1).alias("duplicate_po_lines"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in rows],
    )
    entries = []
    for no, (name, on_hit, text) in enumerate(FACT_CHECKS, start=1):
        hits = F.col(name)
        entries.append(
            (
                F.lit(no),
                name,
                F.when(hits <= 0, "pass").otherwise(on_hit),
                hits,
                F.concat(F.lit(f"{text} (count="), hits.cast("string"), F.lit(")")),
            )
        )
    return constants_stacked(
        totals, entries, ("check_no", "check_name", "status", "row_count", "detail")
    )


def dq_results(report: DataFrame, checked_at: dt.datetime) -> DataFrame:
    """The report as it is stored: with the time of the check."""
    return report.withColumn("checked_at", F.lit(checked_at).cast("timestamp"))


def read_dq(report: DataFrame) -> DataFrame:
    return report.orderBy("check_no").select("check_name", "status", "row_count", "detail")


def _counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: `n` rows and the rows meeting each condition, as one struct for embedding."""
    return df.agg(
        F.struct(
            F.count("*").alias("n"), *[count_if(c).alias(name) for name, c in conditions.items()]
        ).alias("c")
    )


def dq_silver(
    bronze: Mapping[str, DataFrame], suppliers: DataFrame, invoices: DataFrame, categories: DataFrame
) -> DataFrame:
    """Four rows (rule_name, rows_passed, rows_source, checked_at)."""
    duplicates = F.col("potential_duplicate_flag")
    supplier_counts = _counts(suppliers, duplicates=duplicates)
    category_counts = _counts(categories, valid=F.col("hierarchy_valid"))
    invoice_counts = _counts(invoices)
    raw_suppliers, raw_invoices = _counts(bronze["suppliers"]), _counts(bronze["invoices"])
    facts = [
        supplier_counts.select(
            F.inline(
                F.array(
                    _rule("supplier_master_completeness", F.col("c.n"), raw_suppliers.scalar()["n"]),
                    _rule("supplier_potential_duplicates", F.col("c.duplicates"), F.col("c.n")),
                )
            )
        ),
        invoice_counts.select(
            F.inline(
                F.array(
                    _rule("invoice_po_or_maverick", F.col("c.n"), raw_invoices.scalar()["n"])
                )
            )
        ),
        category_counts.select(
            F.inline(
                F.array(_rule("category_hierarchy_valid", F.col("c.valid"), F.col("c.n")))
            )
        ),
    ]
    return reduce(DataFrame.unionByName, facts).withColumn("checked_at", F.current_timestamp())


def dq_silver_counted(
    spark: SparkSession, landed: Mapping[str, int], suppliers: Mapping[str, int], invoices: int, categories: Mapping[str, int]
) -> DataFrame:
    """The same four rows from counts that the writes of both layers took, without reading a table."""
    rows = [
        ("supplier_master_completeness", suppliers["rows"], landed["suppliers"]),
        ("supplier_potential_duplicates", suppliers["duplicates"], suppliers["rows"]),
        ("invoice_po_or_maverick", invoices, landed["invoices"]),
        ("category_hierarchy_valid", categories["valid"], categories["rows"]),
    ]
    found = spark.createDataFrame(rows, "rule_name string, rows_passed long, rows_source long")
    return found.withColumn("checked_at", F.current_timestamp())


def _rule(name: str, passed: Column, source: Column) -> Column:
    return F.struct(
        F.lit(name).alias("rule_name"),
        passed.alias("rows_passed"),
        source.alias("rows_source"),
    )


def dq_rules(
    tables: Mapping[str, DataFrame], rules: Sequence[tuple[str, str, str]] = DECLARED_RULES
) -> DataFrame:
    """Passed and failed rows per declared rule; a predicate that is null fails its row.

    Rules on the same table share one pass over it.
    """
    by_table: dict[str, list[tuple[str, str]]] = {}
    for name, table, predicate in rules:
        by_table.setdefault(table, []).append((name, predicate))
    reports = []
    for table, checks in by_table.items():
        counts = tables[table].agg(
            F.count("*").alias("_rows"),
            *[count_if(F.expr(predicate)).alias(name) for name, predicate in checks],
        )
        reports.append(
            constants_stacked(
                counts,
                [(name, table, F.col(name), F.col("_rows") - F.col(name)) for name, _ in checks],
                ("rule_name", "table_name", "passed", "failed"),
            )
        )
    return reduce(DataFrame.unionByName, reports)


FAILED = "_failed_rules"


def with_failed_rules(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """df with FAILED, the names of the rules (name to predicate) that a row does not meet, null
    predicates included."""
    return df.withColumn(
        FAILED,
        F.array_compact(
            F.array(*[F.when(F.coalesce(F.expr(p), F.lit(False)), None).otherwise(F.lit(n)) for n, p in rules.items()])
        ),
    )


@dataclass(frozen=True)
class Ruled:
    """Tables with the rows that meet their rules, the others by rule, and a report of the counts."""

    passed: Mapping[str, DataFrame]
    quarantine: DataFrame
    report: DataFrame


def store_ruled(
    tables: Mapping[str, DataFrame],
    store: Callable[[str, DataFrame], DataFrame],
    rules: Sequence[tuple[str, str, str]] = DECLARED_RULES,
) -> Ruled:
    """Store the tables that rules name, each in one pass that also judges and counts its rows.

    `tables` are the frames before conforming, so that a rule sees the rows that conforming would drop.
    A quarantined row is kept once per rule that it fails, as JSON with the rule's name.
    """
    spark = next(iter(tables.values())).sparkSession
    passed, held, counts = {}, [], []
    for table in dict.fromkeys(t for _, t, _ in rules):
        mine = {name: predicate for name, t, predicate in rules if t == table}
        seen = Observation()
        judged = with_failed_rules(tables[table], mine)
        stored = store(
            table,
            judged.observe(
                seen,
                F.count("*").alias("rows"),
                *[count_if(F.array_contains(FAILED, name)).alias(name) for name in mine],
            ),
        )
        found = seen.get
        counts += [(name, table, found["rows"] - found[name], found[name]) for name in mine]
        columns = tables[table].columns
        passed[table] = stored.where(F.size(FAILED) == 0).drop(FAILED)
        held.append(
            stored.where(F.size(FAILED) > 0).select(
                F.explode(FAILED).alias("rule_name"),
                F.lit(table).alias("table_name"),
                F.to_json(F.struct(*columns)).alias("record"),
            )
        )
    report = spark.createDataFrame(counts, "rule_name string, table_name string, passed long, failed long")
    return Ruled(passed, reduce(DataFrame.unionByName, held), report)
