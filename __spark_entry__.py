"""

The frames come from `outlay`; this module only wires them to the given tables. Exact decimals
become doubles at this border, so that every engine reads them alike.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable, Mapping
from functools import lru_cache, reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import oracles  # noqa: E402
from outlay.operators import (  # noqa: E402
    anomaly,
    contracts,
    costing,
    marts,
    metrics,
    pvm,
    quality,
    questions,
    reads,
    risk,
    routing,
)
from outlay.plans.medallion import Medallion  # noqa: E402
from outlay.plans.rolled import RolledMedallion  # noqa: E402
from outlay.plans.star import Star  # noqa: E402
from outlay.plans.warehouse import refresh_star, refresh_warehouse  # noqa: E402
from outlay.sources import extracts, star, storage  # noqa: E402
from outlay.sources.orderbook import OrderBook  # noqa: E402

try:
    import corpus_pipeline  # noqa: E402
    from outlay.llm import queries as llm_queries  # noqa: E402
    from outlay.llm import sql as llm_sql  # noqa: E402
except ModuleNotFoundError as absent:
    if absent.name not in ("corpus_pipeline", "outlay.llm"):
        raise
    llm_queries = llm_sql = corpus_pipeline = None

CONTRACT_DAY = dt.date(1998, 6, 1)
QUALITY_DAY = dt.date(2001, 9, 1)
LOADED_AT = "2024-01-01T00:00:00+00:00"

Query = Callable[[SparkSession, str], DataFrame]


# Plans are kept per session and folder; they hold no data, only what to read and compute.
@lru_cache(maxsize=8)
def _book(spark: SparkSession, sf_dir: str) -> OrderBook:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return OrderBook(spark, sf_dir)


@lru_cache(maxsize=8)
def _medallion(spark: SparkSession, sf_dir: str) -> Medallion:
    bronze = extracts.bronze_frames(_book(spark, sf_dir).raw(), LOADED_AT)
    return Medallion(bronze, CONTRACT_DAY)


@lru_cache(maxsize=8)
def _star(spark: SparkSession, sf_dir: str) -> Star:
    return Star(_book(spark, sf_dir).star(), QUALITY_DAY)


#: Order lines for one bucket of the stored sides; a task sorts them in some 500 MB.
BUCKET_LINES = 1_500_000


def _buckets(spark: SparkSession, sf_dir: str) -> int:
    """By the number of order lines, which file footers tell."""
    return max(16, -(-_book(spark, sf_dir).table("lineitem").count() // BUCKET_LINES))


def _presented(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _on(source: Callable, product: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: _presented(product(source(spark, sf_dir)))


def _m(product: Callable[[Medallion], DataFrame]) -> Query:
    return _on(_medallion, product)


def _over_stored_sides(spark: SparkSession, sf_dir: str) -> Medallion:
    return _medallion(spark, sf_dir).over_stored_sides(_buckets(spark, sf_dir))


def _over_cube_lines(spark: SparkSession, sf_dir: str) -> Medallion:
    return _medallion(spark, sf_dir).over_cube_lines(_buckets(spark, sf_dir))


def _s(product: Callable[[Star], DataFrame]) -> Query:
    return _on(_star, product)


def _b(product: Callable[[OrderBook], DataFrame]) -> Query:
    return _on(_book, product)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.question_log(_book(spark, sf_dir).table("conversations"))


# ---- sources and sinks: the frame goes through storage, and the stored copy is summed up

_MEASURED = {
    "suppliers": "payment_terms_days",
    "categories": None,
    "contracts": "unit_price",
    "should_cost": "should_cost_unit",
    "purchase_orders": "po_amount",
    "invoices": "invoice_amount",
    "gl_actuals": "actual_amount",
    "cost_centers": None,
}


def _digest(name: str, df: DataFrame, measure: str | None, *extra: Column) -> DataFrame:
    total = F.sum(F.col(measure).cast("decimal(38,4)")) if measure else F.lit(None)
    return df.agg(
        F.lit(name).alias("name"),
        F.count("*").alias("row_count"),
        total.cast("double").alias("measure_total"),
        *extra,
    )


def _digests(frames: Mapping[str, DataFrame], measures: Mapping[str, str | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_digest(n, frames[n], m) for n, m in measures.items()])


def _extracts_folder(spark: SparkSession, sf_dir: str, leave_out: tuple[str, ...] = ()) -> str:
    folder = storage.new_folder(spark, "extracts")
    raw = _book(spark, sf_dir).raw()
    extracts.write_extracts({n: df for n, df in raw.items() if n not in leave_out}, folder)
    return folder


def _landing(spark: SparkSession, folder: str) -> extracts.Landing:
    return extracts.store_landed(
        extracts.land_extracts(spark, folder, LOADED_AT),
        lambda name, df: storage.written(df, f"landed-{name}"),
        extracts.consumed(spark, folder),
    )


def src_bronze_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _landing(spark, _extracts_folder(spark, sf_dir)).bronze
    metadata = (
        F.max("_source_file").alias("source_file"),
        F.countDistinct("_loaded_at_utc").alias("load_times"),
    )
    digests = [_digest(n, landed[n], measure, *metadata) for n, measure in _MEASURED.items()]
    return reduce(DataFrame.unionByName, digests)


def src_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts with amounts that are no numbers, days that are no dates, columns in another order and
    line feeds inside names: what landing accepts and rejects."""
    raw = dict(_book(spark, sf_dir).raw())
    bad_amount = F.when(F.col("invoice_line") == 7, F.concat(F.lit("about "), F.col("invoice_amount").cast("string")))
    raw["invoices"] = raw["invoices"].withColumn(
        "invoice_amount", bad_amount.otherwise(F.col("invoice_amount").cast("string"))
    )
    raw["contracts"] = raw["contracts"].withColumn(
        "start_date", F.when(F.col("volume_commitment") % 5 == 0, "soon").otherwise(F.col("start_date").cast("string"))
    )
    raw["suppliers"] = raw["suppliers"].withColumn("supplier_name", F.regexp_replace("supplier_name", "#", "\n"))
    folder = storage.new_folder(spark, "faulty-extracts")
    extracts.write_extracts(raw, folder, backwards=("gl_actuals", "suppliers"))
    landing = _landing(spark, folder)
    rejected = landing.rejects.groupBy("extract").agg(F.count("record").alias("rejected"))
    digests = _digests(landing.bronze, _MEASURED).withColumnRenamed("name", "extract")
    return digests.join(rejected, "extract", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0).cast("bigint")))


def src_missing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _extracts_folder(spark, sf_dir, leave_out=("gl_actuals", "invoices"))
    return extracts.extract_status(spark, folder)


def src_load_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.load_manifest(spark, _landing(spark, _extracts_folder(spark, sf_dir)), LOADED_AT)


def src_star_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_folder(spark, "star")
    for name, df in _book(spark, sf_dir).star().items():
        storage.export_parquet(df, f"{folder}/{name}")
    stored = star.read_star_parquet(spark, folder)
    return _digests(
        stored,
        {
            "dim_supplier": "supplier_id",
            "dim_category": None,
            "dim_contract": "negotiated_rate",
            "fact_spend": "invoice_amount",
        },
    )


def sink_replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact stored twice under one name: the second write replaces the first, whose version stays
    until the write after it and is what the second reads."""
    sides = storage.new_folder(spark, "sides")
    fact = rows = _medallion(spark, sf_dir).over_stored_sides(_buckets(spark, sf_dir), sides).fact
    path = storage.new_folder(spark, "fact")
    name = "outlay_" + path.rsplit("-", 1)[1]
    for _ in range(2):
        rows = storage.replace_table(rows, name, partition_by=("period_month",), folder=path, gather=False)
        storage.remove(spark, sides)
    version = storage.location_of(spark, name)
    spark.sql(f"drop table {name}")
    return _presented(
        spark.read.schema(fact.schema)
        .parquet(version)
        .groupBy("period_month")
        .agg(F.count("*").alias("lines"), F.sum("invoice_amount").alias("spend"))
    )


def fact_spend_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact from invoices and order lines that are stored in equal buckets."""
    return _presented(_over_stored_sides(spark, sf_dir).fact)


def _scratch_databases(spark: SparkSession, *names: str) -> tuple[str, dict[str, str]]:
    folder = storage.new_folder(spark, "warehouse")
    stem = "outlay_" + folder.rsplit("-", 1)[1]
    return folder, {n: f"{stem}_{n}" for n in names}


def warehouse_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full refresh from extracts to stored products; a digest of what is stored then."""
    extracts_folder = _extracts_folder(spark, sf_dir)
    folder, named = _scratch_databases(spark, "bronze", "silver", "gold", "analytics", "ml")
    refresh_warehouse(
        spark,
        extracts_folder,
        f"{folder}/exports",
        CONTRACT_DAY,
        LOADED_AT,
        folder,
        named,
        buckets=_buckets(spark, sf_dir),
        landed=extracts.consumed(spark, extracts_folder),
    )
    measures = {
        ("gold", "fact_spend"): "invoice_amount",
        ("gold", "spend_cube"): "spend",
        ("gold", "mart_monthly_executive"): "active_suppliers",
        ("gold", "mart_supplier_performance"): "total_spend",
        ("gold", "mart_category_spend"): "supplier_count",
        ("gold", "mart_finance_alignment"): "budget_variance",
        ("gold", "dim_calendar"): "date_key",
        ("analytics", "leakage"): "rate_leakage",
        ("analytics", "tco"): "tco",
        ("analytics", "opportunity"): "opportunity_usd",
        ("analytics", "pvm_category_monthly"): "spend_change",
        ("analytics", "pvm_latest_summary"): "spend_change",
        ("ml", "supplier_risk"): None,
        ("silver", "data_quality_results"): "rows_passed",
    }
    digests = [_digest(t, spark.table(f"{named[layer]}.{t}"), m) for (layer, t), m in measures.items()]
    return _kept_after(spark, reduce(DataFrame.unionByName, digests), "warehouse-digest", named.values())


def _kept_after(spark: SparkSession, digest: DataFrame, label: str, databases) -> DataFrame:
    """The digest as stored; the databases it was read from go."""
    found = storage.written(digest, label)
    for name in databases:
        spark.sql(f"drop database if exists {name} cascade")
    return found


def star_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star stored twice with its checks and views; the views are read from another session."""
    folder, named = _scratch_databases(spark, "star", "semantic", "semantic_store")
    tables = _book(spark, sf_dir).star()
    checked_at = dt.datetime.fromisoformat(LOADED_AT)
    for _ in range(2):
        refresh_star(spark, tables, QUALITY_DAY, checked_at, folder, named)
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "UTC")
    views = {n: other.table(f"{named['semantic']}.{n}") for n in _VIEW_MEASURES}
    checks = other.table(f"{named['star']}.data_quality_results")
    digest = _digests(views, _VIEW_MEASURES).unionByName(_digest("data_quality_results", checks, "row_count"))
    return _kept_after(spark, digest, "star-digest", named.values())


def _rolled(spark: SparkSession, sf_dir: str) -> RolledMedallion:
    buckets, folder = _buckets(spark, sf_dir), storage.new_folder(spark, "cube-lines")
    m = _medallion(spark, sf_dir).over_cube_lines(buckets, folder)
    rolled = RolledMedallion(
        m.bronze,
        CONTRACT_DAY,
        m.fact,
        lambda name, df: storage.written(df, f"rolled-{name}"),
        deal=lambda rows, keys: storage.dealt(rows, keys, buckets),
    )
    storage.remove(spark, folder)  # the sums are stored
    rolled.dim_supplier = m.dim_supplier
    return rolled


def rollup_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of all products that are derived from the sums of one pass over the fact."""
    m = _rolled(spark, sf_dir)
    return _digests(
        {
            "spend_cube": m.cube,
            "mart_monthly_executive": m.monthly,
            "mart_supplier_performance": m.performance,
            "mart_category_spend": m.category_spend,
            "leakage": m.leakage,
            "tco": m.tco,
            "opportunity": m.opportunity,
            "pvm_category_monthly": m.pvm,
        },
        {
            "spend_cube": "spend",
            "mart_monthly_executive": "active_suppliers",
            "mart_supplier_performance": "rate_leakage",
            "mart_category_spend": "supplier_count",
            "leakage": "off_contract_spend",
            "tco": "tco",
            "opportunity": "opportunity_usd",
            "pvm_category_monthly": "spend_change",
        },
    )


def _faulty_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables before conforming in which every declared rule fails for some rows."""
    raw = _book(spark, sf_dir).raw()
    lines, text = F.col("invoice_line"), F.col("category_id")
    return {
        "silver_suppliers": raw["suppliers"].withColumn(
            "supplier_name", F.when(F.col("payment_terms_days") < 90, F.col("supplier_name"))
        ),
        "silver_invoices": raw["invoices"].withColumn("po_id", F.when(lines != 6, F.col("po_id"))),
        "silver_categories": raw["categories"].withColumn(
            "category_l1", F.when(text.endswith("1"), "Other").when(~text.endswith("2"), F.col("category_l1"))
        ),
        "silver_po_lines": raw["purchase_orders"].withColumn(
            "qty", F.when(F.col("po_line") == 7, -F.col("qty")).when(F.col("po_line") != 5, F.col("qty"))
        ),
        "silver_contracts": raw["contracts"].withColumn(
            "unit_price", F.when(F.col("volume_commitment") % 3 > 0, F.col("unit_price")).otherwise(F.lit(0).cast("decimal(14,4)"))
        ),
    }


def _ruled(spark: SparkSession, sf_dir: str) -> quality.Ruled:
    tables = _faulty_tables(spark, sf_dir)
    return quality.store_ruled(tables, lambda name, df: storage.written(df, f"ruled-{name}"))


def dq_rules_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules judged while the tables are written: rows that passed, failed, and lie in quarantine."""
    ruled = _ruled(spark, sf_dir)
    held = ruled.quarantine.groupBy("rule_name").agg(F.count("*").alias("quarantined"))
    left = reduce(
        DataFrame.unionByName,
        [df.agg(F.lit(t).alias("table_name"), F.count("*").alias("kept")) for t, df in ruled.passed.items()],
    )
    return ruled.report.join(held, "rule_name", "left").join(left, "table_name", "left")


def sink_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _medallion(spark, sf_dir).over_written_lines()
    folder = storage.new_folder(spark, "exports")
    frames = {
        "leakage": m.leakage,
        "tco": m.tco,
        "opportunity": m.opportunity,
        "pvm_summary": m.pvm_summary,
    }
    for name, df in frames.items():
        storage.export_csv(df, f"{folder}/{name}.csv")
    storage.export_parquet(m.pvm, f"{folder}/pvm_detail.parquet")
    stored = {
        n: spark.read.schema(df.schema).option("header", True).csv(f"{folder}/{n}.csv")
        for n, df in frames.items()
    }
    stored["pvm_detail"] = spark.read.parquet(f"{folder}/pvm_detail.parquet")
    return _digests(
        stored,
        {
            "leakage": "rate_leakage",
            "tco": "tco",
            "opportunity": "opportunity_usd",
            "pvm_summary": "spend_change",
            "pvm_detail": "spend_change",
        },
    )


_VIEW_MEASURES = {
    "v_spend_cube": "spend",
    "v_price_variance": "leakage_amount",
    "v_tco_by_supplier": "tco",
    "v_maverick_spend": "spend",
    "v_executive_monthly": "total_spend",
    "v_pvm_monthly": "spend_change",
}


def sink_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    _star(spark, sf_dir).publish()
    names = _star(spark, sf_dir).publish()
    return _digests({n: spark.table(n) for n in names}, _VIEW_MEASURES)


# ---- registry calls


def _metric(names: tuple[str, ...], by: tuple[str, ...] = ()) -> Query:
    return _m(lambda m: metrics.metric_query(m.fact, m.dims(), names, by=by))


def _registry_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in metrics.MEASURES:
        found[f"measure_{name}"] = _metric((name,))
    for name in metrics.METRICS:
        found[f"metric_{name}"] = _metric((name,), by=("spend_type",))
    for name in metrics.DIMENSIONS:
        found[f"dimension_{name}"] = _metric(("total_spend",), by=(name,))
    found["metric_by_month"] = _m(lambda m: metrics.metric_by_month(m.fact, m.dims()))
    found["metric_by_hierarchy"] = _m(lambda m: metrics.metric_by_hierarchy(m.fact, m.dims()))
    found["metric_by_supplier_tier"] = _m(
        lambda m: metrics.metric_by_supplier_tier(m.fact, m.dims())
    )
    return found


def _cost_measures(b: OrderBook) -> DataFrame:
    invoices = b.raw_invoices().withColumnRenamed("unit_price", "actual_unit_price")
    terms = b.raw_suppliers().select("supplier_id", "payment_terms_days")
    return costing.derive_cost_measures(invoices.join(terms, "supplier_id")).select(
        "invoice_id",
        "invoice_line",
        "baseline_unit_price",
        "savings_realized",
        "payment_terms_cost",
        "tco_amount",
    )


def _mart_answers(m: Medallion) -> DataFrame:
    frames = {
        "total_spend": questions.mart_total_spend(m.monthly),
        "maverick": questions.mart_maverick(m.monthly),
        "compliance": questions.mart_compliance(m.monthly),
        "leakage": questions.mart_leakage(m.leakage),
        "should_cost": questions.mart_should_cost(m.category_spend),
        "top_suppliers": questions.mart_top_suppliers(m.performance),
        "direct_vs_indirect": questions.mart_direct_vs_indirect(m.monthly),
        "savings": questions.mart_savings(m.monthly),
        "risk": questions.mart_risk(m.supplier_risk()),
        "opportunity": questions.mart_opportunity(m.opportunity),
        "pvm": questions.mart_pvm(m.pvm_summary),
    }
    return questions.answer_rows(frames)


def _view_answers(s: Star) -> DataFrame:
    frames = {
        "total_spend": questions.view_total_spend(s.monthly),
        "leakage": questions.view_leakage(s.fact, s.suppliers, s.categories),
        "maverick": questions.view_maverick(s.fact, s.suppliers, s.categories),
        "tco": questions.view_tco(s.tco),
        "pvm": questions.view_pvm(s.pvm),
        "top_suppliers": questions.view_top_suppliers(s.supplier_category),
        "category": questions.view_category(s.supplier_category),
        "executive": questions.view_executive_trend(s.monthly),
    }
    return questions.answer_rows(frames)


def answer_questions_dk(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route_questions_dk(_log(spark, sf_dir))
    m = _medallion(spark, sf_dir).over_written_lines()
    # several answers read each of these
    m.monthly = storage.written(m.monthly, "monthly")
    m.performance = storage.written(m.performance, "performance")
    return questions.answered(routed, _mart_answers(m))


def answer_questions_pg(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route_questions_pg(_log(spark, sf_dir))
    return questions.answered(routed, _view_answers(_star(spark, sf_dir)))


def _filtered(names: tuple[str, ...], where: dict[str, object], by: tuple[str, ...] = ()) -> Query:
    return _m(lambda m: metrics.metric_query(m.fact, m.dims(), names, by=by, where=where))


def _supplier_sums(m: Medallion) -> DataFrame:
    """Supplier sums written once: the share of all spend reads them twice."""
    return storage.written(m.performance, "supplier-sums")


def _silver_quality(m: Medallion) -> DataFrame:
    return m.silver_quality.drop("checked_at")


def queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "src_bronze_ingest": src_bronze_ingest,
        "src_rejected_rows": src_rejected_rows,
        "src_missing_check": src_missing_check,
        "src_load_manifest": src_load_manifest,
        "src_star_tables": src_star_tables,
        "sink_replace_table": sink_replace_table,
        "sink_exports": sink_exports,
        "sink_views": sink_views,
        "warehouse_refresh": warehouse_refresh,
        "star_refresh": star_refresh,
        # conformance
        "silver_suppliers": _m(lambda m: m.suppliers.drop("_loaded_at_utc")),
        "silver_categories": _m(lambda m: m.categories),
        "silver_contracts": _m(lambda m: m.contracts),
        "silver_should_cost": _m(lambda m: m.should_cost),
        "silver_cost_centers": _m(
            lambda m: m.cost_centers.drop("_source_file", "_loaded_at_utc")
        ),
        "silver_purchase_orders": _m(lambda m: m.purchase_orders),
        "silver_invoices": _m(lambda m: m.invoices),
        "silver_gl_actuals": _m(lambda m: m.gl_actuals),
        # dimensional model and marts
        "dim_supplier": _m(lambda m: m.dim_supplier),
        "dim_category": _m(lambda m: m.dim_category),
        "dim_contract": _m(lambda m: m.dim_contract),
        "dim_cost_center": _m(
            lambda m: m.dim_cost_center.drop("_source_file", "_loaded_at_utc")
        ),
        "dim_calendar": _m(lambda m: m.dim_calendar),
        "fact_spend": _on(_over_stored_sides, lambda m: m.fact),
        "fact_spend_colocated": fact_spend_colocated,
        "rollup_products": rollup_products,
        "rollup_by_quarter": _on(_rolled, lambda m: m.by_quarter),
        "rollup_by_level": _on(_rolled, lambda m: m.by_level),
        "spend_cube": _on(_over_cube_lines, lambda m: m.cube),
        "mart_monthly_executive": _m(lambda m: m.monthly),
        "mart_supplier_performance": _m(lambda m: m.performance),
        "mart_category_spend": _m(lambda m: m.category_spend),
        "mart_finance_alignment": _m(lambda m: m.finance),
        "v_spend_under_management": _m(lambda m: marts.spend_under_management(m.fact)),
        "v_top_leakage_suppliers": _m(
            lambda m: marts.top_leakage_suppliers(m.fact, m.dim_supplier)
        ),
        # leakage, cost of ownership, opportunity
        "leakage": _m(lambda m: m.leakage),
        "tco": _m(lambda m: m.tco),
        "opportunity": _m(lambda m: m.opportunity),
        # price, volume, mix
        "pvm_monthly_base": _m(lambda m: pvm.pvm_monthly_base(m.fact)),
        "pvm_category_monthly": _m(lambda m: m.pvm),
        "pvm_latest_summary": _m(lambda m: m.pvm_summary),
        "v_pvm_monthly": _s(lambda s: s.pvm),
        # governed views
        "v_spend_cube": _s(lambda s: s.cube),
        "v_price_variance": _s(lambda s: s.variance),
        "v_tco_by_supplier": _s(lambda s: s.tco),
        "v_maverick_spend": _s(lambda s: s.maverick),
        "v_executive_monthly": _s(lambda s: s.monthly),
        # reads
        "kpi_executive": _s(lambda s: reads.kpi_executive(s.monthly, s.fact, s.suppliers)),
        "read_spend_cube": _s(lambda s: reads.read_spend_cube(s.cube)),
        "read_spend_cube_direct": _s(
            lambda s: reads.read_spend_cube(s.cube, direct_or_indirect="Direct", limit=2000)
        ),
        "read_price_variance": _s(lambda s: reads.read_price_variance(s.variance)),
        "read_price_variance_all": _s(
            lambda s: reads.read_price_variance(s.variance, flagged_only=False)
        ),
        "read_executive_monthly": _s(lambda s: reads.read_executive_monthly(s.monthly)),
        "read_pvm_latest": _s(lambda s: reads.read_pvm_latest(s.pvm)),
        "read_tco": _s(lambda s: reads.read_tco(s.tco)),
        "read_dq": _s(lambda s: quality.read_dq(s.dq_report)),
        "kpi_marts": _m(lambda m: reads.kpi_marts(m.monthly)),
        "leak_top_suppliers": _s(
            lambda s: reads.leak_top_suppliers(s.variance.where("variance_flag"))
        ),
        "pvm_bridge": _m(
            lambda m: reads.pvm_bridge(
                m.pvm_summary, ("Price effect", "Volume effect", "Mix effect")
            )
        ),
        "category_listing": _m(lambda m: reads.category_listing(m.category_spend)),
        "hierarchy_rollup_dk": _m(lambda m: reads.hierarchy_rollup_dk(m.category_spend)),
        "hierarchy_rollup_pg": _s(lambda s: reads.hierarchy_rollup_pg(s.supplier_category)),
        "opportunity_ranked": _m(lambda m: reads.opportunity_ranked(m.opportunity)),
        "tco_ranked": _m(lambda m: reads.tco_ranked(m.tco)),
        "leakage_top25": _m(lambda m: reads.leakage_top25(m.leakage)),
        "pvm_latest_ranked": _m(lambda m: reads.pvm_latest_ranked(m.pvm_summary)),
        "risk_ranked": _m(lambda m: reads.risk_ranked(m.supplier_risk())),
        "anomaly_top50": _m(lambda m: reads.anomaly_top50(m.spend_anomalies())),
        "finance_bu_rollup": _m(lambda m: reads.finance_bu_rollup(m.finance)),
        # governed questions over marts
        "q_dk_total_spend": _m(lambda m: questions.mart_total_spend(m.monthly)),
        "q_dk_maverick": _m(lambda m: questions.mart_maverick(m.monthly)),
        "q_dk_compliance": _m(lambda m: questions.mart_compliance(m.monthly)),
        "q_dk_leakage": _m(lambda m: questions.mart_leakage(m.leakage)),
        "q_dk_should_cost": _m(lambda m: questions.mart_should_cost(m.category_spend)),
        "q_dk_top_suppliers": _m(lambda m: questions.mart_top_suppliers(m.performance)),
        "q_dk_direct_vs_indirect": _m(lambda m: questions.mart_direct_vs_indirect(m.monthly)),
        "q_dk_savings": _m(lambda m: questions.mart_savings(m.monthly)),
        "q_dk_risk": _m(lambda m: questions.mart_risk(m.supplier_risk())),
        "q_dk_opportunity": _m(lambda m: questions.mart_opportunity(m.opportunity)),
        "q_dk_pvm": _m(lambda m: questions.mart_pvm(m.pvm_summary)),
        # governed questions over views
        "q_pg_total_spend": _s(lambda s: questions.view_total_spend(s.monthly)),
        "q_pg_leakage": _s(lambda s: questions.view_leakage(s.fact, s.suppliers, s.categories)),
        "q_pg_maverick": _s(lambda s: questions.view_maverick(s.fact, s.suppliers, s.categories)),
        "q_pg_tco": _s(lambda s: questions.view_tco(s.tco)),
        "q_pg_pvm": _s(lambda s: questions.view_pvm(s.pvm)),
        "q_pg_top_suppliers": _s(lambda s: questions.view_top_suppliers(s.supplier_category)),
        "q_pg_category": _s(lambda s: questions.view_category(s.supplier_category)),
        "q_pg_executive_trend": _s(lambda s: questions.view_executive_trend(s.monthly)),
        # logs
        "route_questions_dk": _on(_log, routing.route_questions_dk),
        "route_questions_pg": _on(_log, routing.route_questions_pg),
        "audit_sql_log": _b(lambda b: routing.audit_sql_log(routing.sql_log(b.table("conversations")))),
        "intent_usage": _on(_log, lambda log: routing.intent_usage(routing.route_questions_dk(log))),
        "answer_questions_dk": answer_questions_dk,
        "answer_questions_pg": answer_questions_pg,
        # registry calls with filters
        "filtered_by_year": _filtered(("total_spend", "rate_leakage"), {"fiscal_year": [1996, 1997]}, ("fiscal_month",)),
        "filtered_by_category": _filtered(("total_spend",), {"category_l1": "Direct"}, ("supplier_tier",)),
        "filtered_by_tier_and_quarter": _filtered(
            ("total_spend", "contract_compliance_rate"), {"supplier_tier": ["Strategic", "Preferred"], "fiscal_quarter": 2}
        ),
        # quality, anomalies, risk
        "dq_silver": _m(_silver_quality),
        "dq_null_keys": _s(lambda s: quality.dq_null_keys(s.fact, s.as_of)),
        "dq_negative_amount": _s(lambda s: quality.dq_negative_amount(s.fact, s.as_of)),
        "dq_duplicate_lines": _s(lambda s: quality.dq_duplicate_lines(s.fact)),
        "dq_null_rate": _s(lambda s: quality.dq_null_rate(s.fact, s.as_of)),
        "dq_future_dated": _s(lambda s: quality.dq_future_dated(s.fact, s.as_of)),
        "dq_report": _s(lambda s: s.dq_report.drop("check_no")),
        "dq_rules_declared": _m(lambda m: quality.dq_rules(m.rule_tables())),
        "dq_rules_stored": dq_rules_stored,
        "anomaly_features": _m(lambda m: _rounded(anomaly.anomaly_features(m.fact))),
        "spend_anomalies": _m(lambda m: m.spend_anomalies()),
        "anomaly_export": _m(lambda m: anomaly.anomaly_export(m.spend_anomalies())),
        "supplier_spend_share": _m(lambda m: risk.supplier_spend_share(_supplier_sums(m))),
        "supplier_risk_components": _m(
            lambda m: risk.supplier_risk_components(_supplier_sums(m))
        ),
        "supplier_risk": _m(lambda m: m.supplier_risk()),
        # contract matching and costing
        "match_active_contract": _s(
            lambda s: contracts.match_active_contract(s.fact, s.contracts)
        ),
        "contract_covered_lines": _s(lambda s: contracts.covered_lines(s.fact, s.contracts)),
        "contract_uncovered_lines": _s(lambda s: contracts.uncovered_lines(s.fact, s.contracts)),
        "derive_cost_measures": _b(_cost_measures),
        "should_cost_buildup": _b(
            lambda b: costing.should_cost_buildup(
                b.raw_should_cost().drop("should_cost_unit", "model_version", "confidence")
            )
        ),
        **_registry_queries(),
        **_llm_queries(),
    }


def _llm_queries() -> dict[str, Query]:
    if llm_queries is None:
        return {}
    return {**llm_queries.queries(), "pipeline": corpus_pipeline.run}


def _rounded(features: DataFrame) -> DataFrame:
    """Standardised values at six decimals; means and deviations depend on summation order."""
    return features.select(
        "invoice_id",
        "invoice_line",
        *[(F.floor(F.col(f) * 1e6 + 0.5).cast("double") / 1e6).alias(f) for f in anomaly.FEATURES],
    )


def oracle_sql() -> dict[str, str]:
    """The same results as SQL for DuckDB."""
    found = oracles.all_sql()
    if llm_sql is not None:
        found |= llm_sql.all_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the monthly executive view."""
    return queries()["v_executive_monthly"](spark, "/root/testdata/sf0.001")
