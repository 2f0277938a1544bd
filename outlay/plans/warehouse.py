"""Full refresh of the stored warehouse, layer by layer, and of the star side."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from outlay.functions.numeric import count_if
from outlay.operators import model, quality, views
from outlay.operators.anomaly import anomaly_export
from outlay.operators.marts import CUBE_KEYS
from outlay.plans.medallion import CUBE_COLUMNS, Medallion
from outlay.plans.rolled import RolledMedallion
from outlay.plans.star import Star
from outlay.sources.extracts import land_extracts, load_manifest, store_landed
from outlay.sources.storage import (
    day_span,
    dealt,
    drop_table,
    export_csv,
    export_parquet,
    location_of,
    publish_catalog_views,
    replace_table,
)

LAYERS = ("bronze", "silver", "gold", "analytics", "ml")
#: Buckets of the two sides that the fact joins; a bucket should fit a task.
BUCKETS = 64

Store = Callable[[str, DataFrame], DataFrame]


def layer_store(spark: SparkSession, layer: str, folder: str | None, prefix: str = "", **how) -> Store:
    """How frames of a layer are stored: as tables of its database, below a folder if one is given."""
    spark.sql(f"create database if not exists {layer}")

    def store(name: str, df: DataFrame) -> DataFrame:
        place = f"{folder.rstrip('/')}/{layer}/{prefix}{name}" if folder else None
        return replace_table(df, f"{layer}.{prefix}{name}", folder=place, **how)

    return store


def _counted(store: Store, name: str, df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """Store a frame and count its rows on the way."""
    seen = Observation()
    counts = [count_if(c).alias(n) for n, c in conditions.items()]
    stored = store(name, df.observe(seen, F.count("*").alias("rows"), *counts))
    return stored, seen.get


def refresh_warehouse(
    spark: SparkSession,
    extracts_folder: str,
    exports_folder: str,
    as_of: dt.date,
    loaded_at: str,
    tables_folder: str | None = None,
    databases: Mapping[str, str] | None = None,
    buckets: int = BUCKETS,
    landed: Callable[[str], None] = lambda name: None,
) -> RolledMedallion:
    """Land, conform, model and score; each layer reads the stored tables of the one before.

    Counts ride on the writes. Invoices and order lines are stored in equal buckets, so the fact joins
    them where they lie; the two copies go when the fact is stored. The fact is stored by month and read
    once, for the sums that all gold and analytics products are derived from. `databases` renames layers, `landed` hears
    the name of every extract that is stored.
    """
    named = {layer: layer for layer in LAYERS} | dict(databases or {})

    def layer(name: str, prefix: str = "", **how) -> Store:
        return layer_store(spark, named[name], tables_folder, prefix, **how)

    landing = store_landed(land_extracts(spark, extracts_folder, loaded_at), layer("bronze", "bronze_"), landed)
    layer("bronze")("_load_manifest", load_manifest(spark, landing, loaded_at))
    layer("bronze")("_rejects", landing.rejects)

    conformed, silver = Medallion(landing.bronze, as_of), layer("silver")
    ready: dict[str, DataFrame] = {}
    ready["suppliers"], suppliers = _counted(
        silver, "suppliers", conformed.suppliers, duplicates=F.col("potential_duplicate_flag")
    )
    ready["categories"], categories = _counted(
        silver, "categories", conformed.categories, valid=F.col("hierarchy_valid")
    )
    ready["invoices"], invoices = _counted(silver, "invoices", conformed.invoices)
    for name in ("contracts", "should_cost", "cost_centers", "purchase_orders", "gl_actuals"):
        ready[name] = silver(name, getattr(conformed, name))
    landed = {n: landing.accepted[n] for n in landing.accepted}
    silver("data_quality_results", quality.dq_silver_counted(spark, landed, suppliers, invoices["rows"], categories))

    levels = model.category_levels(ready["categories"])
    in_buckets = layer("silver", "by_order_", bucket_by=model.ORDER_BUCKETS, buckets=buckets)
    fact = layer("gold", partition_by=("period_month",), gather=False)(
        "fact_spend",
        model.colocated_fact(
            in_buckets("invoices", model.invoices_for_orders(ready["invoices"])),
            in_buckets("purchase_orders", model.orders_for_invoices(ready["purchase_orders"])),
            levels,
        ),
    )
    for side in ("invoices", "purchase_orders"):
        drop_table(spark, f"{named['silver']}.by_order_{side}")

    gold = layer("gold")

    def deal(rows: DataFrame, keys: Sequence[str]):
        return dealt(rows, keys, buckets)

    with deal(fact.select(*CUBE_COLUMNS), CUBE_KEYS) as lines:
        modelled = RolledMedallion(landing.bronze, as_of, lines, gold, deal=deal)
    modelled.stored_fact = fact
    for name, table in ready.items():
        setattr(modelled, name, table)
    span = day_span(spark, location_of(spark, f"{named['silver']}.invoices"), "invoice_date").first()
    bounds = spark.range(1).select(*[F.lit(span[c]).cast("date").alias(c) for c in ("first", "last")])
    modelled.dim_calendar = model.calendar(bounds)
    stored = {name: gold(name, df) for name, df in modelled.dims().items()}
    modelled.dim_supplier = stored["dim_supplier"]
    modelled.performance = gold("mart_supplier_performance", modelled.performance)
    for name, df in modelled.gold().items():
        if name not in stored and name != "mart_supplier_performance":
            gold(name, df)

    analytics = layer("analytics")
    modelled.pvm = analytics("pvm_category_monthly", modelled.pvm)
    products = {"pvm_category_monthly": modelled.pvm}
    for name, df in modelled.analytics().items():
        if name not in products:
            products[name] = analytics(name, df)
    ml = layer("ml")
    scores = {
        "supplier_risk": ml("supplier_risk", modelled.supplier_risk()),
        "spend_anomalies": ml("spend_anomalies", modelled.spend_anomalies()),
    }
    write_exports(products, scores, exports_folder)
    return modelled


def refresh_star(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    as_of: dt.date,
    checked_at: dt.datetime,
    tables_folder: str | None = None,
    databases: Mapping[str, str] | None = None,
) -> Star:
    """Store the star tables, run and store the fact checks with their time, and publish the governed
    views, which outlive the session. Checks and views read the stored tables."""
    named = {n: n for n in ("star", "semantic", "semantic_store")} | dict(databases or {})
    store = layer_store(spark, named["star"], tables_folder)
    star = Star({name: store(name, df) for name, df in tables.items()}, as_of)
    store("data_quality_results", quality.dq_results(star.dq_report, checked_at))
    publish_catalog_views(
        spark,
        views.semantic_views(star.fact, star.suppliers, star.categories),
        named["semantic"],
        named["semantic_store"],
        f"{tables_folder.rstrip('/')}/{named['semantic_store']}" if tables_folder else None,
    )
    return star


def write_exports(
    analytics: Mapping[str, DataFrame], scores: Mapping[str, DataFrame], folder: str
) -> None:
    """The file exports: five CSV tables, the flagged anomalies and the price-volume-mix detail."""
    folder = folder.rstrip("/")
    for name in ("leakage", "tco", "opportunity"):
        export_csv(analytics[name], f"{folder}/{name}.csv")
    export_parquet(analytics["pvm_category_monthly"], f"{folder}/pvm_detail.parquet")
    export_csv(analytics["pvm_latest_summary"], f"{folder}/pvm_summary.csv")
    export_csv(scores["supplier_risk"], f"{folder}/supplier_risk_scores.csv")
    export_csv(anomaly_export(scores["spend_anomalies"]), f"{folder}/spend_anomalies.csv")
