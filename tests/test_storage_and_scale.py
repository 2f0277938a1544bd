"""Sources, sinks, exact ranks, the forest, and behaviour under skew and repartitioning."""

import datetime as dt
import os
import random
import subprocess
import sys
from decimal import Decimal as D
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from outlay.functions.ordering import (
    percent_rank,
    quantile_at,
    value_positions,
)
from outlay.functions.relations import lookup, repeated_keys, unique_by
from outlay.operators import anomaly, model, rollup
from outlay.operators.routing import question_log
from outlay.plans.medallion import Medallion
from outlay.plans.rolled import RolledMedallion
from outlay.plans.warehouse import refresh_star, refresh_warehouse
from outlay.sources import extracts, star, storage
from outlay.sources.orderbook import OrderBook
from outlay.sources.schemas import EXTRACTS


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("extracts"))
    extracts.write_extracts(OrderBook(spark, small).raw(), path)
    return path


ROOT = Path(__file__).resolve().parents[1]


def test_missing_extract_is_named(spark, tmp_path):
    with pytest.raises(extracts.MissingExtract, match="suppliers.csv"):
        extracts.land_extracts(spark, str(tmp_path), "now")


def test_extracts_round_trip(spark, small, folder):
    landed = extracts.land_extracts(spark, folder, "now")
    assert set(landed) == set(EXTRACTS)
    raw = OrderBook(spark, small).raw()
    for name in ("contracts", "suppliers", "gl_actuals"):
        columns = EXTRACTS[name][1].names
        a, b = landed[name].select(*columns), raw[name].select(*columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert landed["invoices"].where(F.col("po_id").isNull()).count() == 1001


def one_extract(spark, folder, name, text):
    """Only `name` in a folder, as one file of the given lines."""
    place = folder / EXTRACTS[name][0]
    place.mkdir(parents=True, exist_ok=True)
    (place / "part-0.csv").write_text(text)
    return extracts.read_extract(spark, str(folder), name)


def test_columns_are_found_by_name_and_bad_cells_are_kept(spark, tmp_path):
    text = (
        "forecast_amount,cost_center_id,remark,category_id,gl_account,actual_amount,gl_period,budget_amount\n"
        "3.00,C1,x,CAT,62,1.50,2024-01,2.00\n"
        "3.00,C2,x,CAT,62,many,2024-01,2.00\n"
        '4.00,"C\n3, ""new""",,CAT,62,,2024-02,2.00\n'
        "5.00,C4\n"
    )
    df = one_extract(spark, tmp_path, "gl_actuals", text)
    landing = extracts.store_landed(
        {"gl_actuals": extracts.with_load_metadata(df, "gl_actuals.csv", "now")}, lambda n, d: storage.written(d, n)
    )
    rows = landing.bronze["gl_actuals"].orderBy("gl_period").collect()
    assert [(r["gl_period"], r["cost_center_id"], r["actual_amount"], r["forecast_amount"]) for r in rows] == [
        ("2024-01", "C1", D("1.50"), D("3.00")),
        ("2024-02", 'C\n3, "new"', None, D("4.00")),
    ]
    assert {r["record"].strip() for r in landing.rejects.collect()} == {"3.00,C2,x,CAT,62,many,2024-01,2.00", "5.00,C4"}
    assert (landing.accepted, landing.rejected) == ({"gl_actuals": 2}, {"gl_actuals": 2})
    assert extracts.load_manifest(spark, landing, "now").first()["row_count_total"] == 4


def test_a_missing_column_and_differing_headers_are_errors(spark, tmp_path):
    with pytest.raises(extracts.HeaderMismatch, match="business_unit"):
        one_extract(spark, tmp_path, "cost_centers", "cost_center_id,cost_center_name\n1,a\n")
    df = one_extract(spark, tmp_path, "categories", ",".join(EXTRACTS["categories"][1].names) + "\n")
    assert df.count() == 0
    one_extract(spark, tmp_path / "two", "cost_centers", "cost_center_id,cost_center_name,business_unit\n1,a,b\n")
    other = tmp_path / "two" / "cost_centers.csv" / "part-1.csv"
    other.write_text("business_unit,cost_center_name,cost_center_id\nb,a,2\n")
    with pytest.raises(Exception, match="header"):
        extracts.read_extract(spark, str(tmp_path / "two"), "cost_centers").collect()


def test_a_failed_refresh_leaves_the_old_rows(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(10).withColumn("part", F.col("id") % 2)
    try:
        storage.replace_table(rows, "swapped", ("part",), folder)
        bad = F.when(F.col("id") == 7, F.raise_error("half way").cast("bigint")).otherwise(F.col("id") + 1)
        with pytest.raises(Exception, match="half way"):
            storage.replace_table(rows.withColumn("id", bad), "swapped", ("part",), folder)
        assert sorted(map(tuple, spark.table("swapped").collect())) == [(i, i % 2) for i in range(10)]
        held = spark.table("swapped")
        assert storage.replace_table(rows.where("id < 3"), "swapped", ("part",), folder).count() == 3
        assert held.count() == 10 and spark.newSession().table("swapped").count() == 3
        plan = spark.table("swapped").where("part = 1")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in plan
        storage.replace_table(rows.where("id < 2"), "swapped", ("part",), folder)
        assert len(list((tmp_path / "t").glob("v-*"))) == 2
        wider = storage.replace_table(rows.withColumn("more", F.lit("x")), "swapped", ("part",), folder)
        assert wider.columns == ["id", "part", "more"] and wider.count() == 10
    finally:
        spark.sql("drop table if exists swapped")


def test_stored_sides_of_the_fact_are_not_exchanged(spark, small, tmp_path):
    m = entry._medallion(spark, small)
    sides = {"i": model.invoices_for_orders(m.invoices), "o": model.orders_for_invoices(m.purchase_orders)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = {
            n: storage.replace_table(df, f"side_{n}", folder=str(tmp_path / n), bucket_by=model.ORDER_BUCKETS, buckets=4)
            for n, df in sides.items()
        }
        assert len(list((tmp_path / "i").glob("v-*/*.parquet"))) == 4
        ordered = stored["o"].groupBy(*model.ORDER_BUCKETS).agg(F.sum("po_amount").alias("ordered"))
        plan = stored["i"].join(ordered, list(model.ORDER_BUCKETS), "left")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        fact = model.colocated_fact(stored["i"], stored["o"], model.category_levels(m.categories))
        text = fact._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(order_key" not in text and "hashpartitioning(po_id" not in text
        assert fact.exceptAll(m.fact).count() == 0 and fact.count() == m.fact.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in sides:
            spark.sql(f"drop table if exists side_{n}")


def test_products_are_derived_from_sums_alone(spark, small, tmp_path):
    """Only the base reads the fact; a grain comes from the narrowest one that holds it."""
    m = entry._medallion(spark, small)
    fact = storage.written(m.fact, "fact-once")
    reads = []

    def store(name, df):
        if fact.inputFiles()[0].rsplit("/", 1)[0] in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            reads.append(name)
        return storage.written(df, name)

    rolled = RolledMedallion(m.bronze, dt.date(1998, 6, 1), fact, store)
    rolled.dim_supplier = storage.written(m.dim_supplier, "dim")
    plain = Medallion(m.bronze, dt.date(1998, 6, 1), stored_fact=fact)
    plain.dim_supplier = rolled.dim_supplier
    assert reads == ["spend_base"]
    place = fact.inputFiles()[0].rsplit("/", 1)[0]
    for name in ("cube", "monthly", "performance", "category_spend", "leakage", "tco", "opportunity", "pvm", "pvm_summary"):
        mine, theirs = getattr(rolled, name), getattr(plain, name)
        assert place not in {f.rsplit("/", 1)[0] for f in mine.inputFiles()}, name
        kinds = [F.col(f.name).cast("decimal(38,6)") if "decimal" in f.dataType.simpleString() else F.col(f.name) for f in theirs.schema]
        a, b = mine.select(*kinds), theirs.select(*kinds)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    assert rolled.rollup.parent(("spend_type", "category_l3")) == rollup.SUPPLIER_GRAIN
    assert rolled.rollup.parent(("period_month",)) == rollup.MONTHLY_GRAIN
    with pytest.raises(KeyError):
        rolled.rollup.at("invoice_id")


def test_a_product_stores_only_the_grains_it_is_derived_from(spark, small):
    m, names = entry._medallion(spark, small), []

    def store(name, df):
        names.append(name)
        return storage.written(df, name)

    rolled = RolledMedallion(m.bronze, dt.date(1998, 6, 1), m.fact, store)
    assert rolled.by_level.count() > 0
    assert names == ["spend_base", "supplier_id_numbers", "category_suppliers"]


def shuffle_files(spark):
    """Shuffle files of the running session, in local mode."""
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(len(list(Path(f).rglob("shuffle_*.data"))) for f in folder)


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    rows = spark.range(1000).repartition(3)
    names = ("outlay_released_a", "outlay_released_b")
    before = shuffle_files(spark)
    try:
        storage.written(rows, "released")
        storage.replace_table(rows.withColumn("p", F.col("id") % 2), names[0], ("p",), str(tmp_path / "a"))
        storage.replace_table(rows, names[1], folder=str(tmp_path / "b"), bucket_by=("id",), buckets=2)
        storage.export_csv(rows, str(tmp_path / "c.csv"))
        storage.export_parquet(rows, str(tmp_path / "d.parquet"))
        assert shuffle_files(spark) <= before
    finally:
        for name in names:
            spark.sql(f"drop table if exists {name}")


def test_extracts_are_written_compressed(folder):
    parts = list(Path(folder, "invoices.csv").glob("part-*"))
    assert parts and all(p.name.endswith(".csv.gz") for p in parts)


def test_member_sets_count_as_distinct_does(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4), rng.choice([None, f"m{rng.randrange(70_000)}"])) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "g string, h int, member string").repartition(5)
    df = df.withColumns({m: F.lit(1) for m in rollup.MEASURES})
    lattice = rollup.Rollup(df, lambda name, d: storage.written(d, name), ("g", "h", "member"))
    sets = storage.written(lattice.member_sets("member", "g", "h"), "sets")
    sizes = rollup.set_sizes(rollup.merged_sets(sets, "g"), "n", "g")
    assert {r["g"]: r["n"] for r in sizes.collect()} == {
        g: len({m for x, _, m in rows if x == g and m is not None}) for g in ("a", "b", None)
    }


def test_calendar_comes_from_file_footers(spark, small, tmp_path):
    invoices = entry._medallion(spark, small).invoices
    invoices.write.parquet(str(tmp_path / "i"))
    span = storage.day_span(spark, str(tmp_path / "i"), "invoice_date")
    assert "PushedAggregation: [MIN(invoice_date), MAX(invoice_date)]" in span._jdf.queryExecution().executedPlan().toString()
    want = invoices.agg(F.min("invoice_date"), F.max("invoice_date")).first()
    assert tuple(span.first()) == tuple(want)


def test_catalog_views_outlive_the_session(spark):
    try:
        storage.publish_catalog_views(spark, {"v_a": spark.range(3), "v_b": spark.range(4)}, "seen", "seen_store")
        published = storage.publish_catalog_views(spark, {"v_a": spark.range(5).toDF("id")}, "seen", "seen_store")
        assert published == ["seen.v_a"]
        other = spark.newSession()
        assert other.table("seen.v_a").count() == 5 and other.table("seen.v_b").count() == 4
    finally:
        for name in ("seen", "seen_store"):
            spark.sql(f"drop database if exists {name} cascade")


def test_rules_hold_rows_back(spark, small):
    ruled = entry._ruled(spark, small)
    report = {r["rule_name"]: (r["passed"], r["failed"]) for r in ruled.report.collect()}
    assert len(report) == 5 and all(p > 0 and f > 0 for p, f in report.values())
    held = {r["rule_name"]: r["n"] for r in ruled.quarantine.groupBy("rule_name").agg(F.count("*").alias("n")).collect()}
    assert held == {name: f for name, (_, f) in report.items()}
    assert ruled.passed["silver_po_lines"].where("qty is null or qty <= 0").count() == 0


def test_star_refresh_stores_checks_with_their_time(spark, small, tmp_path):
    names = {n: f"t_{n}" for n in ("star", "semantic", "semantic_store")}
    try:
        at = dt.datetime(2024, 5, 1, 12)
        refresh_star(spark, OrderBook(spark, small).star(), dt.date(2001, 9, 1), at, str(tmp_path), names)
        checks = spark.newSession().table("t_star.data_quality_results").collect()
        assert len(checks) == 5 and {r["checked_at"] for r in checks} == {at}
        assert spark.newSession().table("t_semantic.v_executive_monthly").count() == 83
    finally:
        for name in names.values():
            spark.sql(f"drop database if exists {name} cascade")


def test_warehouse_refresh_and_invariants(spark, folder, tmp_path):
    args = (spark, folder, str(tmp_path / "exports"), dt.date(1998, 6, 1), "now", str(tmp_path / "tables"))
    try:
        refresh_warehouse(*args, buckets=4)
        built = refresh_warehouse(*args, buckets=4)
        fact = spark.table("gold.fact_spend")
        assert fact.count() == 6000
        assert spark.table("gold.spend_cube").count() > 100
        share = (
            spark.table("gold.mart_monthly_executive")
            .agg(F.sum("on_contract_spend") / F.sum("total_spend"))
            .first()[0]
        )
        assert 0 < share < 1
        assert spark.table("silver.data_quality_results").count() >= 4
        scores = spark.table("ml.supplier_risk")
        assert scores.where("supplier_risk_score between 0 and 1").count() == scores.count() == 10
        types = {r[0] for r in spark.table("analytics.opportunity").collect()}
        assert {"rate_leakage", "maverick_spend"} <= types
        monthly = built.monthly.agg(
            F.sum("direct_spend") + F.sum("indirect_spend"),
            F.sum("on_contract_spend") + F.sum("off_contract_spend"),
            F.sum("total_spend"),
        ).first()
        cube = spark.table("gold.spend_cube").agg(F.sum("spend")).first()[0]
        total = fact.agg(F.sum("invoice_amount")).first()[0]
        assert monthly[0] == monthly[1] == monthly[2] == total == cube
        exported = spark.read.option("header", True).csv(str(tmp_path / "exports/leakage.csv"))
        assert exported.count() == spark.table("analytics.leakage").count()
        assert spark.table("ml.spend_anomalies").where("is_anomaly").count() == 180
        assert spark.table("bronze._rejects").count() == 0
        calendar, days = spark.table("gold.dim_calendar"), spark.table("silver.invoices")
        assert calendar.count() == days.agg(F.datediff(F.max("invoice_date"), F.min("invoice_date")) + 1).first()[0]
        silver = {r["rule_name"]: (r["rows_passed"], r["rows_source"]) for r in spark.table("silver.data_quality_results").collect()}
        want = {r["rule_name"]: (r["rows_passed"], r["rows_source"]) for r in built.silver_quality.collect()}
        assert silver == want
    finally:
        for layer in ("ml", "analytics", "gold", "silver", "bronze"):
            spark.sql(f"drop database if exists {layer} cascade")


def test_views_are_replaced(spark):
    storage.publish_views({"v_once": spark.range(1)})
    storage.publish_views({"v_once": spark.range(5)})
    assert spark.table("v_once").count() == 5


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_average_ranks_equal_pandas(spark, slices):
    rng = random.Random(slices)
    values = [rng.choice([0.5, rng.random(), round(rng.random(), 1)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranked = value_positions(df, "x", slices).withColumn("score", percent_rank())
    want = pd.Series(values).rank(pct=True)
    got = {r["x"]: r["score"] for r in ranked.collect()}
    assert [got[v] for v in values] == pytest.approx(list(want))
    cuts = ranked.agg(*[quantile_at("score", q).alias(str(q)) for q in (0.0, 0.5, 0.8, 1.0)])
    assert list(cuts.first()) == pytest.approx(list(want.quantile([0.0, 0.5, 0.8, 1.0])))


def test_repeated_keys_keep_one_whole_row(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 9), (2, None, 3)], "k int, x string, y int")
    assert sorted(map(tuple, unique_by(rows, "k").collect())) == [(1, "a", 9), (2, None, 3)]
    assert repeated_keys(rows, "k").first()[0] == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        storage.shared_folder(Cluster)


def test_the_fact_is_not_read_by_one_task(spark):
    with pytest.raises(ValueError, match="key_ranges"):
        star.read_star_jdbc(spark, "jdbc:none", key_ranges={"dim_supplier": ("supplier_id", 0, 9)})


def fact_for_forest(spark, n, spikes=0):
    rng = np.random.default_rng(7)
    amount = rng.normal(100, 10, n)
    amount[:spikes] *= 50
    pdf = pd.DataFrame(
        {
            "invoice_id": [f"I{i}" for i in range(n)],
            "invoice_line": 1,
            "invoice_date": pd.Timestamp("2024-01-01").date(),
            "supplier_id": "S",
            "category_id": "C",
            "spend_type": "Direct",
            "category_l3": "L",
            "qty": rng.integers(1, 50, n).astype(float),
            "actual_unit_price": rng.normal(10, 1, n),
            "invoice_amount": amount,
            "contracted_unit_price": 10.0,
            "should_cost_unit": 9.0,
            "price_variance": rng.normal(0, 1, n),
            "should_cost_gap": rng.normal(0, 1, n),
            "on_contract": True,
            "maverick_flag": False,
        }
    )
    return spark.createDataFrame(pdf)


def test_forest_finds_spikes_and_ignores_partitioning(spark):
    fact = fact_for_forest(spark, 2000, spikes=5)
    first = anomaly.spend_anomalies(fact.repartition(2))
    second = anomaly.spend_anomalies(fact.repartition(5))
    a = {r["invoice_id"]: r["anomaly_score"] for r in first.collect()}
    b = {r["invoice_id"]: r["anomaly_score"] for r in second.collect()}
    assert a == pytest.approx(b)
    flagged = {r["invoice_id"] for r in first.where("is_anomaly").collect()}
    assert len(flagged) == 60
    assert {f"I{i}" for i in range(5)} <= flagged
    assert {r["anomaly_label"] for r in first.where("is_anomaly").collect()} == {-1}


def test_copies_of_a_line_weigh_in_the_trees(spark):
    """A line held 10,000 times among 40,000 others takes about a fifth of every tree's places."""
    one = fact_for_forest(spark, 1).withColumn("invoice_id", F.lit("hot"))
    many = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("copy")
    other = fact_for_forest(spark, 40_000)
    lines = anomaly.anomaly_lines(other.unionByName(many), "invoice_line")
    hot = anomaly.anomaly_lines(one, "invoice_line").select(anomaly._whole("invoice_amount")).first()[0]
    drawn = anomaly.subsamples(lines, 50_000, 50, 1)
    per_tree = drawn.groupBy("tree").agg(
        F.count("*").alias("places"), F.count(F.when(F.col("invoice_amount") == hot, 1)).alias("hot")
    )
    rows = per_tree.collect()
    assert len(rows) == 50 and all(r["places"] == 256 for r in rows)
    assert 40 <= sum(r["hot"] for r in rows) / 50 <= 63
    assert min(r["hot"] for r in rows) > 15


def test_forest_runs_where_workers_lack_the_library(small, tmp_path):
    """The functions shipped to workers name nothing of this library."""
    script = f"""
import os, sys
os.chdir({str(tmp_path)!r})
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from outlay.session import build_session
spark = build_session("local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
print("ROWS", entry.queries()["anomaly_top50"](spark, {small!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK", "SPARK"))}
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=600)
    assert "ROWS 50" in done.stdout, done.stderr[-2000:]


def test_leaves_at_full_depth_give_the_same_paths(spark):
    """Trees whose leaves all lie at full depth score as a walk that stops at each leaf does."""
    lines = anomaly.anomaly_lines(fact_for_forest(spark, 300), "invoice_line")
    forest = anomaly.fit_forest(lines, 300, trees=5)
    feature, cut, path = anomaly._levels(forest)
    assert path.shape == (5, 2**anomaly.DEPTH) and (feature >= 0).all()
    columns = [anomaly._whole(f) for f in anomaly.FEATURES]
    rows = lines.select(*columns, anomaly._path_total(spark, forest)(*columns).alias("total")).collect()

    def walked(x):
        found = 0
        for pick, at, paths in zip(forest["feature"], forest["cut"], forest["path"]):
            node = 0
            while pick[node] >= 0:
                node = 2 * node + 1 + (x[pick[node]] > at[node])
            found += paths[node]
        return found

    assert [r["total"] for r in rows] == [walked(r[:-1]) for r in rows]


def test_forest_on_few_identical_lines(spark):
    fact = fact_for_forest(spark, 1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(900))))
    scored = anomaly.spend_anomalies(fact.drop("copy"), trees=10)
    assert scored.count() == 900 and scored.where("is_anomaly").count() == 0


def skewed(spark, small):
    """The small order book with a third of its lines moved to one supplier and one part."""
    book = OrderBook(spark, small)
    lines = book.table("lineitem")
    hot = F.col("l_orderkey") % 3 == 0
    moved = lines.withColumns(
        {
            c: F.when(hot, F.lit(1).cast("bigint")).otherwise(F.col(c))
            for c in ("l_suppkey", "l_partkey")
        }
    )
    original = book.table
    book.table = lambda name: moved if name == "lineitem" else original(name)
    return book, moved


def test_hot_keys_keep_results_whole(spark, small):
    book, moved = skewed(spark, small)
    m = Medallion(extracts.bronze_frames(book.raw(), "now"), dt.date(1998, 6, 1))
    assert m.fact.count() == moved.count()
    by_supplier = {r["supplier_id"]: r["invoice_lines"] for r in m.performance.collect()}
    counted = moved.groupBy("l_suppkey").count().collect()
    assert by_supplier == {f"SUP-{r['l_suppkey']}": r["count"] for r in counted}
    assert m.supplier_risk().count() == len(counted)


def test_hot_keys_of_a_lookup_are_split(spark, tmp_path):
    """With broadcasts off, adaptive execution cuts the partition of a hot key."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    left = spark.range(0, 200_000, 1, 8).select(
        hot.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("a")).write.parquet(
        str(tmp_path / "side")
    )
    side = unique_by(spark.read.parquet(str(tmp_path / "side")), "id")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        total = lookup(left, side, {"id": F.col("k")}).agg(F.count("a"), F.max("v"))
        assert total.collect()[0][0] == 200_000
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_unread_joins_are_dropped(spark, small):
    fact = entry._medallion(spark, small).fact
    plan = fact.groupBy("supplier_id").agg(F.sum("invoice_amount"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and text.count("Relation") == 1


def test_jobs_of_several_products_read_the_lines_once(spark, small, monkeypatch):
    """Exports and answers read written lines: no product goes back to the order book."""
    seen = {}
    monkeypatch.setattr(entry.storage, "export_csv", lambda df, path, write=entry.storage.export_csv: (
        seen.__setitem__(path.rpartition("/")[2], df), write(df, path)))
    entry.sink_exports(spark, small)
    monkeypatch.setattr(entry.questions, "answer_rows", lambda frames, make=entry.questions.answer_rows: (
        seen.update(frames), make(frames))[1])
    entry.answer_questions_dk(spark, small)
    assert len(seen) == 15
    for name, df in seen.items():
        assert not any("lineitem" in f for f in df.inputFiles()), name


def test_effects_add_up(spark, small):
    m = entry._medallion(spark, small)
    off = m.pvm.where(
        F.abs(
            F.col("price_effect") + F.col("volume_effect") + F.col("mix_effect")
            - F.col("spend_change")
        )
        > 0.01
    )
    assert off.count() == 0
    assert m.pvm.where("mix_effect <> 0").count() == 0


def test_question_log_grows_with_the_turns(spark, small):
    turns = OrderBook(spark, small).table("conversations")
    assert question_log(turns).count() == turns.where("role = 'user'").count()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 83 and df.columns[0] == "period_month"


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_order_lines_are_grouped_where_they_lie(spark, small):
    """The file is dealt out once on the order line; grouping by it is a hash aggregation that
    needs no exchange of its own."""
    grouped = OrderBook(spark, small).raw_purchase_orders().select("po_id", "po_line", "po_amount")
    _, plan = physical(grouped)
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
    assert "SortAggregate" not in plan and "Sort [" not in plan and "HashAggregate" in plan


def test_lines_read_in_many_parts_are_not_dealt_out_again(spark, small):
    """Invoices exchange lines before their joins only where the file gives fewer parts than cores."""
    few = OrderBook(spark, small).raw_invoices()
    settings = {"spark.sql.files.maxPartitionBytes": "4KB", "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        book = OrderBook(spark, small)
        many, orders = book.raw_invoices(), book.raw_purchase_orders()
        assert "REPARTITION_BY_COL" in physical(few)[1] and "REPARTITION_BY_COL" not in physical(many)[1]
        assert "REPARTITION_BY_COL" in physical(orders)[1]
        assert many.exceptAll(few).isEmpty() and many.count() == few.count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def same_rows(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_buckets_are_written_without_an_exchange(spark, tmp_path):
    """Every task adds a file to each bucket, and equal buckets are joined and summed where they lie."""
    rows = spark.range(0, 1000, 1, 3).select("id", (F.col("id") % 7).alias("k"))
    before = shuffle_files(spark), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    stored = storage.in_buckets(rows, str(tmp_path / "b"), ("k",), 2)
    files = list((tmp_path / "b").glob("v-*/*.parquet"))
    assert len(files) == 6 and all(f.name.endswith(".zstd.parquet") for f in files)
    assert (shuffle_files(spark), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == before
    summed = stored.groupBy("k").agg(F.count("*").alias("n"))
    assert "Exchange" not in physical(summed)[1]
    assert {r["k"]: r["n"] for r in summed.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}
    with storage.dealt(rows, ("k",), 2) as dealt:
        place = Path(dealt.inputFiles()[0].removeprefix("file:")).parents[1]
        assert same_rows(dealt, rows) and place.exists()
    assert not place.exists()


def test_partitions_are_written_without_an_exchange_if_rows_are_not_gathered(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 3).withColumn("p", F.col("id") % 2)
    try:
        stored = storage.replace_table(rows, "ungathered", ("p",), str(tmp_path / "t"), gather=False)
        assert len(list((tmp_path / "t").glob("v-*/p=*/*.parquet"))) == 6 and same_rows(stored, rows)
    finally:
        storage.drop_table(spark, "ungathered")
    assert not (tmp_path / "t").exists()


@pytest.mark.parametrize("buckets", [1, 5])
def test_stored_sides_and_cube_lines_give_the_same_rows(spark, small, buckets):
    """Neither the join of invoices and order lines nor the cube's sum exchanges lines."""
    m = entry._medallion(spark, small)
    fact = m.over_stored_sides(buckets).fact
    text = physical(fact)[1]
    assert same_rows(fact, m.fact) and "order_key" in text and "hashpartitioning(order_key" not in text
    assert "hashpartitioning(category_id" not in text and "BroadcastHashJoin" in text
    cube = m.over_cube_lines(buckets).cube
    assert same_rows(cube, m.cube) and "hashpartitioning(period_month" not in physical(cube)[1]


def test_invoices_without_orders_and_repeated_orders_in_buckets(spark):
    """A line without an order has none, also where it repeats; a repeated order line counts once per invoice."""
    columns = {c: F.lit(None).cast("decimal(14,2)") for c in model.INVOICE_COLUMNS}
    invoices = spark.createDataFrame(
        [("I1", 1, "P1", "C"), ("I1", 1, "P1", "C"), ("I2", 1, None, None), ("I2", 1, None, "C"), ("I3", None, "P1", "D"), (None, 1, None, "C")],
        "invoice_id string, invoice_line int, po_id string, category_id string",
    )
    invoices = invoices.withColumns({c: v for c, v in columns.items() if c not in invoices.columns}).withColumns(
        {"invoice_date": F.lit(dt.date(2024, 1, 5)), "period_month": F.lit(dt.date(2024, 1, 1))}
    )
    orders = spark.createDataFrame(
        [("P1", 1, D("2.00")), ("P1", 1, D("3.00")), (None, 1, D("9.00")), ("P2", 1, D("1.00"))],
        "po_id string, po_line int, po_amount decimal(14,2)",
    )
    levels = spark.createDataFrame([("C", "Direct", "A", "B")], "category_id string, spend_type string, category_l2 string, category_l3 string")
    plain = model.fact_spend(invoices, orders, levels)
    stored = model.colocated_fact(model.invoices_for_orders(invoices), model.orders_for_invoices(orders), levels)
    assert plain.columns == stored.columns and same_rows(stored, plain)
    assert sorted(r["po_amount"] for r in stored.collect()) == [0, 0, 0, 0, 5, 5]


def test_lookups_exchange_lines_as_they_were_read(spark, small):
    """Rates and amounts are worked out above the joins, so no exchange carries them."""
    plan = OrderBook(spark, small).raw_invoices()._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan[: plan.index("Join")] and "FLOOR" not in plan[plan.index("Join") :]


def test_the_supplier_grain_is_summed_where_it_lies(spark, small):
    m, plans = entry._medallion(spark, small), {}

    def store(name, df):
        plans[name] = physical(df)[1]
        return storage.written(df, name)

    args = m.bronze, dt.date(1998, 6, 1), storage.written(m.fact, "fact"), store
    dealt = RolledMedallion(*args, deal=lambda rows, keys: storage.dealt(rows, keys, 3))
    found = dealt.by_supplier
    assert "Exchange" not in plans["spend_by_supplier"]
    assert same_rows(found, RolledMedallion(*args).by_supplier) and "Exchange" in plans["spend_by_supplier"]


def test_scratch_of_a_job_goes_when_it_is_not_read_again(spark, small):
    """Extracts go when they are landed, sides when the cube's lines are stored, these when the sums are."""
    folder = entry._extracts_folder(spark, small)
    assert entry._landing(spark, folder).accepted["invoices"] == 6000
    assert list(Path(folder.removeprefix("file:")).glob("*.csv")) == []
    scratch = Path(storage.session_folder(spark).removeprefix("file:"))
    before = set(scratch.iterdir())
    assert entry._rolled(spark, small).by_level.count() > 0
    assert {p.name.split("-")[0] for p in set(scratch.iterdir()) - before} == {"rolled", "levels"}
