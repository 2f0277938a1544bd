"""Small frames, one per place where the definitions are easy to get wrong."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from outlay.functions.numeric import half_up
from outlay.operators import (
    conform,
    contracts,
    leakage,
    marts,
    metrics,
    model,
    pvm,
    quality,
    reads,
    risk,
    routing,
    views,
)

DAY = dt.date(2024, 1, 15)


def fact_rows(spark, *rows):
    """Invoice-line fact from partial dicts."""
    base = {
        "invoice_id": "I1",
        "period_month": dt.date(2024, 1, 1),
        "supplier_id": "S1",
        "category_id": "C1",
        "qty": D("1.00"),
        "invoice_amount": D("10.00"),
        "price_variance": D("0.000000"),
        "should_cost_gap": D("0.000000"),
        "savings_realized": D("0.00"),
        "tco_amount": D("10.00"),
        "on_contract": True,
        "maverick_flag": False,
        "spend_type": "Direct",
        "category_l3": "L3",
    }
    schema = (
        "invoice_id string, period_month date, supplier_id string, category_id string, "
        "qty decimal(14,2), invoice_amount decimal(14,2), price_variance decimal(20,6), "
        "should_cost_gap decimal(20,6), savings_realized decimal(14,2), "
        "tco_amount decimal(14,2), on_contract boolean, maverick_flag boolean, "
        "spend_type string, category_l3 string"
    )
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schema)


def star_rows(spark, *rows):
    base = {
        "transaction_id": 1,
        "supplier_id": 1,
        "category_id": "C1",
        "contract_id": 1,
        "po_number": "PO-1",
        "line_number": 1,
        "invoice_amount": D("10.00"),
        "negotiated_rate": D("1.0000"),
        "actual_rate": D("1.0000"),
        "quantity": D("10.00"),
        "spend_date": DAY,
        "cost_center": "CC",
        "is_maverick": False,
    }
    schema = (
        "transaction_id bigint, supplier_id bigint, category_id string, contract_id bigint, "
        "po_number string, line_number int, invoice_amount decimal(14,2), "
        "negotiated_rate decimal(14,4), actual_rate decimal(14,4), quantity decimal(14,2), "
        "spend_date date, cost_center string, is_maverick boolean"
    )
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schema)


def star_dims(spark, tier="Low"):
    suppliers = spark.createDataFrame(
        [(1, "Acme", tier, "EU")], "supplier_id bigint, name string, risk_tier string, region string"
    )
    categories = spark.createDataFrame(
        [("C1", "Steel", "Metals", "Direct")],
        "category_id string, name string, parent_category string, direct_or_indirect string",
    )
    return suppliers, categories


def month(n):
    return dt.date(2024, n, 1)


def test_prior_month_is_the_previous_one_present(spark):
    fact = fact_rows(
        spark,
        {"period_month": month(1), "qty": D("2"), "invoice_amount": D("20")},
        {"period_month": month(3), "qty": D("4"), "invoice_amount": D("60")},
    )
    (row,) = pvm.pvm_category_monthly(fact).collect()
    assert row["period_month"] == month(3)
    assert (row["prev_volume"], row["prev_spend"]) == (D("2"), D("20"))
    assert (row["price_effect"], row["volume_effect"]) == (D("20"), D("20"))
    assert row["spend_change"] == D("40") and row["mix_effect"] == 0


def test_month_after_zero_volume(spark):
    fact = fact_rows(
        spark,
        {"period_month": month(1), "qty": D("0")},
        {"period_month": month(2), "qty": D("10")},
    )
    assert pvm.pvm_category_monthly(fact).count() == 0
    star = star_rows(
        spark,
        {"spend_date": dt.date(2024, 1, 5), "quantity": D("0")},
        {"spend_date": dt.date(2024, 2, 5), "quantity": D("10")},
    )
    (row,) = pvm.v_pvm_monthly(star, star_dims(spark)[1]).collect()
    assert row["price_effect"] is None and row["spend_change"] == 0


def test_unknown_contract_flag(spark):
    fact = fact_rows(spark, {"on_contract": None})
    (monthly,) = marts.mart_monthly_executive(fact).collect()
    assert (monthly["on_contract_spend"], monthly["off_contract_spend"]) == (0, 0)
    suppliers = spark.createDataFrame(
        [("S1", "Acme", "Preferred")],
        "supplier_id string, supplier_name string, supplier_tier string",
    )
    (leak,) = leakage.leakage(fact, suppliers).collect()
    assert leak["off_contract_spend"] == D("10")
    stack = {r[0]: r[1] for r in leakage.opportunity(fact).collect()}
    assert stack["off_contract_spend"] == 0


def bronze_suppliers(spark, *names):
    rows = [(f"S{i}", name, alias) for i, (name, alias) in enumerate(names)]
    df = spark.createDataFrame(
        rows, "supplier_id string, supplier_name string, supplier_name_alias string"
    )
    for column, kind in {
        "country": "string",
        "tier": "string",
        "primary_category_id": "string",
        "payment_terms_days": "int",
        "diversity_flag": "boolean",
        "active_flag": "boolean",
        "risk_score_seed": "double",
        "on_time_delivery_hist": "double",
        "quality_ppm_hist": "int",
        "_loaded_at_utc": "string",
    }.items():
        df = df.withColumn(column, F.lit(None).cast(kind))
    return df


def test_name_keys_and_duplicates(spark):
    df = bronze_suppliers(
        spark,
        ("  Apex Industrial Metals ", None),
        ("Atlas Iron Mill", None),
        ("acme", None),
        ("Apex Industrial Metals LLC", "APEXINDUSTRIAL"),
        (None, "X"),
    )
    rows = {r["supplier_id"]: r for r in conform.silver_suppliers(df).collect()}
    assert len(rows) == 4
    assert [rows[f"S{i}"]["name_key"] for i in range(4)] == ["AIM", "AIM", "", "APEXINDUSTRIAL"]
    assert [rows[f"S{i}"]["potential_duplicate_flag"] for i in range(4)] == [
        True,
        True,
        False,
        False,
    ]
    assert rows["S0"]["supplier_name"] == "Apex Industrial Metals"
    strict = {r["supplier_id"]: r["name_key"] for r in conform.silver_suppliers(df, True).collect()}
    assert strict["S0"] == "APEXINDUSTRIALMETALS" and strict["S2"] == "ACME"


def test_contract_status_follows_the_day(spark):
    rows = [
        ("ended", dt.date(2023, 1, 1), dt.date(2024, 1, 14), "Active", D("1")),
        ("future", dt.date(2024, 1, 16), dt.date(2025, 1, 1), "Active", D("1")),
        ("blank", dt.date(2024, 1, 15), dt.date(2024, 1, 15), "", D("1")),
        ("null", dt.date(2024, 1, 1), dt.date(2025, 1, 1), None, D("1")),
        ("set", dt.date(2024, 1, 1), dt.date(2025, 1, 1), "Renewal", D("1")),
        ("free", dt.date(2024, 1, 1), dt.date(2025, 1, 1), "Renewal", D("0")),
    ]
    df = spark.createDataFrame(
        rows,
        "contract_id string, start_date date, end_date date, status string, "
        "unit_price decimal(14,4)",
    )
    for column in (
        "supplier_id category_id contract_name currency volume_commitment rebate_pct escalation_pct"
    ).split():
        df = df.withColumn(column, F.lit(None).cast("string"))
    got = {r["contract_id"]: r["status"] for r in conform.silver_contracts(df, DAY).collect()}
    assert got == {
        "ended": "Expired",
        "future": "Future",
        "blank": "Active",
        "null": "Active",
        "set": "Renewal",
    }


def test_variance_boundary_and_missing_rates(spark):
    suppliers, categories = star_dims(spark)
    fact = star_rows(
        spark,
        {"transaction_id": 1, "actual_rate": D("1.0500")},
        {"transaction_id": 2, "actual_rate": D("1.0501")},
        {"transaction_id": 3, "negotiated_rate": D("0"), "actual_rate": D("1")},
        {"transaction_id": 4, "negotiated_rate": None},
        {"transaction_id": 5, "contract_id": None},
        {"transaction_id": 6, "actual_rate": D("2"), "invoice_amount": D("-1")},
    )
    rows = {
        r["transaction_id"]: r for r in views.v_price_variance(fact, suppliers, categories).collect()
    }
    assert sorted(rows) == [1, 2, 3]
    assert [rows[i]["variance_flag"] for i in (1, 2, 3)] == [False, True, False]
    assert [rows[i]["variance_pct"] for i in (1, 2, 3)] == [D("5.00"), D("5.01"), None]
    assert rows[2]["leakage_amount"] == D("0.50")
    (monthly,) = views.v_executive_monthly(fact, categories).collect()
    assert monthly["txn_count"] == 5
    assert monthly["rate_leakage"] == D("10.50")  # the zero rate counts in this view


@pytest.mark.parametrize(
    "tier, risk_cost, switching",
    [("High", "0.80", "0.50"), ("Medium", "0.40", "0.20"), ("Low", "0.15", "0.10"), (None, "0.15", "0.10")],
)
def test_cost_of_ownership_by_tier(spark, tier, risk_cost, switching):
    suppliers, _ = star_dims(spark, tier)
    (row,) = views.v_tco_by_supplier(star_rows(spark, {}), suppliers).collect()
    assert (row["risk_quality_cost"], row["switching_cost_est"]) == (D(risk_cost), D(switching))
    assert row["tco"] == D("10") + D(risk_cost) + D(switching)


def test_quality_report(spark):
    fact = star_rows(
        spark,
        {"spend_date": DAY + dt.timedelta(30)},
        {"spend_date": DAY + dt.timedelta(31), "po_number": "PO-2"},
        {"invoice_amount": D("-125"), "po_number": "PO-3"},
        {"supplier_id": None, "po_number": "PO-4"},
        {"actual_rate": None, "po_number": "PO-4"},
    )
    rows = [tuple(r) for r in quality.read_dq(quality.dq_report(fact, DAY)).collect()]
    assert [r[:3] for r in rows] == [
        ("null_supplier_or_category", "fail", 1),
        ("negative_invoice_amounts", "warn", 1),
        ("duplicate_po_lines", "fail", 1),
        ("actual_rate_null", "fail", 1),
        ("future_dated_spend", "warn", 1),
    ]
    assert rows[1][3] == "Negative invoice amounts require finance review (count=1)"
    empty = quality.dq_report(fact.limit(0), DAY).collect()
    assert {r["status"] for r in empty} == {"pass"} and {r["row_count"] for r in empty} == {0}


def test_null_predicate_fails_its_row(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "qty int")
    (row,) = quality.dq_rules({"t": df}, [("positive", "t", "qty > 0")]).collect()
    assert (row["passed"], row["failed"]) == (1, 2)


def invoice_frames(spark):
    """Three invoice lines, two of them without an order, over a doubled order line."""
    invoices = spark.createDataFrame(
        [("I1", 1, "P1"), ("I2", 1, None), ("I3", 1, None)],
        "invoice_id string, invoice_line int, po_id string",
    )
    fixed = {
        "invoice_date": ("2024-01-15", "date"),
        "period_month": ("2024-01-01", "date"),
        "supplier_id": ("S1", "string"),
        "category_id": ("C1", "string"),
        "contract_id": (None, "string"),
        "cost_center_id": ("CC", "string"),
        "business_unit": ("BU", "string"),
        "qty": ("2", "decimal(14,2)"),
        "actual_unit_price": ("5", "decimal(14,4)"),
        "contracted_unit_price": ("4", "decimal(14,4)"),
        "baseline_unit_price": ("6", "decimal(14,4)"),
        "should_cost_unit": ("3", "decimal(14,4)"),
        "invoice_amount": ("10", "decimal(14,2)"),
        "savings_realized": ("0", "decimal(14,2)"),
        "freight_cost": ("0", "decimal(14,2)"),
        "quality_cost": ("0", "decimal(14,2)"),
        "payment_terms_cost": ("0", "decimal(14,2)"),
        "tco_amount": ("10", "decimal(14,2)"),
        "on_contract": ("true", "boolean"),
        "maverick_flag": ("false", "boolean"),
        "payment_status": ("Paid", "string"),
    }
    for name, (value, kind) in fixed.items():
        invoices = invoices.withColumn(name, F.lit(value).cast(kind))
    orders = spark.createDataFrame(
        [("P1", 1, D("7")), ("P1", 1, D("8")), (None, 1, D("99"))],
        "po_id string, po_line int, po_amount decimal(14,2)",
    )
    categories = spark.createDataFrame(
        [("C1", "Direct", "Metals", "Steel")],
        "category_id string, category_l1 string, category_l2 string, category_l3 string",
    )
    return invoices, orders, model.category_levels(categories)


def test_repeated_order_lines_do_not_multiply_invoices(spark):
    fact = model.fact_spend(*invoice_frames(spark))
    rows = {r["invoice_id"]: r for r in fact.collect()}
    assert len(rows) == 3 and fact.count() == 3
    assert rows["I1"]["po_amount"] == D("15")
    assert rows["I2"]["po_amount"] == rows["I3"]["po_amount"] == 0
    assert rows["I1"]["price_variance"] == D("2") and rows["I1"]["should_cost_gap"] == D("4")
    assert rows["I1"]["date_key"] == 20240115 and rows["I1"]["category_l3"] == "Steel"


def test_calendar(spark):
    days = spark.createDataFrame(
        [(dt.date(2023, 12, 30),), (dt.date(2024, 1, 2),)], "invoice_date date"
    )
    rows = model.dim_calendar(days).orderBy("date_key").collect()
    assert [r["date_key"] for r in rows] == [20231230, 20231231, 20240101, 20240102]
    assert rows[0]["fiscal_quarter"] == 4 and rows[2]["year_month"] == "2024-01"
    assert model.dim_calendar(days.limit(0)).count() == 0


@pytest.mark.parametrize("months, expected", [(12, None), (13, 100.0), (14, 100.0)])
def test_year_on_year_counts_rows(spark, months, expected):
    rows = [(dt.date(2023 + i // 12, 1 + i % 12, 1), D(100)) for i in range(months - 1)]
    rows.append((dt.date(2023 + (months - 1) // 12, 1 + (months - 1) % 12, 1), D(200)))
    monthly = spark.createDataFrame(rows, "period_month date, total_spend decimal(14,2)")
    monthly = monthly.withColumns({"rate_leakage": F.lit(D(0)), "maverick_spend": F.lit(D(0))})
    fact = star_rows(spark, {}, {"invoice_amount": D("-5")})
    (row,) = reads.kpi_executive(monthly, fact, star_dims(spark)[0]).collect()
    assert row["yoy_change_pct"] == expected
    assert row["contract_compliance_pct"] == 50.0  # (10 - 5) over 10
    assert (row["supplier_count"], row["transaction_count"]) == (1, 1)


def intents(spark, patterns, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, question string")
    routed = df.withColumn("intent", routing.intent_of(F.col("question"), patterns))
    return [r["intent"] for r in routed.orderBy("i").collect()]


def test_first_matching_intent_wins(spark):
    assert intents(
        spark,
        routing.MART_INTENTS,
        "biggest savings",
        "price variance risk",
        "OPPORTUNITIES",
        "why did spend go up",
        "is there risk",
        "anything else",
        "where do we\rfind savings",
        "where do we\nfind savings",
    ) == ["opportunity", "leakage", "total_spend", "pvm", "risk", "total_spend", "opportunity", "total_spend"]
    assert intents(
        spark,
        routing.VIEW_INTENTS,
        "variance trend",
        "the largest price variance",
        "bought outside any contract",
        "price/volume/mix",
        "monthly",
    ) == ["leakage", "leakage", "maverick", "pvm", "executive"]


def test_question_length_gate(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("x" * 500,), ("x" * 501,)], "question string")
    routed = routing.route_questions_pg(df).collect()
    assert [r["accepted"] for r in routed] == [False, True, True, False]
    assert [r["intent"] is None for r in routed] == [True, False, False, True]
    assert routing.route_questions_dk(df).count() == 4


def test_sql_audit(spark):
    cases = {
        "select * from fact_spend": "no governed view",
        "select * from information_schema.tables -- semantic.": "catalog query",
        "SELECT * FROM semantic.v_pvm_monthly": "ok",
        "select 1 from semantic.v_x join dim_supplier": "base table",
        "select 1 from semantic.v_x, public.fact_spend": "ok",
        "select 1 from semantic.v_x JOIN\n data_quality_results": "base table",
        "select 1 from semantic.v_x join\u00a0dim_supplier": "base table",
        "select 1 from semantic.v_x join\x1cdim_supplier": "base table",
    }
    df = spark.createDataFrame([(s,) for s in cases], "sql string")
    got = {r["sql"]: (r["reason"], r["verdict"]) for r in routing.audit_sql_log(df).collect()}
    assert {s: r for s, (r, _) in got.items()} == cases
    assert all((v == "accepted") == (r == "ok") for r, v in got.values())


def test_contract_windows(spark):
    terms = spark.createDataFrame(
        [
            (1, dt.date(2024, 1, 10), dt.date(2024, 1, 20), "C1"),
            (1, dt.date(2024, 1, 15), dt.date(2024, 1, 15), None),
            (1, dt.date(2024, 1, 31), dt.date(2024, 1, 1), None),
            (2, dt.date(2024, 1, 1), dt.date(2024, 12, 31), "C9"),
        ],
        "supplier_id bigint, start_date date, end_date date, category_id string",
    )
    days = {1: 10, 2: 20, 3: 21, 4: 15, 5: 9}
    rows = [{"transaction_id": i, "spend_date": dt.date(2024, 1, d)} for i, d in days.items()]
    rows += [
        {"transaction_id": 6, "category_id": "C2"},
        {"transaction_id": 7, "supplier_id": 2},
        {"transaction_id": 8, "supplier_id": None},
        {"transaction_id": 9, "category_id": None},
    ]
    lines = star_rows(spark, *rows)
    got = {
        r["transaction_id"]: r["candidate_contracts"]
        for r in contracts.match_active_contract(lines, terms).collect()
    }
    assert got == {1: 1, 2: 1, 3: 0, 4: 2, 5: 0, 6: 1, 7: 0, 8: 0, 9: 1}
    assert contracts.covered_lines(lines, terms).count() == 5
    assert contracts.uncovered_lines(lines, terms).count() == 4


def test_contract_matching_equals_brute_force(spark):
    lines = star_rows(
        spark,
        *[
            {
                "transaction_id": i,
                "supplier_id": i % 3,
                "category_id": f"C{i % 4}",
                "spend_date": DAY + dt.timedelta((i * 37) % 200),
            }
            for i in range(300)
        ],
    )
    terms = [
        (
            i % 3,
            DAY + dt.timedelta((i * 17) % 150),
            DAY + dt.timedelta((i * 17) % 150 + (i * 7) % 60),
            None if i % 5 == 0 else f"C{i % 4}",
        )
        for i in range(60)
    ]
    got = {
        r["transaction_id"]: r["candidate_contracts"]
        for r in contracts.match_active_contract(
            lines,
            spark.createDataFrame(
                terms, "supplier_id bigint, start_date date, end_date date, category_id string"
            ),
        ).collect()
    }
    for r in lines.collect():
        want = sum(
            s == r["supplier_id"] and a <= r["spend_date"] <= b and c in (None, r["category_id"])
            for s, a, b, c in terms
        )
        assert got[r["transaction_id"]] == want


def test_bins_of_contracts_are_not_sent_to_the_driver(spark, tmp_path):
    """A small table of long contracts has many bins; the planner counts a row for each contract."""
    terms = [(i, dt.date(1990, 1, 1 + i % 20), dt.date(9999, 12, 31), None) for i in range(50)]
    kinds = "supplier_id bigint, start_date date, end_date date, category_id string"
    spark.createDataFrame(terms, kinds).write.parquet(str(tmp_path / "terms"))
    stored = spark.read.parquet(str(tmp_path / "terms"))
    lines = star_rows(spark, {"transaction_id": 1, "supplier_id": 7}, {"transaction_id": 2, "supplier_id": 70})
    hits = contracts.contract_hits(lines, stored)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [(r["hit_supplier"], r["hits"]) for r in hits.collect()] == [(7, 1)]
    assert contracts.contract_bins(stored).count() > 50 * 2000


def test_the_contract_that_applies(spark):
    """The category's own before one for all, then the last start, then the least id; long spans."""
    rng = __import__("random").Random(5)
    lines = star_rows(
        spark,
        *[
            {"transaction_id": i, "supplier_id": rng.choice([None, 1, 2]), "category_id": rng.choice([None, "A", "B"]),
             "spend_date": DAY + dt.timedelta(rng.randrange(-4000, 4000))}
            for i in range(300)
        ],
    )
    terms = [
        (rng.choice([None, i % 7, i]), rng.choice([1, 2, None]), D(i), DAY + dt.timedelta(a), DAY + dt.timedelta(a + rng.choice([-1, 0, 31, 700, 5000])),
         rng.choice([None, "A", "B"]))
        for i in range(120)
        for a in [rng.randrange(-4500, 4500)]
    ]
    df = spark.createDataFrame(
        terms, "contract_id bigint, supplier_id bigint, negotiated_rate decimal(14,4), start_date date, end_date date, category_id string"
    )
    got = {r["transaction_id"]: r for r in contracts.match_active_contract(lines, df).collect()}
    assert len(got) == 300
    for line in lines.collect():
        fit = [
            t for t in terms
            if t[1] is not None and t[1] == line["supplier_id"] and t[3] <= line["spend_date"] <= t[4] and t[5] in (None, line["category_id"])
        ]
        best = min(fit, key=lambda t: (t[5] is None, -t[3].toordinal(), t[0] is not None, t[0] or 0, t[2]), default=(None, None, None))
        row = got[line["transaction_id"]]
        assert (row["candidate_contracts"], row["active_contract_id"], row["active_rate"]) == (len(fit), best[0], best[2])


def performance(spark, rows):
    return spark.createDataFrame(
        rows,
        "supplier_id string, total_spend decimal(20,2), rate_leakage decimal(20,4), "
        "contract_compliance_rate double, maverick_spend decimal(20,2), otd_rate double, "
        "quality_ppm double",
    )


def test_risk_of_tied_suppliers(spark):
    rows = [(f"S{i}", D("100"), D("0"), 1.0, D("0"), 0.9, 300.0) for i in range(3)]
    rows.append(("S3", D("100"), D("50"), 0.0, D("100"), 0.1, 900.0))
    rows.append(("S4", D("100"), D("0"), None, D("0"), None, None))
    got = {r["supplier_id"]: r for r in risk.supplier_risk(performance(spark, rows)).collect()}
    assert {got[f"S{i}"]["supplier_risk_score"] for i in range(3)} == {2 / 5}
    assert got["S3"]["supplier_risk_score"] == 1.0 and got["S3"]["risk_tier"] == "High"
    assert got["S0"]["risk_tier"] == "Low"
    assert got["S4"]["risk_operational"] == pytest.approx(0.55 * 0.1 + 0.45 * 300 / 800)
    assert got["S4"]["risk_commercial"] == pytest.approx(0.35 * 0.5)


def test_positive_leakage_only_in_the_top_list(spark):
    fact = fact_rows(
        spark,
        {"supplier_id": "S1", "price_variance": D("5")},
        {"supplier_id": "S2", "price_variance": D("-5")},
        {"supplier_id": "S3", "price_variance": D("7.004")},
    )
    suppliers = spark.createDataFrame(
        [("S1", "A", "t"), ("S2", "B", "t"), ("S3", "A", "t")],
        "supplier_id string, supplier_name string, supplier_tier string",
    )
    rows = [tuple(r) for r in marts.top_leakage_suppliers(fact, suppliers).collect()]
    assert rows == [("A", "t", D("12.00"), D("20.00"))]


def test_registry_filters_and_errors(spark):
    fact = fact_rows(
        spark,
        {"supplier_id": "S1"},
        {"supplier_id": "S2", "on_contract": False},
        {"supplier_id": "S9"},
    )
    dims = {
        "dim_supplier": spark.createDataFrame(
            [("S1", "EU"), ("S2", "US")], "supplier_id string, supplier_country string"
        )
    }
    rows = metrics.metric_query(
        fact, dims, ["total_spend", "maverick_spend_pct"], by=["supplier_country"]
    ).collect()
    assert {r["supplier_country"]: r["maverick_spend_pct"] for r in rows} == {
        "EU": 0.0,
        "US": 1.0,
        None: 0.0,
    }
    (row,) = metrics.metric_query(
        fact, dims, ["total_spend"], where={"supplier_country": ["EU"]}
    ).collect()
    assert row["total_spend"] == D("10")
    with pytest.raises(KeyError):
        metrics.metric_query(fact, dims, ["no_such_metric"])


def test_ties_round_away_from_zero(spark):
    df = spark.createDataFrame([(-0.125,), (0.125,), (-0.5,), (2.675,), (None,), (-0.001,)], "x double")
    got = [r[0] for r in df.select(half_up(F.col("x"), 2)).collect()]
    assert got == [-0.13, 0.13, -0.5, 2.68, None, 0.0]


def test_effects_add_up_and_their_ties_round_away_from_zero(spark):
    star = star_rows(
        spark,
        {"spend_date": dt.date(2024, 1, 5), "quantity": D("8"), "invoice_amount": D("0.20")},
        {"spend_date": dt.date(2024, 2, 5), "quantity": D("1"), "invoice_amount": D("0.00")},
        {"spend_date": dt.date(2024, 3, 5), "quantity": D("3"), "invoice_amount": D("7.00")},
    )
    rows = sorted(pvm.v_pvm_monthly(star, star_dims(spark)[1]).collect(), key=lambda r: r["period_month"])
    # eight units cost 0.20, so one costs 0.025: price effect -0.025, volume effect -0.175
    assert (rows[0]["price_effect"], rows[0]["volume_effect"]) == (D("-0.03"), D("-0.18"))
    fact = fact_rows(
        spark,
        {"period_month": month(1), "qty": D("3"), "invoice_amount": D("10")},
        {"period_month": month(2), "qty": D("7"), "invoice_amount": D("11")},
    )
    (row,) = pvm.pvm_category_monthly(fact).collect()
    assert row["price_effect"] + row["volume_effect"] + row["mix_effect"] == row["spend_change"]
    assert row["price_effect"] == D("-12.333333")


def test_the_summary_of_the_last_month_leaves_no_category_out(spark):
    def bought(category, spend_type, level, number, amount):
        keys = {"category_id": category, "spend_type": spend_type, "category_l3": level}
        return keys | {"period_month": month(number), "qty": D("1"), "invoice_amount": D(amount)}

    levels = {"C1": ("Direct", "L"), "C2": ("Direct", None), "C3": (None, None), "C4": (None, "L")}
    fact = fact_rows(spark, *[bought(c, *names, n, 10 * n) for c, names in levels.items() for n in (1, 2)])
    detail = pvm.pvm_category_monthly(fact)
    summary = pvm.pvm_latest_summary(detail).collect()
    assert {(r["spend_type"], r["category_l3"]) for r in summary} == set(levels.values())
    assert sum(r["spend_change"] for r in summary) == detail.agg(F.sum("spend_change")).first()[0] == 40
