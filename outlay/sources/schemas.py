"""Fixed schemas of the eight raw extracts and of the star tables."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "decimal(14,2)": T.DecimalType(14, 2),
    "decimal(14,4)": T.DecimalType(14, 4),
}


def _schema(columns: str) -> T.StructType:
    """Schema from "name type, name type"; needs no running session."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


# Extract name -> (file name, columns in file order). Names and types of the extracts.
EXTRACTS: dict[str, tuple[str, T.StructType]] = {
    "suppliers": (
        "suppliers.csv",
        _schema(
            "supplier_id string, supplier_name string, supplier_name_alias string, country string, "
            "tier string, primary_category_id string, payment_terms_days int, diversity_flag boolean, "
            "active_flag boolean, risk_score_seed double, on_time_delivery_hist double, "
            "quality_ppm_hist int"
        ),
    ),
    "categories": (
        "categories.csv",
        _schema(
            "category_id string, category_code string, category_l1 string, category_l2 string, "
            "category_l3 string, unspsc_stub string, preferred_currency string"
        ),
    ),
    "contracts": (
        "contracts.csv",
        _schema(
            "contract_id string, supplier_id string, category_id string, contract_name string, "
            "start_date date, end_date date, status string, unit_price decimal(14,4), "
            "currency string, volume_commitment int, rebate_pct double, escalation_pct double"
        ),
    ),
    "should_cost": (
        "should_cost.csv",
        _schema(
            "category_id string, material_cost decimal(14,2), labor_cost decimal(14,2), "
            "overhead_cost decimal(14,2), freight_cost decimal(14,2), quality_cost decimal(14,2), "
            "should_cost_unit decimal(14,2), model_version string, confidence double"
        ),
    ),
    "purchase_orders": (
        "purchase_orders.csv",
        _schema(
            "po_id string, po_line int, po_date date, supplier_id string, category_id string, "
            "contract_id string, cost_center_id string, business_unit string, qty decimal(14,2), "
            "uom string, unit_price decimal(14,4), po_amount decimal(14,2), currency string, "
            "buyer_id string, status string"
        ),
    ),
    "invoices": (
        "invoices.csv",
        _schema(
            "invoice_id string, invoice_line int, invoice_date date, po_id string, "
            "supplier_id string, category_id string, contract_id string, cost_center_id string, "
            "business_unit string, qty decimal(14,2), unit_price decimal(14,4), "
            "invoice_amount decimal(14,2), currency string, payment_status string, "
            "maverick_flag boolean, contracted_unit_price decimal(14,4), "
            "baseline_unit_price decimal(14,4), should_cost_unit decimal(14,4), "
            "savings_realized decimal(14,2), freight_cost decimal(14,2), "
            "quality_cost decimal(14,2), payment_terms_cost decimal(14,2), "
            "tco_amount decimal(14,2), on_contract boolean"
        ),
    ),
    "gl_actuals": (
        "gl_actuals.csv",
        _schema(
            "gl_period string, cost_center_id string, category_id string, gl_account string, "
            "actual_amount decimal(14,2), budget_amount decimal(14,2), "
            "forecast_amount decimal(14,2)"
        ),
    ),
    "cost_centers": (
        "cost_centers.csv",
        _schema("cost_center_id string, cost_center_name string, business_unit string"),
    ),
}

# Order-book tables the adapter reads, by the columns it may use.
ORDER_BOOK: dict[str, T.StructType] = {
    "region": _schema("r_regionkey int, r_name string"),
    "nation": _schema("n_nationkey int, n_name string, n_regionkey int"),
    "supplier": _schema("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": _schema(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": _schema(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": _schema(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "conversations": _schema("conv_id bigint, turn bigint, role string, text string"),
}

# Star tables of the serving side.
STAR: dict[str, T.StructType] = {
    "dim_supplier": _schema(
        "supplier_id bigint, name string, primary_category string, risk_tier string, "
        "region string, locality string"
    ),
    "dim_category": _schema(
        "category_id string, name string, parent_category string, direct_or_indirect string"
    ),
    "dim_contract": _schema(
        "contract_id bigint, supplier_id bigint, negotiated_rate decimal(14,4), start_date date, "
        "end_date date, terms string, category_id string, is_active boolean"
    ),
    "fact_spend": _schema(
        "transaction_id bigint, supplier_id bigint, category_id string, contract_id bigint, "
        "po_number string, line_number int, invoice_amount decimal(14,2), "
        "negotiated_rate decimal(14,4), actual_rate decimal(14,4), quantity decimal(14,2), "
        "spend_date date, cost_center string, is_maverick boolean"
    ),
}
