"""Which contracts were in force for a spend line, and which of them applies.

An interval join without pairs. The days are cut into aligned bins of several widths; a contract's
span is a few bins of each (a long one mostly wide bins), and a day lies in one bin per width. Contracts
are folded per supplier, scope and bin to a count and the best of them, and the bins of one widest span
lie in one row, so a line meets one row per scope however many contracts its supplier has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.relations import lookup

#: Widths of the bins in days; each divides the next.
WIDTHS = (1, 32, 1024)
PICKED = ("active_contract_id", "active_rate")


def _floor_div(days: Column, width: int) -> Column:
    return F.floor(days / width).cast("int")


def span_bins(first: Column, after: Column) -> Column:
    """Bins (width, bin) that cover the days from `first` up to, without, `after`, each day once."""
    rest = F.array(F.struct(first.alias("lo"), after.alias("hi")))
    bins = []
    for width in sorted(WIDTHS, reverse=True):
        inner, outer = _parts(width)
        bins.append(F.flatten(F.transform(rest, inner)))
        rest = F.filter(F.flatten(F.transform(rest, outer)), lambda p: p["lo"] < p["hi"])
    return F.concat(*bins)


def _parts(width: int) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """For a piece (lo, hi): the bins of a width inside it, and the pieces left and right of them."""

    def whole(p: Column) -> tuple[Column, Column]:
        return _floor_div(p["lo"] + (width - 1), width), _floor_div(p["hi"], width)

    def inner(p: Column) -> Column:
        a, b = whole(p)
        some = F.transform(
            F.sequence(a, F.greatest(a, b - 1)), lambda n: F.struct(F.lit(width).alias("width"), n.alias("bin"))
        )
        return F.when(a < b, some).otherwise(F.filter(some, lambda _: F.lit(False)))

    def outer(p: Column) -> Column:
        a, b = whole(p)
        left = F.struct(p["lo"].alias("lo"), F.when(a < b, a * width).otherwise(p["hi"]).alias("hi"))
        right = F.struct(F.when(a < b, b * width).otherwise(p["hi"]).alias("lo"), p["hi"].alias("hi"))
        return F.array(left, right)

    return inner, outer


def _best(open_scope: Column) -> Column:
    """What decides between contracts: the category's own before those for all categories, the latest
    start, the least id; the least struct is the best contract."""
    return F.struct(
        open_scope.alias("open_scope"),
        (-F.unix_date("start_date")).alias("later_first"),
        F.col("contract_id").alias("contract_id"),
        F.col("negotiated_rate").alias("negotiated_rate"),
    )


def contract_bins(contracts: DataFrame) -> DataFrame:
    """Per supplier, scope (null: all categories), width and bin: contracts in force and the best."""
    for name, kind in (("contract_id", "bigint"), ("negotiated_rate", "decimal(14,4)")):
        if name not in contracts.columns:
            contracts = contracts.withColumn(name, F.lit(None).cast(kind))
    spans = contracts.where(F.col("supplier_id").isNotNull() & (F.col("start_date") <= F.col("end_date")))
    binned = spans.select(
        F.col("supplier_id").alias("supplier"),
        F.col("category_id").alias("scope"),
        _best(F.col("category_id").isNull()).alias("best"),
        F.explode(span_bins(F.unix_date("start_date"), F.unix_date("end_date") + 1)).alias("at"),
    )
    return binned.groupBy("supplier", "scope", "at.width", "at.bin").agg(
        F.count("*").alias("n"), F.min("best").alias("best")
    )


def _code(width: Column, at: Column) -> Column:
    """One number per bin of any width."""
    return at.cast("bigint") * (2 * max(WIDTHS)) + width


def contract_spans(contracts: DataFrame) -> DataFrame:
    """Per supplier, scope and span (the widest bin): a map from each bin with contracts to their number
    and the best. A span holds as many bins as it has days and a few more, whatever the contracts."""
    width, at = F.col("width"), F.col("bin")
    held = F.struct(_code(width, at).alias("code"), F.struct("n", "best").alias("held"))
    return (
        contract_bins(contracts)
        .groupBy("supplier", "scope", _floor_div(at * width, max(WIDTHS)).alias("span"))
        .agg(F.map_from_entries(F.collect_list(held)).alias("bins"))
    )


def contract_hits(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """Per supplier, category and day with any contract in force: how many, and the best."""
    keys = lines.select(
        F.col("supplier_id").alias("hit_supplier"),
        F.col("category_id").alias("hit_category"),
        F.col("spend_date").alias("hit_day"),
    ).where("hit_supplier is not null and hit_day is not null")
    open_only = F.array(F.lit(None).cast("string"))
    scopes = F.when(F.col("hit_category").isNull(), open_only).otherwise(
        F.array(F.col("hit_category"), F.lit(None).cast("string"))
    )
    day = F.unix_date("hit_day")
    asked = (
        keys.distinct()
        .withColumn("ask_scope", F.explode(scopes))
        .withColumn("ask_span", _floor_div(day, max(WIDTHS)))
    )
    on = {"supplier": F.col("hit_supplier"), "scope": F.col("ask_scope"), "span": F.col("ask_span")}
    # the planner counts a contract as one row however many bins it has, and would send them all to the driver
    met = lookup(asked, contract_spans(contracts).hint("merge"), on, null_safe=True).where(F.col("bins").isNotNull())
    found = [F.try_element_at("bins", _code(F.lit(w), _floor_div(day, w))) for w in WIDTHS]
    held = met.withColumn("held", F.array_compact(F.array(*found))).select(
        "hit_supplier", "hit_category", "hit_day", F.inline("held")
    )
    return held.groupBy("hit_supplier", "hit_category", "hit_day").agg(
        F.sum("n").alias("hits"), F.min("best").alias("best")
    )


def match_active_contract(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """Add candidate_contracts, has_active_contract and the contract that applies, PICKED, to spend lines.

    A contract counts when it has the line's supplier, spans the spend date (both ends
    included) and names the line's category or none. Of several the one for the category applies
    before one for all, then the one that started last, then the least id. A contract that counts twice
    in the table counts twice here.
    """
    hits = contract_hits(lines, contracts)
    on = {"hit_supplier": F.col("supplier_id"), "hit_category": F.col("category_id"), "hit_day": F.col("spend_date")}
    matched = lookup(lines, hits, on, null_safe=True)
    candidates = F.coalesce("hits", F.lit(0).cast("bigint"))
    return matched.select(
        *lines.columns,
        candidates.alias("candidate_contracts"),
        (candidates > 0).alias("has_active_contract"),
        F.col("best.contract_id").alias(PICKED[0]),
        F.col("best.negotiated_rate").alias(PICKED[1]),
    )


def covered_lines(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """Lines with a contract in force."""
    return match_active_contract(lines, contracts).where("has_active_contract").select(*lines.columns)


def uncovered_lines(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """Lines without any contract in force."""
    return (
        match_active_contract(lines, contracts).where("not has_active_contract").select(*lines.columns)
    )
