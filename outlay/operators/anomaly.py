"""Spend anomalies by isolation forest (Liu, Ting, Zhou: Isolation Forest, ICDM 2008).

Spark draws the trees' subsamples, fits one tree per group and scores the lines in Arrow
batches; the fitted trees are the only thing that passes the driver, and their size is fixed by
the number of trees and the subsample size.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.sources.storage import written

# Fixed values of the detector.
FEATURES = (
    "qty",
    "actual_unit_price",
    "invoice_amount",
    "price_variance",
    "should_cost_gap",
    "on_contract_int",
    "maverick_int",
)
LINE_COLUMNS = (
    "invoice_id",
    "invoice_date",
    "supplier_id",
    "category_id",
    "spend_type",
    "category_l3",
    "qty",
    "actual_unit_price",
    "invoice_amount",
    "contracted_unit_price",
    "should_cost_unit",
    "price_variance",
    "should_cost_gap",
)
FACT_COLUMNS = ("invoice_line", *LINE_COLUMNS, "on_contract", "maverick_flag")
TREES, SUBSAMPLE, CONTAMINATION, SEED = 200, 256, Fraction(3, 100), 42
EXPORT_LIMIT = 500
# Lines drawn per tree in expectation, before the cut at SUBSAMPLE.
DRAWS = 336
DEPTH = int(math.log2(SUBSAMPLE))


def anomaly_lines(fact: DataFrame, *extra: str) -> DataFrame:
    return fact.select(
        *extra,
        *LINE_COLUMNS,
        F.col("on_contract").cast("int").alias("on_contract_int"),
        F.col("maverick_flag").cast("int").alias("maverick_int"),
    )


def _known(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _moments() -> list[Column]:
    return [
        *[F.avg(_known(f)).alias(f"mean_{f}") for f in FEATURES],
        *[F.stddev_pop(_known(f)).alias(f"sd_{f}") for f in FEATURES],
    ]


def anomaly_features(fact: DataFrame) -> DataFrame:
    """The seven features per line, nulls as 0, standardised by population mean and deviation;
    a constant feature keeps scale 1."""
    lines = anomaly_lines(fact, "invoice_line")
    moments = lines.agg(F.struct(*_moments())).scalar()

    def standard(name: str) -> Column:
        sd = F.col(f"_m.sd_{name}")
        scale = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        return ((_known(name) - F.col(f"_m.mean_{name}")) / scale).alias(name)

    return lines.withColumn("_m", moments).select(
        "invoice_id", "invoice_line", *[standard(f) for f in FEATURES]
    )


MICROS = 1_000_000


def path_table(size: int = SUBSAMPLE) -> list[int]:
    """Expected depth of an unsuccessful search among 0 to `size` points, in millionths."""
    out = []
    for n in range(size + 1):
        depth = 0.0 if n <= 1 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
        out.append(math.floor((1.0 if n == 2 else depth) * MICROS + 0.5))
    return out


def _whole(name: str) -> Column:
    """A feature in ten-thousandths; null counts as 0. Trees do not care for scale or origin of a
    feature, so nothing is standardised."""
    amount = F.coalesce(F.col(name).cast("decimal(38,4)"), F.lit(0).cast("decimal(38,4)"))
    return (amount * F.lit(10000)).cast("long")


def _draw(text: Column) -> Column:
    """32 bits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def subsamples(lines: DataFrame, rows: int, trees: int, seed: int) -> DataFrame:
    """(tree, features): up to SUBSAMPLE lines of each tree, drawn from all lines.

    A line offers itself trees * min(1, DRAWS / rows) times for each of its copies, rounded up or
    down by its hash so that the mean is met, and every offer goes to a tree of its own draw. A
    tree takes its first SUBSAMPLE offers in the order of their hashes. The same table gives
    the same trees however it is partitioned, and about trees * DRAWS rows leave it whatever
    its size.
    """
    features = [_whole(f).alias(f) for f in FEATURES]
    point = F.md5(
        F.concat_ws("|", F.lit(seed), "invoice_id", "invoice_line", *[_whole(f) for f in FEATURES])
    )
    alike = (
        lines.select(point.alias("_point"), *features)
        .groupBy("_point", *FEATURES)
        .agg(F.count("*").alias("_copies"))
    )
    offers = F.col("_copies") * F.lit(trees * min(DRAWS, rows))
    chance = _draw(F.concat("_point", F.lit(":n"))).cast("double") / F.lit(2.0**32)
    more = chance * F.lit(float(rows)) < (offers % F.lit(rows)).cast("double")
    times = F.expr(f"({trees * min(DRAWS, rows)} * _copies) div {rows}") + more.cast("long")
    offered = (
        alike.withColumn("_times", times)
        .where("_times > 0")
        .withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
        .withColumn("_order", F.md5(F.concat_ws(":", "_point", "_time")))
        .withColumn("tree", (_draw(F.concat("_order", F.lit(":t"))) % trees).cast("int"))
    )
    first = Window.partitionBy("tree").orderBy("_order")
    return (
        offered.withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= SUBSAMPLE)
        .select("tree", *FEATURES)
    )


def fit_forest(lines: DataFrame, rows: int, trees: int = TREES, seed: int = SEED) -> dict:
    """Trees as arrays: `feature` (-1 at a leaf), `cut` and `path` by node of a complete binary tree,
    one row per tree; `norm`, the mean path of a whole subsample. A leaf's path is its depth
    and the mean path among its lines, in millionths. Their size is fixed by trees and SUBSAMPLE.
    """
    depth, names, paths, micros = DEPTH, list(FEATURES), path_table(), MICROS

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        tree = int(pdf["tree"].iloc[0])
        x = pdf[names].to_numpy("int64")
        nodes = 2 ** (depth + 1) - 1
        feature, cut, path = [-1] * nodes, [0] * nodes, [0] * nodes
        limit = max(len(x) - 1, 1).bit_length()
        stack = [(0, 0, x)]
        while stack:
            node, level, part = stack.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            free = [i for i in range(len(names)) if high[i] > low[i]]
            if level >= limit or not free:
                path[node] = level * micros + paths[len(part)]
                continue

            def draw(what: str, node=node) -> int:
                return int(hashlib.md5(f"{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:8], 16)

            pick = free[draw("feature") % len(free)]
            span = float(int(high[pick]) - int(low[pick]))
            at = int(low[pick]) + math.floor(span * (draw("cut") / 2.0**32))
            feature[node], cut[node] = pick, at
            left = part[:, pick] <= at
            stack.append((2 * node + 1, level + 1, part[left]))
            stack.append((2 * node + 2, level + 1, part[~left]))
        return pd.DataFrame(
            {"tree": [tree], "rows": [len(x)], "feature": [feature], "cut": [cut], "path": [path]}
        )

    fitted = (
        subsamples(lines, rows, trees, seed)
        .groupBy("tree")
        .applyInPandas(
            grow, "tree int, rows int, feature array<int>, cut array<bigint>, path array<bigint>"
        )
        .toPandas()
        .sort_values("tree")
    )
    return {
        "feature": np.stack(fitted["feature"].to_numpy()).astype(np.int64),
        "cut": np.stack(fitted["cut"].to_numpy()).astype(np.int64),
        "path": np.stack(fitted["path"].to_numpy()).astype(np.int64),
        "norm": paths[int(fitted["rows"].max())],
    }


def _levels(forest: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees with every leaf at full depth: feature and cut by inner node, path by leaf. Below an
    early leaf all goes left, to a leaf of the same path."""
    feature, cut, path = (forest[k].copy() for k in ("feature", "cut", "path"))
    inner = 2**DEPTH - 1
    for node in range(inner):
        ended = feature[:, node] < 0
        path[ended, 2 * node + 1] = path[ended, node]
        feature[ended, 2 * node + 1] = -1
        feature[ended, node], cut[ended, node] = 0, np.iinfo(np.int64).max
    return feature[:, :inner], cut[:, :inner], path[:, inner:]


def _path_total(spark, forest: dict):
    """Sum of a line's paths over all trees, in millionths. The function is shipped by value and
    holds plain arrays, so workers need no copy of this library."""
    shared, depth = spark.sparkContext.broadcast(_levels(forest)), DEPTH

    @F.pandas_udf("bigint")
    def total(*columns: pd.Series) -> pd.Series:
        x = np.column_stack(columns).astype("int64")
        n, width = x.shape
        flat, start = x.ravel(), np.arange(n) * width
        out, at, value, bound = (np.zeros(n, dtype="int64") for _ in range(4))
        for feature, cut, path in zip(*shared.value):
            # the place of a line's node among the nodes of its level
            node = (x[:, feature[0]] > cut[0]).astype("int64")
            for level in range(1, depth):
                nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
                np.take(feature[nodes], node, out=at, mode="clip")
                np.take(flat, np.add(at, start, out=at), out=value, mode="clip")
                np.take(cut[nodes], node, out=bound, mode="clip")
                node += node
                node += value > bound
            out += np.take(path, node, out=at, mode="clip")
        return pd.Series(out)

    return total


def _smallest(df: DataFrame, value: str, ranks: list[int]) -> list[int]:
    """Values at the given places (from 0) of a non-negative integer column in ascending order.

    Two rounds of counts: blocks of 65,536 values, then single values of the wanted blocks. A path
    total is below 2**32, so either round returns at most 65,536 rows per rank.
    """
    block = F.shiftright(value, 16)
    coarse = sorted(map(tuple, df.groupBy(block.alias("b")).count().collect()))
    wanted, before = {}, 0
    for b, n in coarse:
        for r in ranks:
            if before <= r < before + n:
                wanted[r] = (b, r - before)
        before += n
    blocks = {b for b, _ in wanted.values()}
    fine = sorted(map(tuple, df.where(block.isin(*blocks)).groupBy(value).count().collect()))
    out = []
    for r in ranks:
        b, rest = wanted[r]
        for v, n in fine:
            if v >> 16 == b:
                if rest < n:
                    out.append(v)
                    break
                rest -= n
    return out


def spend_anomalies(
    fact: DataFrame,
    contamination: Fraction = CONTAMINATION,
    trees: int = TREES,
    seed: int = SEED,
) -> DataFrame:
    """All lines, with their line number, anomaly_label (-1 or 1), anomaly_score and is_anomaly.

    Lines whose score lies strictly above the (1 - contamination) quantile of all scores, linear
    between two scores, are flagged; a score falls as its path total rises, so totals
    decide. Scores are rounded at six decimals. Rows are not sorted.
    """
    spark = fact.sparkSession
    lines = anomaly_lines(fact, "invoice_line")
    rows = lines.count()
    if rows == 0:
        raise ValueError("no lines to score")
    forest = fit_forest(lines, rows, trees, seed)
    path_total = _path_total(spark, forest)
    scored = written(lines.withColumn("_total", path_total(*[_whole(f) for f in FEATURES])), "anomalies")
    at, between = divmod(contamination.numerator * (rows - 1), contamination.denominator)
    last, beyond = _smallest(scored, "_total", [at, min(at + 1, rows - 1)])
    flagged = F.col("_total") < last
    if between and beyond > last:
        flagged = F.col("_total") <= last
    share = F.col("_total").cast("double") / F.lit(float(trees)) / F.lit(float(forest["norm"] or MICROS))
    score = F.floor(F.pow(F.lit(2.0), -share) * 1e6 + 0.5).cast("double") / 1e6
    label = F.when(flagged, F.lit(-1)).otherwise(F.lit(1))
    return scored.select(
        *lines.columns,
        label.alias("anomaly_label"),
        score.alias("anomaly_score"),
        flagged.alias("is_anomaly"),
    )


def anomaly_export(anomalies: DataFrame, limit: int = EXPORT_LIMIT) -> DataFrame:
    return (
        anomalies.where("is_anomaly")
        .orderBy(F.desc("anomaly_score"), "invoice_id", "invoice_line")
        .limit(limit)
        .drop("invoice_line")
    )
