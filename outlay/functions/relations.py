"""Join and grain helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class LazyFrames(Mapping[str, DataFrame]):
    """Named frames, each built once and only when it is read."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def unique_by(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key. Catalyst then knows the side is unique on the key and drops a left
    join to it when none of its other columns is read.

    Where a key is repeated with differing values the least whole row is taken, which does not
    depend on the order of rows or on a task that is run again. `repeated_keys` counts such keys.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    if len(rest) == 1:
        return df.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0]))
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row: how many keys stand in more than one row."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return many.agg(F.count("*").alias("repeated_keys"))


def lookup(
    left: DataFrame, unique: DataFrame, on: Mapping[str, Column], null_safe: bool = False
) -> DataFrame:
    """Left join to a side that is unique on its keys; `on` maps each of its key columns to the
    left expression it must equal. The key columns of the side do not come along.

    The keys get a further one that is always 0. Without it the join would take over the
    partitioning of the aggregation that made the side unique, and adaptive execution splits a
    hot key only where both sides of a join arrive by shuffles of their own.
    """
    inner = {key: f"_unique_{key}" for key in on}
    side = unique.withColumnsRenamed(inner).withColumn("_side", _always_zero(*inner.values()))
    matched = _always_zero(*on.values()) == F.col("_side")
    for key, expr in on.items():
        same = expr.eqNullSafe(F.col(inner[key])) if null_safe else expr == F.col(inner[key])
        matched = matched & same
    return left.join(side, matched, "left").drop("_side", *inner.values())


def _always_zero(*columns: Column | str) -> Column:
    return F.pmod(F.hash(*columns), F.lit(1))


def constants_stacked(df: DataFrame, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Turn a one-row frame into one row per entry of `rows`; entries are columns or literals."""
    entry = [
        F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(n) for v, n in zip(r, names)])
        for r in rows
    ]
    return df.select(F.inline(F.array(*entry)))
