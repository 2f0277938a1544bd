"""Star tables from parquet folders or a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.sources.schemas import STAR


def _conformed(df: DataFrame, name: str) -> DataFrame:
    """Columns in schema order with schema types; absent optional columns become null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STAR[name]
        ]
    )


def read_star_parquet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: _conformed(spark.read.parquet(f"{folder.rstrip('/')}/{n}"), n) for n in STAR}


def read_star_jdbc(
    spark: SparkSession, url: str, partitions: int = 32, key_ranges: dict | None = None, **options
) -> dict[str, DataFrame]:
    """Read the star over JDBC. `key_ranges` maps a table to (column, lower, upper), which
    splits its read over `partitions` tasks. The fact must have one; a dimension without is read
    by one task."""
    if "fact_spend" not in (key_ranges or {}):
        raise ValueError("key_ranges must split the read of fact_spend")
    frames = {}
    for name in STAR:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for key, value in options.items():
            reader = reader.option(key, value)
        if key_ranges and name in key_ranges:
            column, lower, upper = key_ranges[name]
            reader = (
                reader.option("partitionColumn", column)
                .option("lowerBound", lower)
                .option("upperBound", upper)
                .option("numPartitions", partitions)
            )
        frames[name] = _conformed(reader.load(), name)
    return frames
