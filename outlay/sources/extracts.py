"""Landing of the eight CSV extracts."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.functions.relations import LazyFrames
from outlay.sources.schemas import EXTRACTS
from outlay.sources.storage import remove, shuffles_released


#: Column that holds the text of a row which does not fit its schema.
RECORD = "_record"


class MissingExtract(FileNotFoundError):
    """A source extract is not at its place."""


class HeaderMismatch(ValueError):
    """An extract lacks a column of its schema."""


def with_load_metadata(df: DataFrame, source_file: str, loaded_at: str) -> DataFrame:
    return df.withColumn("_source_file", F.lit(source_file)).withColumn(
        "_loaded_at_utc", F.lit(loaded_at)
    )


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line of an extract."""
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def read_extract(spark: SparkSession, folder: str, name: str, multiline: bool = True) -> DataFrame:
    """One extract by its fixed schema, with RECORD: the text of a row that does not fit it, else null.

    Columns are found by their names in the header, in whatever order; columns that the schema does
    not name are left out. A missing file raises MissingExtract, a missing column HeaderMismatch, and
    files of one extract whose headers differ are an error when they are read. With `multiline` a
    quoted value may hold line feeds, and one task reads a file; without, large files are split.
    """
    file_name, schema = EXTRACTS[name]
    path = f"{folder.rstrip('/')}/{file_name}"
    try:
        header = _header(spark, path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingExtract(f"Missing source extract: {path}") from exc
    absent = [c for c in schema.names if c not in header]
    if header and absent:
        raise HeaderMismatch(f"{path} has no column {', '.join(absent)}")
    known = {f.name: f for f in schema}
    found = [known.get(c, T.StructField(c, T.StringType())) for c in header] or list(schema)
    return (
        spark.read.schema(T.StructType([*found, T.StructField(RECORD, T.StringType())]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RECORD)
        .option("columnPruning", False)
        .option("multiLine", multiline)
        .option("nullValue", "")
        .option("escape", '"')
        .csv(path)
        .select(*schema.names, RECORD)
    )


def land_extracts(spark: SparkSession, folder: str, loaded_at: str, multiline: bool = True) -> dict[str, DataFrame]:
    """All extracts as frames with RECORD. Every path and header is checked before any data is read."""
    return {
        name: with_load_metadata(read_extract(spark, folder, name, multiline), file_name, loaded_at)
        for name, (file_name, _) in EXTRACTS.items()
    }


def consumed(spark: SparkSession, folder: str) -> Callable[[str], None]:
    """For `store_landed` over extracts that were only written to be landed: each goes when it is stored."""
    return lambda name: remove(spark, f"{folder.rstrip('/')}/{EXTRACTS[name][0]}")


@dataclass(frozen=True)
class Landing:
    """What landing stored: rows that fit their schema, the rest as text, and how many of each. The
    counts were taken by the writes."""

    bronze: Mapping[str, DataFrame]
    rejects: DataFrame
    accepted: Mapping[str, int]
    rejected: Mapping[str, int]


def store_landed(
    landed: Mapping[str, DataFrame],
    store: Callable[[str, DataFrame], DataFrame],
    done: Callable[[str], None] = lambda name: None,
) -> Landing:
    """Store each extract in one pass over it; `store` writes a frame under a name and reads it back, `done`
    hears the name of an extract that is stored and will not be read again.

    A rejected row keeps its place in the stored table, all other columns null or as far as they were
    read, and is left out of the bronze frame.
    """
    bronze, rejects, accepted, rejected = {}, [], {}, {}
    for name, df in landed.items():
        seen = Observation()
        fits = F.col(RECORD).isNull()
        counted = df.observe(
            seen, F.count(F.when(fits, 1)).alias("accepted"), F.count(F.when(~fits, 1)).alias("rejected")
        )
        stored = store(name, counted)
        accepted[name], rejected[name] = seen.get["accepted"], seen.get["rejected"]
        done(name)
        bronze[name] = stored.where(fits).drop(RECORD)
        rejects.append(
            stored.where(~fits).select(
                F.lit(name).alias("extract"), "_source_file", "_loaded_at_utc", F.col(RECORD).alias("record")
            )
        )
    return Landing(bronze, reduce(DataFrame.unionByName, rejects), accepted, rejected)


def bronze_frames(raw: Mapping[str, DataFrame], loaded_at: str) -> LazyFrames:
    """Bronze frames of extracts that are already at hand as DataFrames."""
    def builder(name: str):
        return lambda: with_load_metadata(raw[name], EXTRACTS[name][0], loaded_at)

    return LazyFrames({name: builder(name) for name in raw})


def write_extracts(raw: Mapping[str, DataFrame], folder: str, backwards: Collection[str] = ()) -> None:
    """Write frames in the extract layout (one folder of CSV parts per extract), those named in
    `backwards` with their columns from the last to the first. The parts are compressed: text of keys and
    amounts shrinks to a fraction, and a part is read by one task anyway."""
    for name, df in raw.items():
        file_name, schema = EXTRACTS[name]
        rows = df.select(*(schema.names[::-1] if name in backwards else schema.names))
        with shuffles_released(df.sparkSession):
            _write_csv(rows, f"{folder.rstrip('/')}/{file_name}")


def _write_csv(rows: DataFrame, path: str) -> None:
    (
        rows.write.mode("overwrite")
        .option("compression", "gzip")
        .option("header", True)
        .option("nullValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def load_manifest(spark: SparkSession, landing: Landing, loaded_at: str) -> DataFrame:
    """One row: loaded_at_utc, source_system_count, row_count_total (rejected rows included), from the
    counts of the writes."""
    total = sum(landing.accepted.values()) + sum(landing.rejected.values())
    return spark.range(1).select(
        F.lit(loaded_at).alias("loaded_at_utc"),
        F.lit(len(landing.accepted)).cast("bigint").alias("source_system_count"),
        F.lit(total).cast("bigint").alias("row_count_total"),
    )


def extract_status(spark: SparkSession, folder: str) -> DataFrame:
    """One row per extract: extract, source_file, present, row_count."""
    rows = []
    for name, (file_name, _) in EXTRACTS.items():
        try:
            counted = read_extract(spark, folder, name).agg(F.count("*").alias("row_count"))
            present = True
        except MissingExtract:
            counted, present = spark.range(1).select(F.lit(0).cast("bigint").alias("row_count")), False
        rows.append(
            counted.select(
                F.lit(name).alias("extract"),
                F.lit(file_name).alias("source_file"),
                F.lit(present).alias("present"),
                "row_count",
            )
        )
    return reduce(DataFrame.unionByName, rows)
