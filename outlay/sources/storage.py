"""Shared storage: scratch folders, written intermediates, table and file sinks, views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only in local mode, where driver and tasks are one process, a temporary folder stands in for
    it; elsewhere an unset folder is an error, since tasks would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="outlay-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one; it is deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/outlay-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{session_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write inside are not needed after it and go at its end, so a job of many
    writes holds on disk what it stored and the shuffles of one write."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.set(cleanup, before)


#: Files a task holds open where its rows are not gathered; beyond them it sorts what is left.
MOST_OPEN = 128
#: How stored columns are packed: text keys and amounts take about two thirds of what the default leaves.
PACKED = {"compression": "zstd"}


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: later passes and lost
    executors start from the files, not from the whole lineage."""
    path = new_folder(df.sparkSession, label)
    with shuffles_released(df.sparkSession):
        df.write.mode("errorifexists").options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def table_root(spark: SparkSession, name: str) -> str:
    """Where the versions of a table lie unless a folder is given: below its database's folder."""
    database, _, table = name.rpartition(".")
    place = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return f"{place.rstrip('/')}/{table}"


def location_of(spark: SparkSession, name: str) -> str:
    """The folder of the version a table points to."""
    rows = spark.sql(f"describe table extended {name}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def _unlisted(spark: SparkSession) -> SparkSession:
    """A session of the same catalog in which partitions are found in the folder, not kept in the
    catalog, so that a table's location is all there is to swap."""
    child = spark.newSession()
    child.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")
    return child


def _point(df: DataFrame, name: str, version: str, partition_by: Sequence[str], buckets: str) -> None:
    """Let a table mean a version: one step in the catalog where the columns stay the same."""
    spark = df.sparkSession
    child = _unlisted(spark)
    place = version.replace("'", "\\'")
    if spark.catalog.tableExists(name):
        had = {f.name: f.dataType for f in spark.table(name).schema}
        if had == {f.name: f.dataType for f in df.schema}:
            child.sql(f"alter table {name} set location '{place}'")
            spark.catalog.refreshTable(name)
            return
        child.sql(f"drop table {name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    parts = f"partitioned by ({', '.join(partition_by)})" if partition_by else ""
    child.sql(f"create table {name} ({columns}) using parquet {parts} {buckets} location '{place}'")
    spark.catalog.refreshTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table that `replace_table` wrote, with all versions of it."""
    root = location_of(spark, name).rstrip("/").rpartition("/")[0]
    spark.sql(f"drop table {name}")
    remove(spark, root)


def _drop_versions(spark: SparkSession, root: str, kept: Sequence[str]) -> None:
    files, path = _files(spark, root)
    names = {k.rstrip("/").rpartition("/")[2] for k in kept}
    for entry in files.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("v-") and name not in names:
            files.delete(entry.getPath(), True)


def replace_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    folder: str | None = None,
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
    gather: bool = True,
) -> DataFrame:
    """Full refresh of a table; returns the table as stored.

    The rows are written to a new version folder below `folder`, then the table's location is swapped
    in one step. A write that fails leaves the table as it was; the version before stays for those
    who still read it, older ones go. One writer per table at a time. Where the columns differ from
    the stored ones the table is dropped and made anew, which is two steps.

    A partitioned write is rebalanced on the partition columns first: few files per partition,
    and a partition holding a third of the rows is still written by many tasks. With `gather` off it
    exchanges nothing and every task adds a file to each partition it has rows of: for wide rows in
    few partitions. A bucketed write
    exchanges nothing: every task deals its rows out to a file per bucket, so wide rows go to storage
    in columns and not through a shuffle first. Tables of equal buckets then join without an exchange.
    """
    spark = df.sparkSession
    root = (folder or table_root(spark, name)).rstrip("/")
    version = f"{root}/v-{uuid.uuid4().hex}"
    before = location_of(spark, name) if spark.catalog.tableExists(name) else None
    clause = ""
    if buckets:
        clause = f"clustered by ({', '.join(bucket_by)}) into {buckets} buckets"
        written_as = f"{name}_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(buckets, *bucket_by).format("parquet").options(**PACKED).option("path", version)
        try:
            # as many open files as buckets, else every task sorts its rows by bucket first
            with shuffles_released(spark), _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(buckets)):
                writer.saveAsTable(written_as)
        finally:
            spark.sql(f"drop table if exists {written_as}")
    else:
        rows = df.hint("rebalance", *partition_by) if partition_by and gather else df
        open_files = str(MOST_OPEN if partition_by and not gather else 0)
        with shuffles_released(spark), _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", open_files):
            rows.write.partitionBy(*partition_by).options(**PACKED).parquet(version)
    _point(df, name, version, partition_by, clause)
    _drop_versions(spark, root, [version, *([before] if before else [])])
    return spark.table(name).select(*df.columns)


def in_buckets(df: DataFrame, folder: str, bucket_by: Sequence[str], buckets: int) -> DataFrame:
    """A frame stored in buckets below a folder, by no name of the catalog; `remove` ends it."""
    spark, name = df.sparkSession, f"outlay_{uuid.uuid4().hex}"
    try:
        return replace_table(df, name, folder=folder, bucket_by=bucket_by, buckets=buckets)
    finally:
        spark.sql(f"drop table if exists {name}")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    files, path = _files(spark, folder)
    files.delete(path, True)


@contextmanager
def dealt(df: DataFrame, bucket_by: Sequence[str], buckets: int) -> Iterator[DataFrame]:
    """A frame in buckets for as long as it is needed: to sum it by these or more keys without an exchange."""
    folder = new_folder(df.sparkSession, "dealt")
    try:
        yield in_buckets(df, folder, bucket_by, buckets)
    finally:
        remove(df.sparkSession, folder)


def day_span(spark: SparkSession, path: str, column: str) -> DataFrame:
    """First and last value of a date column, from the footers of the Parquet files alone."""
    child = spark.newSession()
    child.conf.set("spark.sql.sources.useV1SourceList", "")
    child.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    days = child.read.parquet(path)
    return days.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def export_csv(df: DataFrame, path: str) -> None:
    with shuffles_released(df.sparkSession):
        df.write.mode("overwrite").option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str) -> None:
    with shuffles_released(df.sparkSession):
        df.write.mode("overwrite").options(**PACKED).parquet(path)


def publish_views(views: Mapping[str, DataFrame]) -> list[str]:
    """Publish frames as temporary views in the given order; publishing again replaces them."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def publish_catalog_views(
    spark: SparkSession, views: Mapping[str, DataFrame], database: str, store: str, folder: str | None = None
) -> list[str]:
    """Publish frames as views of the catalog, which other sessions see and which outlive this one.

    Each frame is stored as a table of the database `store`, replaced in the given order, and its
    view names the table's columns, so a reader sees the old rows or the new ones, never a mixture.
    """
    spark.sql(f"create database if not exists {store}")
    spark.sql(f"create database if not exists {database}")
    published = []
    for name, df in views.items():
        table = f"{store}.{name}"
        replace_table(df, table, folder=f"{folder.rstrip('/')}/{name}" if folder else None)
        columns = ", ".join(f"`{c}`" for c in df.columns)
        spark.sql(f"create or replace view {database}.{name} as select {columns} from {table}")
        published.append(f"{database}.{name}")
    return published
