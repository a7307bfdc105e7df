"""Session helpers: building a local session, and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster sets it.

    Only a local master, whose executors share one machine, may do without: a temporary folder
    takes its place. Any other master without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is unset; executors of {master} share no folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written within is deleted at the end, but for the tables that are handed to what this yields."""
    paths: list[str] = []
    _scratch.append(paths)

    def keep(table: DataFrame) -> DataFrame:
        paths.remove(_written[table])
        return table

    try:
        yield keep
    finally:
        _scratch.pop()
        for path in paths:
            p, fs = _file_system(spark, path)
            fs.delete(p, True)


_scratch: list[list[str]] = []
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write Parquet and let go of the shuffle files behind it: what is written is read from there."""
    before = spark.conf.get(CLEANUP, None)
    try:
        if before is not None:
            spark.conf.set(CLEANUP, "true")
        writer.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """The same rows, from a table written in the shared folder.

    Cuts the lineage and survives lost executors. The schema is given to the reader,
    so that an empty table can be read as well.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    save(writer, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def measured(df: DataFrame, name: str, codec: str | None = None, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """What `written` gives, with the number of rows `n` and further aggregates, taken while it is written."""
    seen = Observation()
    path = new_path(df.sparkSession, name)
    writer = df.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()]).write
    save(writer.option("compression", codec) if codec else writer, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out, {"n": 0, **(seen.get or {})}  # nothing is observed where the plan turned out empty


def let_go(*tables: DataFrame) -> None:
    """Delete tables of `written` that no query reads any more; other tables are left alone."""
    for table in tables:
        if path := _written.pop(table, None):
            p, fs = _file_system(table.sparkSession, path)
            fs.delete(p, True)


#: Rows and bytes (as Parquet) up to which a written table may be broadcast; beyond that the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def small_or_not(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, written and measured: with a broadcast hint only if rows and bytes are within their limits."""
    table, seen = measured(df, name)
    if seen["n"] > limit or _size(table) > BROADCAST_BYTES:
        return table
    hinted = F.broadcast(table)
    _written[hinted] = _written[table]
    return hinted


def _size(table: DataFrame) -> int:
    p, fs = _file_system(table.sparkSession, _written[table])
    return fs.getContentSummary(p).getLength()


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return bool(fs.exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file, on whatever file system."""
    p, fs = _file_system(spark, path)
    return bool(fs.exists(p)) and fs.getFileStatus(p).isFile()
