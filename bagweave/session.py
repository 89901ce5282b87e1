"""Sessions and the tables that cut lineage between the rounds of an iterative operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Tables written inside the innermost open `scratch`.
_WRITTEN: list[list[DataFrame]] = []


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "bagweave") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only a local session without that setting gets a folder of its own; on a cluster its absence is an error,
    because a folder on one machine would be lost with that machine.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="bagweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns the table read back.

    The files outlive executors and are column-pruned and smaller than an RDD checkpoint. `discard` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # the shuffles of a written table are of no more use; else they stay until the driver collects its garbage
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._bagweave_path = path
    if _WRITTEN:
        _WRITTEN[-1].append(table)
    return table


@contextmanager
def scratch() -> Iterator[None]:
    """Discards at its end every table that was written inside it; results must be written or read before."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for table in _WRITTEN.pop():
            discard(table)


def discard(table: DataFrame | None) -> None:
    """Removes the files of a table that `materialize` returned; nothing that still reads it may be run afterwards."""
    path = getattr(table, "_bagweave_path", None)
    if path is None:
        return
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
