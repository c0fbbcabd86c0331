"""Inspected tables and the files behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession, table: str, *, directory: str | None = None, database: str | None = None
) -> DataFrame:
    """A table by name: a Parquet file or folder in ``directory``, or a catalogue table."""
    if directory is not None:
        return spark.read.parquet(f"{directory.rstrip('/')}/{table}.parquet")
    return spark.table(f"{database}.{table}" if database else table)


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per file: ``path``, ``length`` in bytes, ``modificationTime``.

    The content column is pruned, so no file is opened whatever the size of the
    table. Files are spread over the shuffle partitions' number of tasks at most;
    without that every large file would be a task of its own.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(paths))
        .select("path", "length", "modificationTime")
    )
    return files.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
