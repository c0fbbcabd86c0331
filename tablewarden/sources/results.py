"""The results history: Parquet partitioned by month, and flat CSV files.

A run leaves one row per check, little even for hundreds of thousands of checks.
Folders per month keep their number small; within a month each append is a file
of its own, which the start times in its Parquet footer tell apart.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.moments import moment
from tablewarden.functions.variables import vars_json
from tablewarden.schema import NO_COUNT, RESULT_KEY, RESULT_SCHEMA
from tablewarden.sources.files import Folder

#: Folders that readers of the history pass over: files on their way, and notes of compactions under way.
STAGING, NOTES = "_staging", "_compacting"

STORED_SCHEMA = T.StructType(
    list(RESULT_SCHEMA.fields) + [T.StructField("run_month", T.DateType())]
)
CSV_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "env_vars" else f.dataType)
        for f in RESULT_SCHEMA
    ]
)


def read_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A Parquet folder, or None while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return read_or_none(spark, path, STORED_SCHEMA)


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORED_SCHEMA)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The stored history; a history that does not exist yet reads as empty.

    Filters on ``run_month`` (its first day) prune folders.
    """
    stored = _stored(spark, path)
    if stored is None:
        return empty_results(spark)
    replaced = _replaced(Folder(spark, path))
    if replaced:
        stored = stored.where(~F.col("_metadata.file_name").isin(replaced))
    return stored


def with_window_fallback(results: DataFrame, begin: Column | dt.datetime) -> DataFrame:
    """A result without data window gets its run time, without run time the run's begin."""
    begin = moment(begin)
    return results.withColumns(
        {
            "data_start_timestamp": F.coalesce("data_start_timestamp", "run_start_timestamp", begin),
            "data_stop_timestamp": F.coalesce("data_stop_timestamp", "run_stop_timestamp", begin),
        }
    )


def prepare_results(results: DataFrame, begin: Column | dt.datetime | None = None) -> DataFrame:
    """Bring result rows into their stored form, the month of the run included.

    The count -1 of a check that did not run or broke is stored as NULL, so sums
    over the history need not know about it.
    """
    if begin is not None:
        results = with_window_fallback(results, begin)
    results = results.withColumn(
        "check_violation_cnt", F.nullif(F.col("check_violation_cnt"), F.lit(NO_COUNT).cast("bigint"))
    )
    return results.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA],
        F.trunc("run_start_timestamp", "month").alias("run_month"),
    )


def new_results(stored: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of ``results`` whose check and run are not stored yet."""
    known = stored.select("run_month", *RESULT_KEY)
    same = [results[k].eqNullSafe(known[k]) for k in ("run_month", *RESULT_KEY)]
    return results.join(known, same, "left_anti")


def append_results(
    spark: SparkSession,
    results: DataFrame,
    path: str,
    begin: Column | dt.datetime | None = None,
    month: dt.date | None = None,
) -> None:
    """Append result rows once: repeating a run adds nothing.

    Only the folders of the months that ``results`` have rows of are searched for rows
    stored before; give ``month`` where that is known, to save looking. ``rebalance`` writes few, even files and splits a month that
    holds most of the rows. The write commits as a whole, so a job that fails
    leaves nothing behind.
    """
    rows = prepare_results(results, begin)
    stored = _stored(spark, path)
    if stored is not None:
        if month is not None:
            months = [month.replace(day=1)]
        else:  # a few folders, whatever the number of rows
            months = [r.run_month for r in rows.select("run_month").distinct().collect()]
        found = F.col("run_month").isin([m for m in months if m is not None])
        rows = new_results(stored.where(found | F.col("run_month").isNull()), rows)
    rows.hint("rebalance", "run_month").write.mode("append").partitionBy("run_month").parquet(path)


def commit_results(
    spark: SparkSession,
    results: DataFrame,
    path: str,
    name: str,
    begin: Column | dt.datetime | None = None,
    month: dt.date | None = None,
) -> None:
    """Add a batch of results of a run as one file called ``name``, in one step.

    The file is written aside and then given its place. Who writes the same batch again, be it at the same time,
    finds the name taken or replaces the file by its equal, so one copy is left. Rows that are stored under
    another name are left out as :func:`append_results` does. A batch is a job's checks, so it is small.
    """
    rows = prepare_results(results, begin)
    stored = _stored(spark, path)
    if stored is not None:
        found = F.col("run_month").isNull() if month is None else F.col("run_month") == F.lit(month.replace(day=1))
        rows = new_results(stored.where(found), rows)
    folder, aside = Folder(spark, path), f"{STAGING}/{uuid.uuid4().hex}"
    rows.coalesce(1).write.partitionBy("run_month").parquet(f"{folder.path}/{aside}")
    for part in folder.names(aside):
        if part.startswith("run_month="):
            for file in folder.names(f"{aside}/{part}"):
                if file.endswith(".parquet"):
                    folder.move(f"{aside}/{part}/{file}", f"{part}/{name}.parquet")
    folder.remove(aside)


def compact_results(spark: SparkSession, path: str, month: dt.date, least: int = 8) -> bool:
    """Put the files of a month together once there are ``least``; false if there is nothing to do.

    The new file is written aside. A note names it and the files it stands for; from the moment it takes its place,
    readers (:func:`read_results`) pass over those, which are then deleted, and the note after them. A call that was ended in
    between is carried on by the next one.
    """
    folder, part = Folder(spark, path), f"run_month={month.replace(day=1).isoformat()}"
    _finish_compaction(folder, part)
    files = [f for f in folder.names(part) if f.endswith(".parquet")]
    if len(files) < least:
        return False
    name, aside = f"compact-{uuid.uuid4().hex}.parquet", f"{STAGING}/{uuid.uuid4().hex}"
    rows = spark.read.schema(RESULT_SCHEMA).parquet(*[f"{folder.path}/{part}/{f}" for f in files])
    rows.coalesce(1).sortWithinPartitions("instance_name", "database_name", "table_name", "check_name").write.parquet(
        f"{folder.path}/{aside}"
    )
    folder.make(NOTES)
    folder.write(f"{NOTES}/{part}", json.dumps({"new": name, "old": files}))
    written = next(f for f in folder.names(aside) if f.endswith(".parquet"))
    folder.move(f"{aside}/{written}", f"{part}/{name}")
    folder.remove(aside)
    _finish_compaction(folder, part)
    return True


def _finish_compaction(folder: Folder, part: str) -> None:
    if not folder.exists(f"{NOTES}/{part}"):
        return
    note = json.loads(folder.read(f"{NOTES}/{part}"))
    if folder.exists(f"{part}/{note['new']}"):
        for file in note["old"]:
            folder.remove(f"{part}/{file}")
    folder.remove(f"{NOTES}/{part}")


def _replaced(folder: Folder) -> list[str]:
    """Files that a compaction has replaced but not deleted yet."""
    out = []
    for part in folder.names(NOTES):
        note = json.loads(folder.read(f"{NOTES}/{part}"))
        if folder.exists(f"{part}/{note['new']}"):
            out += note["old"]
    return out


def append_csv(results: DataFrame, path: str) -> None:
    """Append to flat CSV files with a header; variables become JSON text."""
    (
        results.select(*RESULT_SCHEMA.fieldNames())
        .withColumn("env_vars", vars_json(F.col("env_vars")))
        .write.mode("append")
        .option("header", True)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)
