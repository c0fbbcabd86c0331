"""Which days of a growing table have been seen, and how full they were.

A window ends with the newest row. Rows that come later for a day (or moment) before that end would never be
looked at. The ledger keeps, beside the results history, the number of rows of every inspected day and the time of
its newest file. A run counts the rows of each day anew, reading the window column only, and a day that has other
rows or a newer file than the ledger says is opened again.

Days are told apart on the executors; only those found late come to the driver.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.moments import moment
from tablewarden.sources.results import read_or_none
from tablewarden.streaming.incremental import in_window, moment_of

FOLDER = "_ledger"

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("day_rows", T.LongType()),
        T.StructField("file_time", T.TimestampType()),
        # rows came after the day had been inspected
        T.StructField("late", T.BooleanType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("run_start_timestamp", T.TimestampNTZType()),
    ]
)


def day_column(df: DataFrame, column: str, form: str) -> Column:
    return moment_of(df, column, F.col(column), form).cast("date")


def with_file_time(df: DataFrame, column: str) -> DataFrame:
    """The window column, and the time of each row's file where the table is made of files."""
    try:
        return df.select(column, F.col("_metadata.file_modification_time").alias("_file_time"))
    except AnalysisException:
        return df.select(column, F.lit(None).cast("timestamp").alias("_file_time"))


class Ledger:
    """The days of all tables whose history is at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path.rstrip('/')}/{FOLDER}"

    def _place(self, instance: str, database: str, table: str) -> str:
        name = hashlib.sha256(json.dumps([instance, database, table]).encode()).hexdigest()[:32]
        return f"{self.path}/{name}"

    def read(self, instance: str, database: str, table: str) -> DataFrame:
        """The entries of a table; each run has added a folder."""
        stored = read_or_none(self.spark, self._place(instance, database, table), LEDGER_SCHEMA)
        return self.spark.createDataFrame([], LEDGER_SCHEMA) if stored is None else stored

    def latest(self, instance: str, database: str, table: str) -> DataFrame:
        """The newest entry of each day."""
        mine = self.read(instance, database, table)
        last = F.max_by(
            F.struct("day_rows", "file_time", "late", "run_start_timestamp"), F.struct("run_start_timestamp", "run_id")
        )
        return mine.groupBy("day").agg(last.alias("_l")).select("day", "_l.*")

    def note(
        self, run, table: str, df: DataFrame, column: str, form: str,
        prior: dt.datetime | None, stop: dt.datetime, look_back: int | None = None,
    ) -> None:
        """Enter the days of ``df`` up to ``stop`` that changed since they were last entered.

        ``prior`` is the end of the last window: rows up to it should have been seen. A table without entries
        is taken as it is. ``look_back`` leaves days alone that ended so many days before ``prior``.
        """
        seen = in_window(column, None, stop, df, form)
        if look_back is not None and prior is not None:
            seen &= in_window(column, prior - dt.timedelta(days=look_back), None, df, form)
        rows = with_file_time(df.where(seen), column)
        old = F.lit(False) if prior is None else in_window(column, None, prior, df, form)
        now = rows.groupBy(day_column(df, column, form).alias("day")).agg(
            F.count(F.lit(1)).alias("all_rows"),
            F.count_if(old).alias("old_rows"),
            F.max("_file_time").alias("new_time"),
            F.max(F.when(old, F.col("_file_time"))).alias("old_time"),
        )
        known = self.latest(run.instance, run.database, table).drop("late", "run_start_timestamp")
        if look_back is not None and prior is not None:
            known = known.where(F.col("day") > F.lit((prior - dt.timedelta(days=look_back)).date()))
        days = now.join(known, "day", "full").fillna(0, ["all_rows", "old_rows"])
        entered = prior is not None and not known.isEmpty()
        other = F.col("old_rows") != F.coalesce("day_rows", F.lit(0))
        newer = F.coalesce(F.col("old_time") > F.col("file_time"), F.lit(False))
        late = (F.col("old_rows") > 0) & (other | newer) if entered else F.lit(False)
        changed = ~F.col("all_rows").eqNullSafe(F.col("day_rows")) | ~F.col("new_time").eqNullSafe(F.col("file_time"))
        entries = days.withColumn("late", late).where(changed | F.col("late")).select(
            "day",
            F.col("all_rows").alias("day_rows"),
            F.col("new_time").alias("file_time"),
            "late",
            F.lit(run.run_id).cast("bigint").alias("run_id"),
            moment(run.started).alias("run_start_timestamp"),
        )
        place = self._place(run.instance, run.database, table)
        entries.hint("rebalance").write.parquet(f"{place}/entry={uuid.uuid4().hex}")

    def late_days(self, instance: str, database: str, table: str, since: dt.datetime | None) -> list[tuple]:
        """Days that got rows late and when that was found, from ``since`` on."""
        mine = self.read(instance, database, table).where("late")
        if since is not None:
            mine = mine.where(F.col("run_start_timestamp") > moment(since))
        found = mine.groupBy("day").agg(F.max("run_start_timestamp").alias("at")).orderBy("day")
        return [(r["day"], r["at"]) for r in found.collect()]
