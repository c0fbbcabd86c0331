"""Violations by partition, kept beside the results history.

A result row has the count of a whole check. What it is made of lies here: one row per check, run and
partition value, written by the tasks that counted, so a table may have any number of partitions. Folders per
month prune as those of the history do. Rows count once the run's result is in the history; those of a run that
broke before are passed over.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.schema import LEVELS, RESULT_KEY
from tablewarden.sources.results import read_or_none

#: Hidden from readers of the history, as its name begins with an underscore.
FOLDER = "_partitions"

PARTITION_SCHEMA = T.StructType(
    [
        *[T.StructField(level, T.StringType()) for level in LEVELS],
        T.StructField("run_id", T.LongType()),
        T.StructField("run_start_timestamp", T.TimestampNTZType()),
        T.StructField("partition_name", T.StringType()),
        T.StructField("partition_value", T.StringType()),
        T.StructField("partition_rows", T.LongType()),
        # what this run adds to the violations of the partition, and all that it found there
        T.StructField("violations", T.LongType()),
        T.StructField("found", T.LongType()),
        T.StructField("written", T.TimestampType()),
        T.StructField("run_month", T.DateType()),
        T.StructField("attempt", T.StringType()),
    ]
)


class PartitionResults:
    """The partition rows of the history at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path.rstrip('/')}/{FOLDER}"

    def read(self) -> DataFrame:
        """All rows as written; an unwritten table reads as empty."""
        stored = read_or_none(self.spark, self.path, PARTITION_SCHEMA)
        return self.spark.createDataFrame([], PARTITION_SCHEMA) if stored is None else stored

    def keep(self, rows: DataFrame, started: dt.datetime) -> DataFrame:
        """Write rows of a run (without ``written``, ``attempt`` and month) and give back what was written.

        Each call has a folder of its own, so jobs that run side by side do not meet.
        """
        attempt, month = uuid.uuid4().hex, started.date().replace(day=1)
        names = [f for f in PARTITION_SCHEMA if f.name not in ("run_month", "attempt")]
        full = rows.withColumn("written", F.current_timestamp()).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in names])
        full.hint("rebalance").write.parquet(f"{self.path}/run_month={month.isoformat()}/attempt={attempt}")
        return self.read().where((F.col("run_month") == F.lit(month)) & (F.col("attempt") == attempt))

    def committed(self, history: DataFrame, *where) -> DataFrame:
        """One row per check, run and partition of the runs whose results are stored.

        Conditions are on the levels, the run or the month; they reach both reads.
        """
        rows, results = self.read(), history.where(F.col("check_violation_cnt") >= 0)
        for condition in where:
            rows, results = rows.where(condition), results.where(condition)
        facts = [c for c in PARTITION_SCHEMA.fieldNames() if c not in (*RESULT_KEY, "partition_name", "partition_value")]
        last = (
            rows.groupBy(*RESULT_KEY, "partition_name", "partition_value")
            .agg(F.max_by(F.struct(*facts), F.struct("written", "attempt")).alias("_last"))
            .select(*RESULT_KEY, "partition_name", "partition_value", "_last.*")
        )
        done = results.select(*[F.col(k).alias(f"_{k}") for k in RESULT_KEY]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in RESULT_KEY]
        return last.join(done, same, "left_semi").drop("attempt")


def totals(rows: DataFrame, keys: Sequence[str] = ("table_name", "check_name", "partition_value")) -> DataFrame:
    """Violations of each partition over all runs: runs add what they found anew, so this is a sum."""
    return rows.groupBy(*keys).agg(F.sum("violations").alias("violations"))
