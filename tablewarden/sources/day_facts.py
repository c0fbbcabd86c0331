"""Mergeable facts of a check by day, kept from run to run: moments of a column, sketches of a table.

Each run adds the facts of the days it looked at. A day that was opened again comes whole; what earlier runs wrote of
it no longer counts then. Rows of runs whose result is not in the history are passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.sources.results import read_or_none

_OWN = [
    T.StructField("day", T.DateType()),
    T.StructField("whole", T.BooleanType()),
    T.StructField("run", T.StringType()),
    T.StructField("written", T.TimestampType()),
]


class DayFacts:
    """Rows of ``fields`` by day in ``path``; ``results`` has the results of the check, ``run`` is the one under way."""

    def __init__(self, spark: SparkSession, path: str, fields: list[T.StructField], run: str, results: DataFrame | None) -> None:
        self.spark, self.path, self.run, self.results = spark, path, run, results
        self.fields = [f.name for f in fields]
        self.schema = T.StructType([*_OWN, *fields, T.StructField("attempt", T.StringType())])

    def add(self, rows: DataFrame, late: list) -> DataFrame:
        """Write the facts (``day`` and the fields) of this run, and give back all that count now."""
        attempt = uuid.uuid4().hex
        full = rows.select(
            "day",
            F.coalesce(F.col("day").isin(late), F.lit(False)).alias("whole"),
            F.lit(self.run).alias("run"),
            F.current_timestamp().alias("written"),
            *self.fields,
        )
        full.write.parquet(f"{self.path}/attempt={attempt}")
        return self._counting(attempt)

    def _counting(self, attempt: str) -> DataFrame:
        rows = read_or_none(self.spark, self.path, self.schema)
        mine = F.col("attempt") == attempt
        known = rows.where(mine)
        if self.results is not None:
            done = self.results.where(F.col("check_violation_cnt") >= 0).select(F.col("run_id").cast("string").alias("run"))
            older = rows.where((F.col("run") != self.run) & ~mine).join(done.distinct(), "run", "left_semi")
            # an attempt that broke may have left rows of a run that was stored later
            last = F.max(F.struct("written", "attempt")).over(Window.partitionBy("run"))
            older = older.withColumn("_last", last["attempt"]).where("attempt = _last").drop("_last")
            known = known.unionByName(older.select(known.columns))
        newest = F.max(F.when(F.col("whole"), F.col("written"))).over(Window.partitionBy("day"))
        counting = known.withColumn("_since", newest).where(F.col("_since").isNull() | (F.col("written") >= F.col("_since")))
        return counting.select("day", *self.fields)
