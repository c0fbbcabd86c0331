"""What the history says of each check, carried along instead of being looked up anew.

A run needs little of the history: of setups the variables they left, of incremental checks how far they were
counted, of profiles when. These facts are greatest values, so they merge: a snapshot of them is kept for each
database, and a run reads it and the history's folders from a month before it on. After storing its results a run
writes the next snapshot from the same parts.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.validators import iso_timestamp
from tablewarden.schema import STAGE_TYPES, VARS
from tablewarden.sources.files import Folder

FOLDER = "_latest"
#: Snapshots of a database that are left lying; older ones are removed.
KEPT = 3

_MOMENT = T.TimestampNTZType()
FACTS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("check_name", T.StringType()),
        T.StructField("saved_at", T.StructType([T.StructField("at", _MOMENT), T.StructField("id", T.LongType())])),
        T.StructField("saved", VARS),
        T.StructField("tried", T.BooleanType()),
        T.StructField("last_stop", _MOMENT),
        T.StructField("last_run", _MOMENT),
        T.StructField("profiled", _MOMENT),
    ]
)


def facts_of(history: DataFrame, stop_var: str) -> DataFrame:
    """The facts of all checks of a history, not put together yet: a row per result."""
    ok, kind = F.col("check_rc") == 0, F.col("check_type")
    at = F.struct(F.col("run_start_timestamp").alias("at"), F.col("run_id").alias("id"))
    setup, regular = ok & (kind == "setup"), ~kind.isin(STAGE_TYPES)
    counted = regular & (F.col("check_mode") == "incremental") & (F.col("check_violation_cnt") >= 0)
    return history.select(
        "table_name",
        "check_name",
        F.when(setup, at).alias("saved_at"),
        F.when(setup, F.col("env_vars")).alias("saved"),
        (regular & (F.col("check_rc") >= 0)).alias("tried"),
        F.when(counted, iso_timestamp(F.col("env_vars")[stop_var], "basic")).alias("last_stop"),
        F.when(counted, F.col("run_start_timestamp")).alias("last_run"),
        F.when(ok & (kind == "profile"), F.col("run_start_timestamp")).alias("profiled"),
    )


def merged(facts: DataFrame) -> DataFrame:
    """One row per check."""
    newest = F.max_by(F.struct("saved_at", "saved"), "saved_at")
    return (
        facts.groupBy("table_name", "check_name")
        .agg(
            newest.alias("_s"),
            F.max("tried").alias("tried"),
            *[F.max(c).alias(c) for c in ("last_stop", "last_run", "profiled")],
        )
        .select("table_name", "check_name", "_s.saved_at", "_s.saved", "tried", "last_stop", "last_run", "profiled")
    )


class Snapshots:
    """Snapshots of the facts of one database, beside the history at ``path``."""

    def __init__(self, spark: SparkSession, path: str, instance: str, database: str) -> None:
        place = hashlib.sha256(json.dumps([instance, database]).encode()).hexdigest()[:24]
        self.spark, self.instance, self.database = spark, instance, database
        self.folder = Folder(spark, f"{path.rstrip('/')}/{FOLDER}/{place}")

    def _finished(self) -> list[str]:
        """Names begin with the day of their newest run; a snapshot is whole once it has its mark."""
        return [n for n in self.folder.names() if n[:1] != "_" and self.folder.exists(f"{n}/_SUCCESS")]

    def newest(self) -> tuple[DataFrame, dt.date] | None:
        """The newest snapshot, and the first day of the months that may hold results it does not know."""
        found = self._finished()
        if not found:
            return None
        day = dt.date.fromisoformat(found[-1][:10])
        since = (day.replace(day=1) - dt.timedelta(days=1)).replace(day=1)
        return self.spark.read.schema(FACTS).parquet(f"{self.folder.path}/{found[-1]}"), since

    def facts(self, history: DataFrame, stop_var: str) -> DataFrame:
        """One row per check of the database; only the folders that the snapshot may lack are read."""
        mine = history.where((F.col("instance_name") == self.instance) & (F.col("database_name") == self.database))
        snapshot = self.newest()
        if snapshot is None:
            return merged(facts_of(mine, stop_var))
        known, since = snapshot
        recent = mine.where((F.col("run_month") >= F.lit(since)) | F.col("run_month").isNull())
        return merged(known.unionByName(facts_of(recent, stop_var)))

    def advance(self, history: DataFrame, stop_var: str, started: dt.datetime) -> None:
        """Write the facts as they are now, and remove all but the newest snapshots."""
        found = self._finished()
        day = max([started.date().isoformat(), *(n[:10] for n in found[-1:])])
        name = f"{day}-{started:%H%M%S%f}-{uuid.uuid4().hex}"
        self.facts(history, stop_var).hint("rebalance").write.parquet(f"{self.folder.path}/{name}")
        for old in self._finished()[:-KEPT]:
            self.folder.remove(old)
