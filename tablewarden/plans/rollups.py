"""Daily violations of every check, kept up to date beside the history.

Series and levels are sums of days. The daily sums of a month are made once and made again only when the files of
its folder in the history are others than those they were made of, so a report over years reads the history of the
month under way and, of all others, a row per check and day.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.plans.history import is_regular, path_to, period_of, rolled_up, violation_total
from tablewarden.schema import LEVELS
from tablewarden.sources.files import Folder
from tablewarden.sources.results import read_results

FOLDER = "_daily"
#: How the folder of rows without a month ends.
NO_MONTH = "=__HIVE_DEFAULT_PARTITION__"
DAILY_SCHEMA = T.StructType(
    [
        *[T.StructField(level, T.StringType()) for level in LEVELS],
        T.StructField("day", T.DateType()),
        T.StructField("violations", T.LongType()),
    ]
)


class Rollups:
    """The daily sums of the history at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.history, self.folder = Folder(spark, self.path), Folder(spark, f"{self.path}/{FOLDER}")

    def _months(self) -> dict[str, str]:
        """A mark of the files that each month's folder has."""
        marks = {}
        for part in self.history.names():
            if part.startswith("run_month="):
                files = [n for n in self.history.names(part) if n.endswith(".parquet")]
                marks[part] = hashlib.sha256(json.dumps(files).encode()).hexdigest()[:32]
        return marks

    def refresh(self) -> list[str]:
        """Make the daily sums of months that changed; their folders' names are returned.

        A month's sums are written under the mark of the files they were made of, then older ones are removed.
        """
        changed = {p: m for p, m in self._months().items() if not self.folder.exists(f"{p}/{m}/_SUCCESS")}
        if not changed:
            return []
        months = [F.lit(p.split("=")[1]).cast("date") for p in changed if not p.endswith(NO_MONTH)]
        here = F.col("run_month").isin(months)
        if any(p.endswith(NO_MONTH) for p in changed):
            here |= F.col("run_month").isNull()
        rows = read_results(self.spark, self.path).where(here & is_regular())
        daily = rows.groupBy(*LEVELS, F.to_date("run_start_timestamp").alias("day"), "run_month").agg(
            violation_total().alias("violations")
        )
        aside = f"_staging-{uuid.uuid4().hex}"
        daily.hint("rebalance", "run_month").write.partitionBy("run_month").parquet(f"{self.folder.path}/{aside}")
        for part, mark in changed.items():
            self.folder.make(f"{aside}/{part}")  # a month may have no row that counts
            self.folder.write(f"{aside}/{part}/_SUCCESS", "")
            self.folder.move(f"{aside}/{part}", f"{part}/{mark}")  # or another writer was first
            for old in self.folder.names(part):
                if old != mark:
                    self.folder.remove(f"{part}/{old}")
        self.folder.remove(aside)
        return sorted(changed)

    def daily(self) -> DataFrame:
        """Violations per check and day, of the months as they were last refreshed."""
        marks = [f"{self.folder.path}/{part}/{m}" for part in self.folder.names() for m in self.folder.names(part) if part[:1] != "_"]
        if not marks:
            return self.spark.createDataFrame([], DAILY_SCHEMA)
        return self.spark.read.schema(DAILY_SCHEMA).parquet(*marks)

    def series(self, level: str, unit: str = "day") -> DataFrame:
        """Violations per entity and period, as :func:`tablewarden.plans.history.daily` and ``monthly`` give them."""
        return self.daily().groupBy(*path_to(level), period_of(unit, "day")).agg(F.sum("violations").alias("violations"))

    def levels(self, unit: str = "month") -> DataFrame:
        """All levels at once, as :func:`tablewarden.plans.history.rollup_levels` gives them."""
        days = self.daily().groupBy(*LEVELS, period_of(unit, "day")).agg(F.sum("violations").alias("violations"))
        return rolled_up(days)
