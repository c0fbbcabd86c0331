"""Uniqueness across data windows: an index of the keys of older rows.

An incremental check sees the rows of its window only, so a key that came before is no duplicate to it. The index
keeps a 128-bit digest of every complete key with the number of its rows per day. Each run adds a file set of its
own, bucketed and sorted by the digest; the window's digests are dealt to the same buckets and merged with them, so
the old side is neither shuffled nor sorted, whatever its size. When there are many file sets they are merged into
one, bucket by bucket.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.key_checks import _complete
from tablewarden.sources.files import Folder

#: File sets of a level beyond which they are merged into one of the next level.
MOST_SETS = 4
#: A key's digest, a day with rows of it, how many the run added, and whether older rows had the key.
COLUMNS = "d1 bigint, d2 bigint, day date, n bigint, seen boolean"


def digested(df: DataFrame, keys: Sequence[str], day: Column) -> DataFrame:
    """``d1``, ``d2``, ``day`` of each row with a complete key."""
    return df.where(_complete(keys)).select(
        F.xxhash64(F.lit("first"), *keys).alias("d1"), F.xxhash64(F.lit("second"), *keys).alias("d2"), day.alias("day")
    )


class KeyIndex:
    """The index of one check, in ``path``. ``committed`` tells which of some runs (as text) have stored their result.

    File sets are named ``set-buckets-level-run``; those of merged levels have a mark that says what they hold.
    Tables of the session that stand for file sets are dropped by :meth:`close`.
    """

    def __init__(
        self, spark: SparkSession, path: str, run: str, committed: Callable[[list[str]], set[str]], buckets: int | None = None
    ) -> None:
        """``buckets`` is only asked for the first file set; unless given, it is the session's number of shuffle partitions."""
        self.spark, self.folder, self.run, self._committed = spark, Folder(spark, path), run, committed
        self._tables: list[str] = []
        known = [n for n in self.folder.names() if n.startswith("set-")]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if known:
            self.buckets = int(known[0].split("-")[1])

    def sets(self) -> list[str]:
        """File sets that count: of runs whose result is stored, this one's left out, and merged ones for their parts."""
        whole = [n for n in self.folder.names() if n.startswith("set-") and self.folder.exists(f"{n}/_SUCCESS")]
        merged = [n for n in whole if _level(n) and self.folder.exists(f"_holds-{n}")]
        held = {x for n in merged for x in self.folder.read(f"_holds-{n}").split()}
        runs = [n for n in whole if not _level(n) and _run(n) != self.run]
        done = self._committed([_run(n) for n in runs if _run(n) != BASE]) | {BASE}
        return [n for n in [*merged, *(n for n in runs if _run(n) in done)] if n not in held]

    def table(self, name: str) -> DataFrame:
        """A file set as a bucketed table."""
        known = f"key_index_{uuid.uuid4().hex}"
        self._tables.append(known)
        self.spark.sql(
            f"CREATE TABLE {known} ({COLUMNS}) USING parquet CLUSTERED BY (d1, d2) SORTED BY (d1, d2) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.folder.path}/{name}'"
        )
        return self.spark.table(known)

    def close(self) -> None:
        """Drop the tables; their files stay."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")

    def __enter__(self) -> KeyIndex:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def write(self, counts: DataFrame, run: str | None = None, level: int = 0) -> str:
        """Write a file set, in place of one that an earlier attempt of the run left."""
        name = f"set-{self.buckets}-{level}-{run or self.run}"
        self.folder.remove(name)
        known = f"key_index_{uuid.uuid4().hex}"
        self._tables.append(known)
        (
            counts.select("d1", "d2", "day", "n", "seen")
            .write.format("parquet")
            .bucketBy(self.buckets, "d1", "d2")
            .sortBy("d1", "d2")
            .option("path", f"{self.folder.path}/{name}")
            .saveAsTable(known)
        )
        if not self.folder.exists(f"{name}/_SUCCESS"):
            self.folder.write(f"{name}/_SUCCESS", "")
        return name

    def merge(self) -> None:
        """Put the file sets of a level together once they are many: each entry is written again once per level."""
        while True:
            sets = self.sets()
            full = [level for level in {_level(n) for n in sets} if sum(_level(n) == level for n in sets) > MOST_SETS]
            if not full:
                return
            parts = [n for n in sets if _level(n) == min(full)]
            every = reduce(DataFrame.unionByName, [self.table(n) for n in parts])
            dealt = every.repartition(self.buckets, "d1", "d2")
            name = self.write(dealt, uuid.uuid4().hex, min(full) + 1)
            self.folder.write(f"_holds-{name}", "\n".join(parts))
            for n in parts:
                self.folder.remove(n)
                self.folder.remove(f"_holds-{n}")

    def found(self, window: DataFrame, late: Sequence[dt.date] = ()) -> DataFrame:
        """The keys of a window's digests by day: ``n`` rows that are new, and whether older rows had the key (``seen``).

        The index knows some rows of a late day already; only those beyond them are new. The window's keys, one row
        each per day, are dealt to the buckets of the index; its file sets are read as they lie.
        """
        counts = window.groupBy("d1", "d2", "day").agg(F.count(F.lit(1)).alias("n"))
        rows = counts.repartition(self.buckets, "d1", "d2").withColumns({"seen": F.lit(False), "_known": F.lit(0).cast("bigint")})
        again = F.col("day").isin(list(late))
        for name in self.sets():
            days = F.collect_list(F.when(again, F.struct("day", "n")))  # of a key, at most one for each late day and run
            old = self.table(name).groupBy("d1", "d2").agg(F.lit(True).alias("_old"), days.alias("_days"))
            mine = F.aggregate(
                F.filter(F.coalesce("_days", F.array()), lambda x: x["day"].eqNullSafe(F.col("day"))),
                F.lit(0).cast("bigint"),
                lambda total, x: total + x["n"],
            )
            rows = rows.join(old, ["d1", "d2"], "left").select(
                "d1", "d2", "day", "n",
                (F.col("seen") | F.coalesce("_old", F.lit(False))).alias("seen"),
                (F.col("_known") + mine).alias("_known"),
            )
        return rows.withColumn("n", F.col("n") - F.col("_known")).drop("_known").where("n > 0")


#: The run that stands for rows older than the index.
BASE = "base"


def _level(name: str) -> int:
    return int(name.split("-")[2])


def _run(name: str) -> str:
    return name.split("-", 3)[3]


def excess(found: DataFrame) -> DataFrame:
    """One row, ``violations``: new rows of all keys, less one for each key that no older row had."""
    keys = found.groupBy("d1", "d2").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"))
    more = F.col("n") - F.when(F.col("seen"), F.lit(0)).otherwise(F.lit(1))
    return keys.agg(F.coalesce(F.sum(more), F.lit(0)).alias("violations"))


def new_violations(
    index: KeyIndex, df: DataFrame, keys: Sequence[str], day: Column, late: Sequence[dt.date] = (), older: DataFrame | None = None
) -> int:
    """Rows too many that the window ``df`` adds; its keys are entered in the index.

    ``older`` has the rows before the window, and is read only if there is no index of them yet.
    """
    index.merge()
    if older is not None and not index.sets():
        counts = digested(older, keys, day).groupBy("d1", "d2", "day").agg(F.count(F.lit(1)).alias("n"))
        index.write(counts.withColumn("seen", F.lit(False)).repartition(index.buckets, "d1", "d2"), BASE)
    name = index.write(index.found(digested(df, keys, day), late))
    return excess(index.table(name)).first()["violations"]
