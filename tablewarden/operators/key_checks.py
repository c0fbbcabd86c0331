"""Uniqueness and references.

All of them aggregate to one row per key before anything else happens. Spark
combines rows of a key in the task that reads them, so a key that holds a large
share of the table costs one row per task, not one huge reducer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _complete(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per complete key; rows with a NULL key part are left out."""
    return df.where(_complete(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that come more than once, with their number of rows ``n``."""
    return key_counts(df, keys).where(F.col("n") > 1)


def uniqueness_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows too many: a key on n rows violates n - 1 times.

    A table loaded twice therefore scores one table's worth of rows.
    """
    excess = F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint"))
    return duplicate_keys(df, keys).agg(excess.alias("violations"))


def orphan_keys(
    child: DataFrame, parent: DataFrame, keys: Sequence[str], parent_keys: Sequence[str] | None = None
) -> DataFrame:
    """Keys of child rows that no parent row has, with their number of rows ``n``.

    A NULL key part passes. This is an anti join written as one aggregation of
    both sides stacked: Spark would move the join below the counting of child rows
    and so shuffle every row of a frequent key to one place. Here either side
    sends one row per key and task, in a single shuffle.
    """
    columns = [f"_k{i}" for i in range(len(keys))]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    children = child.where(_complete(keys)).select(
        *[F.col(k).alias(c) for k, c in zip(keys, columns)], one.alias("n"), none.alias("_parents")
    )
    parent_keys = list(parent_keys or keys)
    parents = parent.where(_complete(parent_keys)).select(
        *[F.col(p).alias(c) for p, c in zip(parent_keys, columns)], none.alias("n"), one.alias("_parents")
    )
    return (
        children.unionByName(parents)
        .groupBy(*columns)
        .agg(F.sum("n").alias("n"), F.max("_parents").alias("_parents"))
        .where((F.col("_parents") == 0) & (F.col("n") > 0))
        .select(*[F.col(c).alias(k) for k, c in zip(keys, columns)], "n")
    )


def foreign_key_violations(
    child: DataFrame, parent: DataFrame, keys: Sequence[str], parent_keys: Sequence[str] | None = None
) -> DataFrame:
    """Number of child rows whose key no parent row has."""
    rows = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
    return orphan_keys(child, parent, keys, parent_keys).agg(rows.alias("violations"))


def ordered_pair_violations(
    starts: DataFrame,
    stops: DataFrame,
    on: tuple[str, str],
    start: str,
    stop: str,
    strict: bool = True,
) -> DataFrame:
    """``start < stop`` across two tables: bad rows of ``stops``.

    ``on`` names the key of ``starts`` and of ``stops``. A key with several start
    rows is held to the latest of them, so rows are never paired many to many.
    A key on very many stops makes one large join partition, which the adaptive
    skew join splits: only counting follows, so no partitioning has to be kept.
    That works where both inputs of the join come straight from a shuffle, which
    is why the starts are grouped by a shard of the key as well.
    """
    start_key, stop_key = on
    shard = F.pmod(F.xxhash64(start_key), F.lit(1024))
    left = (
        starts.groupBy(F.col(start_key).alias("_k"), shard.alias("_shard"))
        .agg(F.max(start).alias("_start"))
        .drop("_shard")
    )
    right = stops.select(F.col(stop_key).alias("_sk"), F.col(stop).alias("_stop"))
    joined = right.join(left, F.col("_sk") == F.col("_k"))
    good = F.col("_start") < F.col("_stop") if strict else F.col("_start") <= F.col("_stop")
    return joined.where(~good).agg(F.count(F.lit(1)).alias("violations"))


def not_empty_violations(df: DataFrame) -> DataFrame:
    """1 if the table has no row, otherwise 0; reads no column."""
    found = F.count(F.lit(1))
    return df.select(F.lit(1).alias("one")).limit(1).agg(
        F.when(found == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("violations")
    )
