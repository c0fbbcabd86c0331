"""Counting violations of many checks of one table in one scan."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wider rows leave whole-stage code generation (spark.sql.codegen.maxFields is 100). More checks
#: than that read the table again; the counts do not depend on it.
MAX_PER_SCAN = 90


def empty_table() -> Column:
    """Aggregate: 1 where the scanned table has no row, otherwise 0."""
    return F.when(F.count(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def _scans(names: list[str]) -> list[list[str]]:
    return [names[i : i + MAX_PER_SCAN] for i in range(0, len(names), MAX_PER_SCAN)]


def _unfold(scanned: DataFrame, counts: list[Column], names: list[str], *keys: Column) -> DataFrame:
    """Aggregate to one wide row (per key), then one row per check."""
    wide = scanned.groupBy(*keys).agg(*[c.cast("bigint").alias(f"v{i}") for i, c in enumerate(counts)])
    kept = [c for c in wide.columns[: len(keys)]]
    long = wide.select(
        *kept, F.posexplode(F.array(*[f"v{i}" for i in range(len(names))])).alias("_i", "violations")
    )
    alias = F.from_json(F.lit(json.dumps(names)), "array<string>")[F.col("_i")]
    return long.select(*kept, alias.alias("check_alias"), "violations")


def count_violations(
    df: DataFrame,
    row_checks: Mapping[str, Column],
    table_checks: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows ``check_alias``, ``violations`` for all checks of one table.

    ``row_checks`` map an alias to the predicate of a bad row, ``table_checks`` to
    an aggregate giving the count itself. All of them are partial aggregates of
    one pass over the columns they name (up to MAX_PER_SCAN of them); one row per
    task is shuffled. Aliases
    are data, not column names, so users may choose any text.

    Row checks alone look at bad rows only: *any of the predicates* is a filter of
    the scan. Where all of them are comparisons with literals it reaches the file
    reader, and row groups whose statistics show them clean are not even read.
    """
    names = list(row_checks)
    if table_checks:
        counts = {a: F.count_if(p) for a, p in row_checks.items()} | dict(table_checks)
        parts = [_unfold(df, [counts[a] for a in some], some) for some in _scans(list(counts))]
    else:
        parts = [
            _unfold(
                df.where(reduce(lambda a, b: a | b, [row_checks[a] for a in some])),
                [F.count_if(row_checks[a]) for a in some],
                some,
            )
            for some in _scans(names)
        ]
    return reduce(DataFrame.unionByName, parts)


def count_bad_rows(df: DataFrame, bad: Column) -> DataFrame:
    """One check on its own: as a filter the predicate reaches the file scan."""
    return df.where(bad).agg(F.count(F.lit(1)).alias("violations"))


def count_by_partition(
    df: DataFrame, partition: Column | str, row_checks: Mapping[str, Column]
) -> DataFrame:
    """Violations per partition value of an incrementally loaded table."""
    partition = F.col(partition) if isinstance(partition, str) else partition
    parts = [
        _unfold(df, [F.count_if(row_checks[a]) for a in some], some, partition.alias("partition_value"))
        for some in _scans(list(row_checks))
    ]
    return reduce(DataFrame.unionByName, parts)


def count_by_day(df: DataFrame, day: Column, row_checks: Mapping[str, Column]) -> DataFrame:
    """``partition_value`` (the day as text), ``check_alias``, ``partition_rows``, ``violations``."""
    parts = []
    for some in _scans(list(row_checks)):
        counts = [F.count_if(row_checks[a]) for a in some]
        wide = df.groupBy(day.cast("string").alias("partition_value")).agg(
            F.count(F.lit(1)).alias("partition_rows"), *[c.cast("bigint").alias(f"v{i}") for i, c in enumerate(counts)]
        )
        values = F.array(*[f"v{i}" for i in range(len(some))])
        long = wide.select("partition_value", "partition_rows", F.posexplode(values).alias("_i", "violations"))
        alias = F.from_json(F.lit(json.dumps(some)), "array<string>")[F.col("_i")]
        parts.append(long.select("partition_value", alias.alias("check_alias"), "partition_rows", "violations"))
    return reduce(DataFrame.unionByName, parts)
