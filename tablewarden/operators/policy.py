"""Policy checks on the files of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def too_small(min_bytes: int) -> Column:
    """Predicate over :func:`tablewarden.sources.tables.list_files`."""
    return F.col("length") < min_bytes


def wrong_extension(*allowed: str) -> Column:
    """The file name ends in none of the allowed extensions (``parquet``, ``orc``...)."""
    name = F.lower(F.element_at(F.split(F.col("path"), "/"), -1))
    extension = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1))
    return ~F.coalesce(extension.isin([a.lower().lstrip(".") for a in allowed]), F.lit(False))


def audit_files(files: DataFrame, **bad: Column) -> DataFrame:
    """Rows ``check_alias``, ``n_files``, ``violations`` for each named predicate."""
    names = list(bad)
    wide = files.agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.count_if(bad[a]).alias(f"v{i}") for i, a in enumerate(names)],
    )
    pairs = [
        F.struct(
            F.lit(a).alias("check_alias"), F.col("n_files"), F.col(f"v{i}").alias("violations")
        )
        for i, a in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*pairs)))
