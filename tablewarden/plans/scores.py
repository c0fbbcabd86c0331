"""Scored results: what a violation means for its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.scoring import (
    effective_mode,
    severity_score,
    severity_weight,
    violation_scope,
)


PLACE = ["instance_name", "database_name"]


def _once(dim: DataFrame, *keys: str) -> DataFrame:
    """Fails the query where two rows of a dimension claim the same key."""
    rows = dim.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    named = F.concat(F.lit("configured twice: "), F.concat_ws(".", *keys))
    return rows.where(
        F.when(F.col("_same") == 1, F.lit(True)).otherwise(F.raise_error(named).cast("boolean"))
    ).drop("_same")


def score_results(results: DataFrame, dim_table: DataFrame, dim_check: DataFrame) -> DataFrame:
    """Add policy type, unit, mode, scope and severity score from the configuration.

    ``results`` and both dimensions have instance, database and table (and check) names, and are
    joined on all of them. A result the configuration does not know stays, with its own unit, mode
    and policy if it has them and neither scope nor score. A key configured twice is an error.
    No side is marked for broadcast: Spark does that by itself where the measured size allows, and
    otherwise splits a check that holds much of the history. The two dimensions are always merged:
    before documents are unfolded their size is a guess that is far too low, and Spark keeps a
    broadcast planned by it, as a merge has more shuffles.
    """
    table_keys, check_keys = [*PLACE, "table_name"], [*PLACE, "table_name", "check_name"]
    tables = _once(dim_table, *table_keys).hint("merge")
    dims = _once(dim_check, *check_keys).join(tables, table_keys).select(
        *[F.col(k).alias(f"_{k}") for k in check_keys],
        F.col("policy_type").alias("_policy"),
        F.col("violation_unit").alias("_unit"),
        effective_mode(F.col("table_mode"), F.col("config_mode")).alias("_mode"),
        severity_weight(F.col("severity")).alias("_weight"),
        F.col("partition_key").alias("_partition_key"),
        F.col("avg_rows").alias("_avg_rows"),
        F.lit(True).alias("_configured"),
    )
    given = {"check_policy_type": "_policy", "check_unit": "_unit", "check_mode": "_mode"}
    same = [results[k] == F.col(f"_{k}") for k in check_keys]
    joined = results.join(dims, same, "left")
    known = F.coalesce("_configured", F.lit(False))
    for column, configured in given.items():
        own = F.col(column) if column in results.columns else F.lit(None).cast("string")
        joined = joined.withColumn(column, F.when(known, F.col(configured)).otherwise(own))
    scope = violation_scope(
        F.col("check_violation_cnt"), F.col("check_unit"), F.col("_partition_key"), F.col("_avg_rows")
    )
    return (
        joined.withColumn("check_scope", F.when(known, scope))
        .withColumn("check_severity_score", F.when(known, severity_score(F.col("_weight"), F.col("check_scope"))))
        .drop(*[f"_{k}" for k in check_keys], "_policy", "_unit", "_mode", "_weight")
        .drop("_partition_key", "_avg_rows", "_configured")
    )
