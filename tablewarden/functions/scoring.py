"""Severity, scope and the small formulas that go with scored results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.schema import SEVERITY_WEIGHTS


def severity_weight(severity: Column) -> Column:
    """NULL weighs 0; a name outside the scale is an error."""
    weight = F.when(severity.isNull(), F.lit(0))
    for name, value in SEVERITY_WEIGHTS.items():
        weight = weight.when(severity == name, F.lit(value))
    unknown = F.raise_error(F.concat(F.lit("unknown severity: "), severity))
    return weight.otherwise(unknown.cast("int"))


def violation_scope(
    violations: Column, unit: Column, partition_key: Column, avg_rows: Column
) -> Column:
    """How much of the table is affected, 0 to 100 for counts up to the estimate.

    A violated whole-table check is 100. Row counts are a percentage of the row
    estimate; on a partitioned table the estimate is per partition, and one
    partition counts as a hundredth of the table. Unknown counts or estimates
    (NULL, or an estimate of 0) give NULL.
    """
    share = F.try_divide(violations.cast("double"), avg_rows.cast("double"))
    return (
        F.when(violations == 0, F.lit(0.0))
        .when(violations.isNotNull() & (unit == "tables"), F.lit(100.0))
        .when(partition_key.isNull(), share * 100)
        .otherwise(share)
    )


def severity_score(weight: Column, scope: Column) -> Column:
    """Whole number: 0 for no violation, otherwise at least 1 and at most 100."""
    score = scope * weight / 100
    clamped = F.greatest(F.lit(1.0), F.least(F.lit(100.0), score)).cast("int")
    return F.when(score == 0, F.lit(0)).when(score.isNotNull(), clamped)


def effective_mode(table_mode: Column, check_mode: Column) -> Column:
    """Incremental only where both the table and the check are."""
    both = (table_mode == "incremental") & (check_mode == "incremental")
    return F.when(both, F.lit("incremental")).otherwise(F.lit("full"))


def partition_value(mode: Column, ts: Column) -> Column:
    """Year and three-digit day of the year, NULL where there is no mode."""
    return F.when(mode.isNotNull(), F.date_format(ts, "yyyyDDD"))


def partition_key_text(key: Column) -> Column:
    return F.coalesce(key, F.lit(""))


def partitioned_flag(key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("0")).otherwise(F.lit("1"))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def reformat_time(text: Column, given: str, wanted: str = "yyyy-MM-dd") -> Column:
    """Re-write a date label; a missing day means the first of the month."""
    return F.date_format(F.to_timestamp(text, given), wanted)


def clean_name(name: Column) -> Column:
    """Entity names usable as identifiers: every ``-`` becomes ``_``."""
    return F.translate(name, "-", "_")


def pass_label(violations: Column) -> Column:
    """An unknown latest count is not a pass."""
    return F.when(violations == 0, F.lit("Passing")).otherwise(F.lit("Failing"))
