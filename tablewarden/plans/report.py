"""Result rows as a report, and the rules result rows have to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.variables import vars_json
from tablewarden.schema import CHECK_TYPES, POLICY_TYPES, RESULT_MODES, STATUSES, UNITS


def run_report(results: DataFrame, detail: bool = False) -> DataFrame:
    """What a run found: setups first within each table, then checks, by name.

    Five columns, eight with ``detail``. A missing mode or rc reads ``unk``, a
    missing count 0. Teardowns are not reported.
    """
    blank = F.nullif(F.col("check_mode"), F.lit(""))
    columns = [
        F.col("table_name"),
        F.col("check_name"),
        F.coalesce(blank, F.lit("unk")).alias("mode"),
        F.coalesce(F.col("check_rc").cast("string"), F.lit("unk")).alias("rc"),
        F.coalesce(F.col("check_violation_cnt"), F.lit(0)).alias("violations"),
    ]
    if detail:
        columns += [
            vars_json(F.col("env_vars")).alias("vars"),
            F.col("data_start_timestamp").alias("data_start"),
            F.col("data_stop_timestamp").alias("data_stop"),
        ]
    stage = F.when(F.col("check_type") == "setup", F.lit(0)).otherwise(F.lit(1))
    return (
        results.where(F.col("check_type").isNull() | (F.col("check_type") != "teardown"))
        .orderBy("table_name", stage, "check_name")
        .select(*columns)
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text, fields joined by ``|``."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    return report.select(F.concat_ws("|", *fields).alias("line"))


def _unless(good: Column, text: str, null_ok: bool = False) -> Column:
    return F.when(~F.coalesce(good, F.lit(null_ok)), F.lit(text))


def result_problems(results: DataFrame) -> DataFrame:
    """One row per result that breaks a rule, with ``problems`` naming the columns.

    Count and scores are typed columns here, so what is left of *numeric* is that
    rc, scope and severity are present.
    """
    problems = F.array_compact(
        F.array(
            _unless(F.col("check_rc").isNotNull(), "check_rc"),
            _unless(F.col("check_violation_cnt") >= -1, "check_violation_cnt", null_ok=True),
            _unless(F.col("check_type").isin(CHECK_TYPES), "check_type"),
            _unless(F.col("check_policy_type").isin(POLICY_TYPES), "check_policy_type"),
            _unless(F.col("check_unit").isin(UNITS), "check_unit"),
            _unless(F.col("check_mode").isin(RESULT_MODES), "check_mode", null_ok=True),
            _unless(F.col("check_status").isin(STATUSES), "check_status", null_ok=True),
            _unless(F.col("check_scope").isNotNull(), "check_scope"),
            _unless(F.col("check_severity_score").isNotNull(), "check_severity_score"),
            _unless(F.col("run_start_timestamp").isNotNull(), "run_start_timestamp"),
            _unless(F.col("run_stop_timestamp").isNotNull(), "run_stop_timestamp"),
        )
    )
    return results.withColumn("problems", problems).where(F.size("problems") > 0)
