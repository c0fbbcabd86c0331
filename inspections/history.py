"""Roll-ups of the derived results history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspections import ORACLES, query
from inspections.fixtures import DAY_VAR, HISTORY_SQL, history
from tablewarden.functions.variables import vars_json
from tablewarden.plans import history as plan
from tablewarden.plans.report import report_lines, result_problems, run_report
from tablewarden.plans.rollups import Rollups
from tablewarden.schema import LEVELS, RESULT_SCHEMA
from tablewarden.session import shared_folder
from tablewarden.sources import results as store

_SHORT = {
    "instance": "instance_name",
    "database": "database_name",
    "table": "table_name",
    "check": "check_name",
}


def _path_sql(level: str) -> str:
    return ", ".join(plan.path_to(level))


def _series_sql(level: str, unit: str) -> str:
    keys = _path_sql(level)
    return f"""
    SELECT {keys}, CAST(date_trunc('{unit}', run_start_timestamp) AS DATE) AS period,
           CAST(sum(check_violation_cnt) AS BIGINT) AS violations
    FROM history WHERE check_type = 'rule' GROUP BY {keys}, period"""


def _register_series(name: str, level: str) -> None:
    @query(f"monthly_by_{name}", f"WITH {HISTORY_SQL} {_series_sql(level, 'month')}")
    def monthly(spark, sf_dir):
        return plan.monthly(history(spark, sf_dir), level)

    @query(f"daily_by_{name}", f"WITH {HISTORY_SQL} {_series_sql(level, 'day')}")
    def daily(spark, sf_dir):
        return plan.in_series_order(plan.daily(history(spark, sf_dir), level), level)


for _name, _level in _SHORT.items():
    _register_series(_name, _level)


def _each_level(make) -> DataFrame:
    """The same for all levels; columns below a level are NULL."""
    parts = []
    for level in LEVELS:
        part = make(level).withColumn("level", F.lit(level))
        for below in LEVELS:
            if below not in part.columns:
                part = part.withColumn(below, F.lit(None).cast("string"))
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def _each_level_sql(body) -> str:
    parts = []
    for i, level in enumerate(LEVELS):
        keys = ", ".join(
            f"CAST({c} AS VARCHAR) AS {c}" if j <= i else f"CAST(NULL AS VARCHAR) AS {c}"
            for j, c in enumerate(LEVELS)
        )
        parts.append(body(level, keys))
    return "\nUNION ALL\n".join(parts)


@query(
    "entities",
    f"WITH {HISTORY_SQL}"
    + _each_level_sql(
        lambda level, keys: f"""
        SELECT DISTINCT {keys}, replace({level}, '-', '_') AS clean_name, '{level}' AS level
        FROM history {"WHERE check_type <> 'setup'" if level == "check_name" else ""}"""
    ),
)
def entities(spark, sf_dir):
    results = history(spark, sf_dir)
    return _each_level(lambda level: plan.entities(results, level))


@query(
    "entity_search",
    f"""WITH {HISTORY_SQL}
    SELECT DISTINCT instance_name, database_name, table_name, check_name, check_name AS clean_name
    FROM history WHERE check_type <> 'setup' AND check_name ILIKE '%TAX%RANGE%'
    """,
)
def entity_search(spark, sf_dir):
    return plan.search(history(spark, sf_dir), "check_name", "TAX%RANGE")


@query(
    "drill_down",
    f"""WITH {HISTORY_SQL}
    SELECT instance_name, database_name, table_name,
           CAST(date_trunc('month', run_start_timestamp) AS DATE) AS period,
           CAST(sum(check_violation_cnt) AS BIGINT) AS violations
    FROM history WHERE check_type = 'rule' AND instance_name = 'O' AND database_name = 'N'
    GROUP BY ALL
    """,
)
def drill_down(spark, sf_dir):
    branch = plan.drill_down(history(spark, sf_dir), instance="O", database="N")
    return plan.monthly(branch, "table_name")


@query(
    "run_history",
    f"""WITH {HISTORY_SQL}
    SELECT check_type, check_mode, check_unit, check_status, run_id, run_start_timestamp,
           run_stop_timestamp
    FROM history WHERE instance_name = 'F' AND database_name = 'A' AND table_name = 'lineitem'
      AND check_name = 'tax_range_ck'
    """,
)
def run_history(spark, sf_dir):
    return plan.run_history(history(spark, sf_dir), "F", "A", "lineitem", "tax_range_ck")


@query(
    "tables_affected",
    f"""WITH {HISTORY_SQL}
    SELECT DISTINCT table_name FROM history
    WHERE instance_name = 'F' AND database_name = 'A' AND table_name = 'lineitem'
      AND check_name = 'tax_range_ck'
    """,
)
def tables_affected(spark, sf_dir):
    return plan.tables_affected(history(spark, sf_dir), "F", "A", "lineitem", "tax_range_ck")


def _check_series_sql(unit: str) -> str:
    return f"""WITH {HISTORY_SQL}
    SELECT CAST(date_trunc('{unit}', run_start_timestamp) AS DATE) AS period,
           CAST(coalesce(sum(check_violation_cnt), 0) AS BIGINT) AS violations
    FROM history WHERE instance_name = 'F' AND database_name = 'A' AND table_name = 'lineitem'
      AND check_name = 'qty_range_ck' GROUP BY 1"""


@query("check_detail_daily", _check_series_sql("day"))
def check_detail_daily(spark, sf_dir):
    return plan.check_series(history(spark, sf_dir), "F", "A", "lineitem", "qty_range_ck")


@query("check_detail_monthly", _check_series_sql("month"))
def check_detail_monthly(spark, sf_dir):
    return plan.check_series(history(spark, sf_dir), "F", "A", "lineitem", "qty_range_ck", "month")


@query(
    "rollup_levels",
    f"""WITH {HISTORY_SQL},
    months AS (
        SELECT *, CAST(date_trunc('month', run_start_timestamp) AS DATE) AS period FROM history
        WHERE check_type = 'rule')
    SELECT instance_name, database_name, table_name, check_name, period,
           CAST(sum(check_violation_cnt) AS BIGINT) AS violations,
           CASE grouping_id(instance_name, database_name, table_name, check_name)
               WHEN 7 THEN 'instance_name' WHEN 3 THEN 'database_name'
               WHEN 1 THEN 'table_name' ELSE 'check_name' END AS level
    FROM months
    GROUP BY GROUPING SETS (
        (instance_name, period), (instance_name, database_name, period),
        (instance_name, database_name, table_name, period),
        (instance_name, database_name, table_name, check_name, period))
    """,
)
def rollup_levels(spark, sf_dir):
    return plan.rollup_levels(history(spark, sf_dir))


@query("rollup_levels_kept", ORACLES["rollup_levels"])
def rollup_levels_kept(spark, sf_dir):
    """The same, from daily sums that are kept by month beside a stored history."""
    path = shared_folder(spark)
    store.append_results(spark, history(spark, sf_dir), path)
    rollups = Rollups(spark, path)
    rollups.refresh()
    return rollups.levels()


@query(
    "max_rc",
    f"WITH {HISTORY_SQL} SELECT CAST(greatest(0, max(check_rc)) AS INTEGER) AS max_rc FROM history",
)
def max_rc(spark, sf_dir):
    return plan.max_rc(history(spark, sf_dir))


@query(
    "series_lengths",
    f"WITH {HISTORY_SQL}, points AS (SELECT *, CAST(run_start_timestamp AS DATE) AS day, "
    "date_trunc('month', run_start_timestamp) AS month FROM history)"
    + _each_level_sql(
        lambda level, keys: f"""
        SELECT {keys}, count(DISTINCT month) FILTER (WHERE check_type = 'rule') AS year_points,
               least(count(DISTINCT day) FILTER (WHERE check_type = 'rule'), 32) AS month_points,
               least(count(DISTINCT day) FILTER (WHERE check_type = 'rule'), 8) AS week_points,
               '{level}' AS level
        FROM points GROUP BY {_path_sql(level)}"""
    ),
)
def series_lengths(spark, sf_dir):
    results = history(spark, sf_dir)
    return _each_level(lambda level: plan.series_lengths(results, level))


def _last_sql(level: str, n: int) -> str:
    keys = _path_sql(level)
    return f"""WITH {HISTORY_SQL}, series AS ({_series_sql(level, "day")}),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY period DESC) AS rn FROM series)
    SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= {n}"""


@query("last_month", _last_sql("check_name", 32))
def last_month(spark, sf_dir):
    series = plan.daily(history(spark, sf_dir), "check_name")
    last = plan.last_points(series, "check_name", plan.LAST_MONTH_POINTS)
    return plan.in_series_order(last, "check_name")


@query("last_week", _last_sql("database_name", 8))
def last_week(spark, sf_dir):
    series = plan.daily(history(spark, sf_dir), "database_name")
    last = plan.last_points(series, "database_name", plan.LAST_WEEK_POINTS)
    return plan.in_series_order(last, "database_name")


@query(
    "current_status",
    f"WITH {HISTORY_SQL}"
    + _each_level_sql(
        lambda level, keys: f"""
        SELECT {keys}, run_start_timestamp, check_violation_cnt AS violations,
               CASE WHEN check_violation_cnt = 0 THEN 'Passing' ELSE 'Failing' END AS status,
               '{level}' AS level
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY {_path_sql(level)}
                  ORDER BY run_start_timestamp DESC, database_name DESC, table_name DESC,
                           check_name DESC) AS rn
              FROM history WHERE check_type = 'rule')
        WHERE rn = 1"""
    ),
)
def current_status(spark, sf_dir):
    return plan.current_status(history(spark, sf_dir))


_REPORT_SQL = f"""
    SELECT table_name, check_name, check_mode AS mode, CAST(check_rc AS VARCHAR) AS rc,
           coalesce(check_violation_cnt, 0) AS violations,
           CASE WHEN day_var IS NULL THEN '' ELSE '{{"{DAY_VAR}":"' || day_var || '"}}' END
               AS vars,
           data_start_timestamp AS data_start, data_stop_timestamp AS data_stop
    FROM history"""


@query("run_report", f"WITH {HISTORY_SQL} {_REPORT_SQL}")
def detailed_report(spark, sf_dir):
    return run_report(history(spark, sf_dir), detail=True)


@query(
    "run_report_lines",
    f"""WITH {HISTORY_SQL}
    SELECT table_name || '|' || check_name || '|' || mode || '|' || rc || '|' || violations AS line
    FROM ({_REPORT_SQL})""",
)
def basic_report_lines(spark, sf_dir):
    return report_lines(run_report(history(spark, sf_dir)))


@query(
    "validate_results",
    f"""WITH {HISTORY_SQL}
    SELECT instance_name, database_name, check_name, run_id,
           concat_ws(',',
               CASE WHEN database_name = 'R' AND check_type = 'rule' THEN 'check_type' END,
               CASE WHEN instance_name = 'F' AND check_name = 'setup_day'
                    THEN 'check_policy_type' END,
               CASE WHEN check_violation_cnt > 1 THEN 'check_mode' END,
               CASE WHEN check_violation_cnt = 1 THEN 'run_stop_timestamp' END) AS problems
    FROM history
    WHERE (database_name = 'R' AND check_type = 'rule')
       OR (instance_name = 'F' AND check_name = 'setup_day') OR check_violation_cnt >= 1
    """,
)
def validate_results(spark, sf_dir):
    """Rows are spoilt in four ways before they are validated."""
    count = F.col("check_violation_cnt")
    returned = (F.col("database_name") == "R") & (F.col("check_type") == "rule")
    setup = (F.col("instance_name") == "F") & (F.col("check_name") == "setup_day")
    spoilt = history(spark, sf_dir).withColumns(
        {
            "check_type": F.when(returned, F.lit("warning")).otherwise(F.col("check_type")),
            "check_policy_type": F.when(setup, F.lit("rule")).otherwise(F.col("check_policy_type")),
            "check_mode": F.when(count > 1, F.lit("fullish")).otherwise(F.col("check_mode")),
            "run_stop_timestamp": F.when(
                F.coalesce(count, F.lit(0)) != 1, F.col("run_stop_timestamp")
            ),
        }
    )
    return result_problems(spoilt).select(
        "instance_name",
        "database_name",
        "check_name",
        "run_id",
        F.array_join("problems", ",").alias("problems"),
    )


_STORED_COLUMNS = [f.name for f in RESULT_SCHEMA if f.name not in ("env_vars",)]
_STORED_SQL = f"""WITH {HISTORY_SQL}
    SELECT instance_name, database_name, table_name, check_name, check_type, check_policy_type,
           check_mode, check_unit, check_status, run_id, run_start_timestamp, run_stop_timestamp,
           coalesce(data_start_timestamp, run_start_timestamp) AS data_start_timestamp,
           coalesce(data_stop_timestamp, run_stop_timestamp) AS data_stop_timestamp,
           check_rc, CAST(-1 AS DOUBLE) AS check_scope, -1 AS check_severity_score,
           check_violation_cnt,
           CASE WHEN day_var IS NULL THEN '' ELSE '{{"{DAY_VAR}":"' || day_var || '"}}' END AS vars
    FROM history"""


@query("results_append", _STORED_SQL)
def results_append(spark, sf_dir):
    """Stored in two parts, the second of which repeats the first; each row is there once."""
    import datetime as dt

    path = shared_folder(spark)
    rows = history(spark, sf_dir)
    begin = dt.datetime(2024, 1, 1)
    store.append_results(spark, rows.where(F.col("database_name") != "R"), path, begin)
    store.append_results(spark, rows, path, begin)
    stored = store.read_results(spark, path)
    return stored.withColumn("vars", vars_json(F.col("env_vars"))).drop("env_vars", "run_month")


@query("results_csv", _STORED_SQL)
def results_csv(spark, sf_dir):
    import datetime as dt

    path = shared_folder(spark)
    rows = store.with_window_fallback(history(spark, sf_dir), dt.datetime(2024, 1, 1))
    store.append_csv(rows, path)
    back = store.read_csv(spark, path)
    return back.withColumn("vars", F.coalesce("env_vars", F.lit(""))).drop("env_vars")
