"""What one run leaves behind for the next."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from inspections import query
from inspections.fixtures import DAY_VAR, HISTORY_SQL, history
from tablewarden.functions.moments import moment
from tablewarden.functions.variables import sorted_vars_text
from tablewarden.sources.tables import read_table
from tablewarden.streaming import incremental

_CUT = dt.datetime(1995, 1, 10)


@query(
    "prior_vars",
    f"""WITH {HISTORY_SQL}
    SELECT instance_name, database_name, table_name, check_name, run_start_timestamp,
           '{DAY_VAR}=' || day_var AS vars, '{DAY_VAR}_prior=' || day_var AS prior_vars
    FROM (SELECT *, row_number() OVER (
              PARTITION BY instance_name, database_name, table_name, check_name
              ORDER BY run_start_timestamp DESC) AS rn
          FROM history WHERE check_type = 'setup')
    WHERE rn = 1
    """,
)
def prior_vars(spark, sf_dir):
    return incremental.prior_vars(history(spark, sf_dir)).select(
        "instance_name",
        "database_name",
        "table_name",
        "check_name",
        "run_start_timestamp",
        sorted_vars_text(F.col("env_vars")).alias("vars"),
        sorted_vars_text(F.col("prior_vars")).alias("prior_vars"),
    )


@query(
    "incremental_window",
    f"""WITH {HISTORY_SQL},
    stops AS (
        SELECT instance_name, database_name, max(data_stop_timestamp) AS data_start FROM history
        WHERE run_start_timestamp < TIMESTAMP '1995-01-10' AND database_name <> 'R'
        GROUP BY ALL),
    marks AS (
        SELECT l_linestatus AS instance_name, l_returnflag AS database_name,
               max(l_shipdate) AS data_stop
        FROM lineitem GROUP BY ALL)
    SELECT instance_name, database_name, data_start, data_stop
    FROM marks LEFT JOIN stops USING (instance_name, database_name)
    """,
)
def incremental_window(spark, sf_dir):
    """The history ends early and knows nothing of one database: its window is open."""
    keys = ["instance_name", "database_name"]
    past = history(spark, sf_dir).where(
        (F.col("run_start_timestamp") < moment(_CUT))
        & (F.col("database_name") != "R")
    )
    lineitem = read_table(spark, "lineitem", directory=sf_dir).select(
        F.col("l_linestatus").alias("instance_name"),
        F.col("l_returnflag").alias("database_name"),
        "l_shipdate",
    )
    return incremental.next_windows(
        incremental.prior_stop(past, *keys),
        incremental.high_water_mark(lineitem, "l_shipdate", *keys),
        *keys,
    )


@query(
    "window_stamp",
    f"""WITH {HISTORY_SQL}
    SELECT instance_name, database_name, check_name, run_id, check_mode,
           CASE WHEN check_mode = 'incremental' THEN run_start_timestamp - INTERVAL 24 HOUR END
               AS data_start_timestamp,
           CASE WHEN check_mode = 'incremental' THEN run_start_timestamp END AS data_stop_timestamp
    FROM history
    """,
)
def window_stamp(spark, sf_dir):
    begun = F.col("run_start_timestamp")
    stamped = incremental.stamp_window(
        history(spark, sf_dir), begun - F.make_dt_interval(hours=F.lit(24)), begun
    )
    return stamped.select(
        "instance_name",
        "database_name",
        "check_name",
        "run_id",
        "check_mode",
        "data_start_timestamp",
        "data_stop_timestamp",
    )
