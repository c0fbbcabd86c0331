"""Profiles, anomalies, freshness of profiles, and the files of tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspections import query
from tablewarden.operators import policy
from tablewarden.operators.fused import count_bad_rows
from tablewarden.operators.statistics import (
    outliers,
    profile,
    profile_exact,
    stats_missing,
    stats_stale,
)
from tablewarden.sources.tables import list_files, read_table

_OUTLIER_CASES = [
    ("event_value", "events", "value", 2.0),
    ("order_price", "orders", "o_totalprice", 1.5),
    ("customer_balance", "customer", "c_acctbal", 1.7),
]


@query(
    "ck_outlier",
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS check_alias, count(*) AS violations FROM {t} "
        f"WHERE abs({c} - (SELECT avg({c}) FROM {t})) > {k} * (SELECT stddev_samp({c}) FROM {t})"
        for a, t, c, k in _OUTLIER_CASES
    ),
)
def ck_outlier(spark, sf_dir):
    parts = []
    for alias, table, column, deviations in _OUTLIER_CASES:
        df = read_table(spark, table, directory=sf_dir)
        bad = count_bad_rows(df, outliers(df, column, deviations))
        parts.append(bad.select(F.lit(alias).alias("check_alias"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    rows = []
    for c, kind in columns.items():
        average = f"round(avg({c}), 4)" if kind == "number" else "CAST(NULL AS DOUBLE)"
        rows.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
            f"count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, "
            f"CAST(max({c}) AS VARCHAR) AS max_value, {average} AS avg_value FROM {table}"
        )
    return "\nUNION ALL\n".join(rows)


# Every column of three tables: those with an average, and the others.
_PROFILES = {
    table: dict.fromkeys(numbers.split(), "number") | dict.fromkeys(others.split(), "other")
    for table, numbers, others in [
        ("orders", "o_orderkey o_custkey o_totalprice", "o_orderstatus o_orderdate o_orderpriority"),
        (
            "lineitem",
            "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
            "l_returnflag l_linestatus l_shipdate",
        ),
        ("customer", "c_custkey c_nationkey c_acctbal", "c_name c_mktsegment"),
    ]
}


@query(
    "profile_table",
    "\nUNION ALL\n".join(_profile_sql(t, columns) for t, columns in _PROFILES.items()),
)
def profile_table(spark, sf_dir):
    parts = [
        profile_exact(read_table(spark, t, directory=sf_dir)).withColumn("table_name", F.lit(t))
        for t in _PROFILES
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("avg_value", F.round("avg_value", 4))


@query(
    "profile_table_one_scan",
    "\nUNION ALL\n".join(
        f"SELECT table_name, column_name, n_rows, n_null, true AS distinct_is_close, min_value, "
        f"max_value, avg_value FROM ({_profile_sql(t, columns)})"
        for t, columns in _PROFILES.items()
    ),
)
def profile_table_one_scan(spark, sf_dir):
    """The sketch's distinct count is compared with the exact one, within 15 %."""
    parts = []
    for t in _PROFILES:
        df = read_table(spark, t, directory=sf_dir)
        exact = profile_exact(df).select("column_name", F.col("n_distinct").alias("exact"))
        parts.append(profile(df).join(exact, "column_name").withColumn("table_name", F.lit(t)))
    every = reduce(DataFrame.unionByName, parts)
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.15 * F.col("exact")
    return every.select(
        "table_name",
        "column_name",
        "n_rows",
        "n_null",
        close.alias("distinct_is_close"),
        "min_value",
        "max_value",
        F.round("avg_value", 4).alias("avg_value"),
    )


# Each event type stands for a table, each event for a profile taken of it. Tables
# are expected under the names of event types and of market segments.
def _profiles(spark, sf_dir):
    return read_table(spark, "events", directory=sf_dir).select(
        F.col("event_type").alias("table_name"), F.col("ts").alias("run_start_timestamp")
    )


@query(
    "ck_stats_exist",
    """
    SELECT table_name, CAST(1 AS BIGINT) AS violations FROM (
        SELECT event_type AS table_name FROM events
        UNION SELECT lower(c_mktsegment) FROM customer)
    WHERE table_name NOT IN (SELECT event_type FROM events WHERE value >= 2)
    """,
)
def ck_stats_exist(spark, sf_dir):
    events = read_table(spark, "events", directory=sf_dir)
    customer = read_table(spark, "customer", directory=sf_dir)
    expected = (
        events.select(F.col("event_type").alias("table_name"))
        .unionByName(customer.select(F.lower("c_mktsegment").alias("table_name")))
        .distinct()
    )
    profiles = events.where(F.col("value") >= 2).select(F.col("event_type").alias("table_name"))
    return stats_missing(expected, profiles).withColumn("violations", F.lit(1).cast("bigint"))


@query(
    "ck_stats_stale",
    """
    SELECT event_type AS table_name, max(ts) AS newest FROM events GROUP BY event_type
    HAVING max(ts) < TIMESTAMP '2024-02-29 23:40:00' - INTERVAL 30 DAY
    """,
)
def ck_stats_stale(spark, sf_dir):
    return stats_stale(_profiles(spark, sf_dir), dt.datetime(2024, 2, 29, 23, 40), 30)


@query("ck_file_size")
def ck_file_size(spark, sf_dir):
    return policy.audit_files(
        list_files(spark, sf_dir),
        small=policy.too_small(64 * 1024),
        below_block=policy.too_small(128 * 1024 * 1024),
    )


@query("ck_file_format")
def ck_file_format(spark, sf_dir):
    return policy.audit_files(
        list_files(spark, sf_dir),
        parquet_only=policy.wrong_extension("parquet"),
        orc_only=policy.wrong_extension("orc"),
    )
