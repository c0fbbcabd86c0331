"""Histories, registries and outputs that Spark derives from the test tables.

Nothing of the kind is supplied, so both engines derive one. All of it grows with
the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.schema import (
    CHECK_CUSTOM_PREFIX,
    RESULT_SCHEMA,
    TABLE_CUSTOM_PREFIX,
)
from tablewarden.session import shared_folder
from tablewarden.sources.tables import read_table

DAY_VAR = f"{TABLE_CUSTOM_PREFIX}day"

# Every ship day was inspected at 02:00: line status is the instance, return flag
# the database. Two rules ran per day, after a setup check that left the day behind.
HISTORY_SQL = f"""
    days AS (
        SELECT l_linestatus AS instance_name, l_returnflag AS database_name,
               CAST(l_shipdate AS DATE) AS d,
               count(*) FILTER (WHERE l_tax > 0.07) AS tax_bad,
               count(*) FILTER (WHERE l_quantity > 45) AS qty_bad
        FROM lineitem GROUP BY 1, 2, 3),
    checks AS (
        SELECT *, 'tax_range_ck' AS check_name, 'rule' AS check_type, tax_bad AS v FROM days
        UNION ALL SELECT *, 'qty_range_ck', 'rule', qty_bad FROM days
        UNION ALL SELECT *, 'setup_day', 'setup', NULL FROM days),
    history AS (
        SELECT instance_name, database_name, 'lineitem' AS table_name, check_name, check_type,
               'quality' AS check_policy_type,
               CASE WHEN check_type = 'setup' THEN 'auto'
                    WHEN check_name = 'tax_range_ck' THEN 'incremental' ELSE 'full' END
                   AS check_mode,
               'rows' AS check_unit, 'active' AS check_status,
               CAST(strftime(d, '%Y%m%d') AS BIGINT) AS run_id,
               CAST(d AS TIMESTAMP) + INTERVAL 2 HOUR AS run_start_timestamp,
               CAST(d AS TIMESTAMP) + INTERVAL 3 HOUR AS run_stop_timestamp,
               CASE WHEN check_name = 'tax_range_ck' THEN CAST(d AS TIMESTAMP) - INTERVAL 1 DAY END
                   AS data_start_timestamp,
               CASE WHEN check_name = 'tax_range_ck' THEN CAST(d AS TIMESTAMP) END
                   AS data_stop_timestamp,
               CASE WHEN v > 3 THEN 4 ELSE 0 END AS check_rc,
               v AS check_violation_cnt,
               CASE WHEN check_type = 'setup' THEN strftime(d, '%Y-%m-%d') END AS day_var
        FROM checks)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregation of ``lineitem``; the three rows per day are unfolded after it."""
    lineitem = read_table(spark, "lineitem", directory=sf_dir)
    days = lineitem.groupBy(
        F.col("l_linestatus").alias("instance_name"),
        F.col("l_returnflag").alias("database_name"),
        F.to_date("l_shipdate").alias("d"),
    ).agg(
        F.count_if(F.col("l_tax") > 0.07).alias("tax_bad"),
        F.count_if(F.col("l_quantity") > 45).alias("qty_bad"),
    )

    def check(name: str, kind: str, mode: str, count) -> F.Column:
        return F.struct(
            F.lit(name).alias("check_name"),
            F.lit(kind).alias("check_type"),
            F.lit(mode).alias("check_mode"),
            count.cast("bigint").alias("check_violation_cnt"),
        )

    checks = F.array(
        check("tax_range_ck", "rule", "incremental", F.col("tax_bad")),
        check("qty_range_ck", "rule", "full", F.col("qty_bad")),
        check("setup_day", "setup", "auto", F.lit(None)),
    )
    rows = days.select("instance_name", "database_name", "d", F.inline(checks))
    day = F.col("d").cast("timestamp_ntz")
    windowed = F.col("check_name") == "tax_range_ck"
    hours = lambda n: F.make_dt_interval(hours=F.lit(n))
    day_var = F.create_map(F.lit(DAY_VAR), F.date_format("d", "yyyy-MM-dd"))
    return rows.withColumns(
        {
            "table_name": F.lit("lineitem"),
            "check_policy_type": F.lit("quality"),
            "check_unit": F.lit("rows"),
            "check_status": F.lit("active"),
            "run_id": F.date_format("d", "yyyyMMdd").cast("bigint"),
            "run_start_timestamp": day + hours(2),
            "run_stop_timestamp": day + hours(3),
            "data_start_timestamp": F.when(windowed, day - hours(24)),
            "data_stop_timestamp": F.when(windowed, day),
            "check_rc": F.when(F.col("check_violation_cnt") > 3, F.lit(4)).otherwise(F.lit(0)),
            "check_scope": F.lit(-1.0),
            "check_severity_score": F.lit(-1),
            "env_vars": F.when(F.col("check_type") == "setup", day_var),
        }
    ).select(*RESULT_SCHEMA.fieldNames())


# Every part has its own registry document of a rule or a setup on its size and a
# price check, written in five ways depending on the size.
SIZE_CASES_SQL = """
    CASE WHEN p_size <= 10 THEN 'bare' WHEN p_size <= 20 THEN 'fullish'
         WHEN p_size <= 30 THEN 'setup' WHEN p_size <= 40 THEN 'profile' ELSE 'rule' END"""

REGISTRY_SQL = f"""
    cases AS (SELECT *, {SIZE_CASES_SQL} AS k FROM part),
    reg AS (
        SELECT 'part_' || p_partkey AS table_name, 'size_ck' AS check_alias,
               CASE k WHEN 'bare' THEN NULL WHEN 'fullish' THEN 'rule' ELSE k END AS check_type,
               'range' AS check_name,
               CASE k WHEN 'fullish' THEN 'fullish' WHEN 'rule' THEN 'incremental' END
                   AS check_mode,
               CASE k WHEN 'setup' THEN 'row' WHEN 'rule' THEN 'table' END AS check_scope,
               CASE k WHEN 'profile' THEN 'inactive' WHEN 'rule' THEN 'active' END
                   AS check_status,
               CASE k WHEN 'bare' THEN 'check_name'
                      WHEN 'fullish' THEN 'check_mode,check_name,check_type'
                      WHEN 'setup' THEN 'check_mode,check_name,check_scope,check_type'
                      WHEN 'profile' THEN 'check_name,check_status,check_type'
                      ELSE 'check_mode,check_name,check_scope,check_status,check_type' END
                   AS given_fields,
               CASE WHEN k = 'rule' THEN 'note=' || p_brand
                    ELSE '{CHECK_CUSTOM_PREFIX}max=' || p_size END AS custom_vars
        FROM cases
        UNION ALL
        SELECT 'part_' || p_partkey, 'price_ck', NULL,
               CASE WHEN p_type = 'ECONOMY' THEN 'price_rule' ELSE 'enum' END, NULL, NULL,
               CASE WHEN p_type = 'PROMO' THEN 'inactive' END,
               CASE WHEN p_type = 'PROMO' THEN 'check_name,check_status' ELSE 'check_name' END, ''
        FROM cases)"""


def registry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, "part", directory=sf_dir)
    size = F.col("p_size")
    top = f'"{CHECK_CUSTOM_PREFIX}max": '
    props = (
        F.when(size <= 10, F.format_string('{"check_name": "range", ' + top + "%d}", size))
        .when(
            size <= 20,
            F.format_string(
                '{"check_type": "rule", "check_name": "range", "check_mode": "fullish", '
                + top
                + "%d}",
                size,
            ),
        )
        .when(
            size <= 30,
            F.format_string(
                '{"check_type": "setup", "check_name": "range", "check_mode": null, '
                '"check_scope": "row", ' + top + "%d}",
                size,
            ),
        )
        .when(
            size <= 40,
            F.format_string(
                '{"check_type": "profile", "check_name": "range", "check_status": "inactive", '
                + top
                + "%d}",
                size,
            ),
        )
        .otherwise(
            F.format_string(
                '{"check_type": "rule", "check_name": "range", "check_mode": "incremental", '
                '"check_scope": "table", "check_status": "active", "note": "%s"}',
                F.col("p_brand"),
            )
        )
    )
    kind = F.col("p_type")
    price = F.format_string(
        '{"check_name": "%s"%s}',
        F.when(kind == "ECONOMY", F.lit("price_rule")).otherwise(F.lit("enum")),
        F.when(kind == "PROMO", F.lit(', "check_status": "inactive"')).otherwise(F.lit("")),
    )
    doc = F.format_string(
        '{"part_%d": {"size_ck": %s, "price_ck": %s}}', F.col("p_partkey"), props, price
    )
    return part.select(doc.alias("value"))


def written_lines(spark: SparkSession, docs: DataFrame, name: str = "lines") -> str:
    """Write one document per line into the shared folder; returns the path."""
    path = f"{shared_folder(spark)}/{name}"
    docs.write.text(path)
    return path


# An instance configuration per part: partitioned or not, whole-table or row checks.
def config_docs(spark: SparkSession, sf_dir: str, above: int = 0) -> DataFrame:
    part = read_table(spark, "part", directory=sf_dir).where(F.col("p_size") > above)
    doc = F.to_json(
        F.create_map(
            F.format_string("part_%d", "p_partkey"),
            F.struct(
                F.col("p_size").cast("double").alias("partition_row_cnt_avg"),
                F.when(F.col("p_size") > 25, F.lit("date_id")).alias("partition_key"),
                F.when(F.col("p_type") == "PROMO", F.lit("full"))
                .otherwise(F.lit("incremental"))
                .alias("mode"),
                F.array(F.lit("p_partkey"), F.lit("p_size")).alias("cols"),
                F.create_map(
                    F.lit("qty_ck"),
                    F.struct(
                        F.lit("rows").alias("violation_unit"),
                        F.lit("rule").alias("check_type"),
                        F.when(F.col("p_type") == "ECONOMY", F.lit("low"))
                        .when(F.col("p_type") == "PROMO", F.lit("medium"))
                        .otherwise(F.lit("high"))
                        .alias("severity"),
                        F.lit("quality").alias("policy_type"),
                        F.lit("incremental").alias("mode"),
                    ),
                    F.lit("tax_ck"),
                    F.struct(
                        F.lit("tables").alias("violation_unit"),
                        F.lit("rule").alias("check_type"),
                        F.when(F.col("p_type") == "SMALL", F.lit(None).cast("string"))
                        .otherwise(F.lit("high"))
                        .alias("severity"),
                        F.lit("consistency").alias("policy_type"),
                        F.lit("full").alias("mode"),
                    ),
                ).alias("checks"),
            ),
        )
    )
    return part.select(doc.alias("value"))
