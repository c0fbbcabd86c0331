"""Instance configurations: row estimates of tables, severities of their checks.

A file is named ``instance-<instance>_db-<database>_config.json``; that is where its tables belong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.json_text import strict_object

CONFIG_JSON = """map<string,struct<
    partition_row_cnt_avg:double, partition_key:string, mode:string, cols:array<string>,
    checks:map<string,struct<violation_unit:string, check_type:string, severity:string,
                             policy_type:string, mode:string, failure_rate:double>>>>"""


#: Fixed value: how the files of instances and databases are named.
CONFIG_FILE = r"instance-([^/]+)_db-([^/]+)_config\.json(?:/[^/]*)?$"


def parse_config(docs: DataFrame, doc: str = "value") -> tuple[DataFrame, DataFrame]:
    """The table dimension and the check dimension of configuration documents.

    Other columns of ``docs``, such as the instance and database a document is for, stay.
    """
    others = [c for c in docs.columns if c != doc]
    invalid = F.raise_error(F.lit("invalid instance configuration")).cast(CONFIG_JSON)
    parsed = F.coalesce(strict_object(F.col(doc), CONFIG_JSON), invalid)
    tables = docs.select(*others, F.explode(parsed).alias("table_name", "t"))
    dim_table = tables.select(
        *others,
        "table_name",
        F.col("t.partition_row_cnt_avg").alias("avg_rows"),
        F.col("t.partition_key").alias("partition_key"),
        F.col("t.mode").alias("table_mode"),
        F.col("t.cols").alias("cols"),
    )
    dim_check = tables.select(
        *others, "table_name", F.explode("t.checks").alias("check_name", "c")
    ).select(
        *others,
        "table_name",
        "check_name",
        F.col("c.violation_unit").alias("violation_unit"),
        F.col("c.check_type").alias("config_check_type"),
        F.col("c.severity").alias("severity"),
        F.col("c.policy_type").alias("policy_type"),
        F.col("c.mode").alias("config_mode"),
        F.col("c.failure_rate").alias("failure_rate"),
    )
    return dim_table, dim_check


def read_config(
    spark: SparkSession, *paths: str, one_per_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Configuration files, each one document, or one document per line.

    ``instance_name`` and ``database_name`` are told by the name of the file, or of a folder of
    such files; NULL for other names.
    """
    docs = spark.read.text(list(paths), wholetext=not one_per_line)
    name = F.col("_metadata.file_path")
    place = {c: F.nullif(F.regexp_extract(name, CONFIG_FILE, i), F.lit("")) for i, c in ((1, "instance_name"), (2, "database_name"))}
    return parse_config(docs.select("value", *[v.alias(c) for c, v in place.items()]))
