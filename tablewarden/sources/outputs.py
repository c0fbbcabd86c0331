"""Outputs of checks that ran elsewhere: one JSON record per executed check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OUTPUT_SCHEMA = "table_name string, check_alias string, raw_output string, check_rc int"


def read_outputs(spark: SparkSession, *paths: str) -> DataFrame:
    """Batches of outputs, a record per line: names, process return code, and the raw text.

    The text is left as it is, to be judged by the parsers of
    :mod:`tablewarden.functions.outputs`.
    """
    return spark.read.schema(OUTPUT_SCHEMA).json(list(paths))
