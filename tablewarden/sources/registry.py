"""The registry: which checks apply to which table.

A registry document maps table -> check alias -> properties, all of them text::

    {"shipments": {"weight_limit": {"check_name": "range", "check_mode": "incremental",
                                    "hapinsp_checkcustom_col": "weight_kg",
                                    "hapinsp_checkcustom_max": "900"}}}
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.json_text import strict_object
from tablewarden.schema import REGISTRY_FIELDS, REGISTRY_JSON


def parse_registry(docs: DataFrame, doc: str = "value") -> DataFrame:
    """One row per table and check alias of every registry document.

    Columns: ``table_name``, ``check_alias``, the five fields, ``given`` (the
    property names present: an explicit null is not the same as leaving a field
    out) and ``custom`` (all other properties). Text that is not one JSON object
    of that shape fails the job.
    """
    text = F.col(doc)
    invalid = F.raise_error(F.concat(F.lit("invalid registry: "), F.substring(text, 1, 200)))
    others = [c for c in docs.columns if c != doc]
    tables = docs.select(
        *others,
        F.explode(F.coalesce(strict_object(text, REGISTRY_JSON), invalid.cast(REGISTRY_JSON))).alias(
            "table_name", "_checks"
        ),
    )
    checks = tables.select(
        *others, "table_name", F.explode(F.col("_checks")).alias("check_alias", "_props")
    )
    props = F.col("_props")
    return checks.select(
        *others,
        "table_name",
        "check_alias",
        *[props[f].alias(f) for f in REGISTRY_FIELDS],
        F.map_keys(props).alias("given"),
        F.map_filter(props, lambda k, _: ~k.isin(REGISTRY_FIELDS)).alias("custom"),
    )


def read_registry(spark: SparkSession, *paths: str, one_per_line: bool = False) -> DataFrame:
    """Registry files, each one document, or one document per line."""
    docs = spark.read.text(list(paths), wholetext=not one_per_line)
    return parse_registry(docs)
