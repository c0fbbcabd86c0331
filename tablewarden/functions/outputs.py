"""The output contract of checks: one JSON object per executed check.

Bad output never raises: it becomes a row with its own return code, so one
broken check cannot lose the results of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.json_text import strict_object, strict_struct
from tablewarden.functions.validators import iso_timestamp, whole_number
from tablewarden.functions.variables import last_wins, no_vars
from tablewarden.schema import (
    CHECK_OUTPUT_KEYS,
    NO_COUNT,
    RC_BAD_CHECK_OUTPUT,
    RC_BAD_SETUP_OUTPUT,
    SETUP_DEPRECATED_KEYS,
    SETUP_OUTPUT_KEYS,
    TABLE_CUSTOM_PREFIX,
    VAR_PREFIX,
)


def _with_object(outputs: DataFrame, raw: str) -> DataFrame:
    """Add ``_doc``: ``map<string,string>`` of the JSON object, NULL for other text."""
    parsed = outputs.withColumn("_doc", strict_object(F.col(raw), "map<string,string>"))
    return parsed.withColumn("_doc", last_wins(F.col("_doc")))


def _has_other_keys(doc: Column, known: list[str], prefix: str) -> Column:
    return F.exists(F.map_keys(doc), lambda k: ~(k.isin(known) | k.startswith(prefix)))


def parse_check_outputs(
    outputs: DataFrame, raw: str = "raw_output", process_rc: str = "check_rc"
) -> DataFrame:
    """Add ``valid``, ``violations``, ``mode``, ``log``; replace the process rc by the combined rc.

    ``rc`` and ``violations`` are mandatory whole numbers, other keys have to carry
    the variable prefix. Anything else counts as failed: rc 202, -1 violations,
    no mode. The combined rc is the larger of the process's and the reported one.
    Only the known keys are parsed to values; of the others the names are enough.
    """
    fields = ", ".join(f"{k}:string" for k in CHECK_OUTPUT_KEYS)
    doc = F.col("_doc")
    rc = whole_number(doc["rc"], "int")
    count = whole_number(doc["violations"])
    foreign = F.exists(
        F.json_object_keys(raw), lambda k: ~(k.isin(CHECK_OUTPUT_KEYS) | k.startswith(VAR_PREFIX))
    )
    valid = F.coalesce(~foreign & rc.isNotNull() & count.isNotNull(), F.lit(False))
    return (
        outputs.withColumn("_doc", strict_struct(F.col(raw), f"struct<{fields}>"))
        .withColumn("valid", valid)
        .withColumns(
            {
                process_rc: F.when(F.col("valid"), F.greatest(F.col(process_rc), rc)).otherwise(
                    F.lit(RC_BAD_CHECK_OUTPUT)
                ),
                "violations": F.when(F.col("valid"), count).otherwise(
                    F.lit(NO_COUNT).cast("bigint")
                ),
                "mode": F.when(F.col("valid"), F.coalesce(doc["mode"], F.lit("full"))),
                "log": F.when(F.col("valid"), doc["log"]),
            }
        )
        .drop("_doc")
    )


def parse_setup_outputs(
    outputs: DataFrame, raw: str = "raw_output", process_rc: str = "check_rc"
) -> DataFrame:
    """Add ``valid``, ``table_status``, ``mode``, the data window and ``custom_vars``.

    The window is two ISO basic timestamps; two deprecated key names still work.
    Output that is missing, blank, no JSON object, without rc, with a foreign key
    or a bad timestamp is invalid: rc 201, no variables, no window.
    """
    doc = F.col("_doc")

    def given(key: str) -> Column:
        return F.nullif(doc[key], F.lit(""))

    def bound(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}_ts"), F.col(f"_{name}_timestamp"))

    def good_bound(name: str) -> Column:
        new, old = f"{name}_ts", f"{name}_timestamp"
        absent = given(f"data_{new}").isNull() | F.col(f"_{new}").isNotNull()
        return absent & (~F.map_contains_key(doc, f"data_{old}") | F.col(f"_{old}").isNotNull())

    bounds = {
        f"_{name}_{ending}": iso_timestamp(doc[f"data_{name}_{ending}"], "basic")
        for name in ("start", "stop")
        for ending in ("ts", "timestamp")
    }
    rc = whole_number(doc["rc"], "int")
    valid = F.coalesce(
        ~_has_other_keys(doc, SETUP_OUTPUT_KEYS + SETUP_DEPRECATED_KEYS, TABLE_CUSTOM_PREFIX)
        & rc.isNotNull()
        & good_bound("start")
        & good_bound("stop"),
        F.lit(False),
    )
    custom = F.map_filter(doc, lambda k, _: k.startswith(TABLE_CUSTOM_PREFIX))
    ok = F.col("valid")
    return (
        _with_object(outputs, raw)
        .withColumns(bounds)
        .withColumn("valid", valid)
        .withColumns(
            {
                process_rc: F.when(ok, F.greatest(F.col(process_rc), rc)).otherwise(
                    F.lit(RC_BAD_SETUP_OUTPUT)
                ),
                "table_status": F.coalesce(F.when(ok, given("table_status")), F.lit("active")),
                "mode": F.coalesce(F.when(ok, given("mode")), F.lit("auto")),
                "data_start_ts": F.when(ok, bound("start")),
                "data_stop_ts": F.when(ok, bound("stop")),
                "custom_vars": F.when(ok, custom).otherwise(no_vars()),
            }
        )
        .drop("_doc", *bounds)
    )
