"""Rules over registry rows: defaults, filter, validation, status.

Input is the flat form of :func:`tablewarden.sources.registry.parse_registry`.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablewarden.schema import (
    CHECK_CUSTOM_PREFIX,
    CHECK_TYPES,
    NO_COUNT,
    REGISTRY_FIELDS,
    REGISTRY_MODES,
    REGISTRY_SCOPES,
    REGULAR_TYPES,
    STAGE_TYPES,
    STATUSES,
)


class RegistryError(ValueError):
    """The registry is empty, invalid, or names checks that do not exist."""


def default_registry(registry: DataFrame) -> DataFrame:
    """Fill in what a registry may leave out.

    Type is rule and status active. A rule without mode is full and without scope
    looks at rows; for a setup check both stay empty. An explicit null for mode or
    scope is kept, and profiles and teardowns have no default for either: those
    are for the validation to find.
    """
    kind = F.col("check_type")

    def unless_given(field: str, value: str) -> Column:
        absent = ~F.array_contains("given", field)
        return F.when((kind == "rule") & absent, F.lit(value)).otherwise(F.col(field))

    known = F.when(
        kind == "setup",
        F.array_union("given", F.array(F.lit("check_mode"), F.lit("check_scope"))),
    ).otherwise(F.col("given"))
    return registry.withColumn("check_type", F.coalesce("check_type", F.lit("rule"))).withColumns(
        {
            "check_mode": unless_given("check_mode", "full"),
            "check_scope": unless_given("check_scope", "row"),
            "check_status": F.coalesce("check_status", F.lit("active")),
            "given": known,
        }
    )


def filter_registry(
    registry: DataFrame, table: str | None = None, check: str | None = None
) -> DataFrame:
    """Only the checks of one table, of one alias, or both.

    A filter by alias leaves out the table's setup checks unless they go by the
    same alias. Tables without any check left are gone. An empty registry is an
    error.
    """
    if registry.isEmpty():
        raise RegistryError("the registry is empty")
    if table is not None:
        registry = registry.where(F.col("table_name") == table)
    if check is not None:
        registry = registry.where(F.col("check_alias") == check)
    return registry


def _problem(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(text))


def with_problems(registry: DataFrame) -> DataFrame:
    """Add ``problems``, naming the fields of each check that break a rule."""
    kind = F.col("check_type")
    regular = F.coalesce(kind.isin(REGULAR_TYPES), F.lit(False))
    stage = F.coalesce(kind.isin(STAGE_TYPES), F.lit(False))
    odd = F.exists(F.map_keys("custom"), lambda k: ~k.startswith(CHECK_CUSTOM_PREFIX))
    problems = F.array_compact(
        F.array(
            _problem(~kind.isin(CHECK_TYPES), "check_type"),
            _problem(F.col("check_name").isNull(), "check_name"),
            _problem(~F.col("check_status").isin(STATUSES), "check_status"),
            F.when(regular, _problem(~F.col("check_mode").isin(REGISTRY_MODES), "check_mode")),
            F.when(regular, _problem(~F.col("check_scope").isin(REGISTRY_SCOPES), "check_scope")),
            F.when(stage, _problem(~F.array_contains("given", "check_mode"), "check_mode")),
            F.when(
                stage,
                _problem(
                    F.col("check_scope").isNotNull() | ~F.array_contains("given", "check_scope"),
                    "check_scope",
                ),
            ),
            _problem(odd, "custom"),
            _problem(F.size(F.array_distinct("given")) < F.size("given"), "repeated"),
        )
    )
    return registry.withColumn("problems", problems)


def registry_problems(registry: DataFrame) -> DataFrame:
    """The registry checks that break a rule, with ``problems`` listing them."""
    return with_problems(registry).where(F.size("problems") > 0)


def unknown_checks(registry: DataFrame, known: Collection[str]) -> DataFrame:
    """Registry checks no check body exists for.

    The known names are those of this process's catalogue: a literal list, so the
    anti join is a hash lookup while reading the registry.
    """
    return registry.where(
        F.col("check_name").isNull() | ~F.col("check_name").isin(sorted(known))
    )


def valid_entries(registry: DataFrame, known: Collection[str]) -> list[Row]:
    """The registry read to the driver, by table and alias; raises if it must not run.

    A registry is configuration: a row per check, never per inspected row. It must
    not be empty, break rules, name a check of a table twice, or name checks that
    do not exist.
    """
    entries = with_problems(default_registry(registry)).collect()
    if not entries:
        raise RegistryError("the registry is empty")
    entries.sort(key=lambda e: (e.table_name, e.check_alias))
    faults = []
    for before, e in zip([None, *entries], entries):
        name = f"{e.table_name}.{e.check_alias}"
        if e.problems:
            faults.append(f"{name}: {', '.join(e.problems)}")
        elif e.check_name not in known:
            faults.append(f"{name}: no check {e.check_name}")
        if before and (before.table_name, before.check_alias) == (e.table_name, e.check_alias):
            faults.append(f"{name}: named twice")
    if faults:
        raise RegistryError("; ".join(faults))
    return entries


def active_checks(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("check_status") == "active")


def inactive_rows(registry: DataFrame) -> DataFrame:
    """Placeholder results of inactive checks; inactive setups leave none."""
    return registry.where(
        (F.col("check_status") == "inactive") & ~F.col("check_type").isin(STAGE_TYPES)
    ).withColumns(
        {
            "violations": F.lit(NO_COUNT).cast("bigint"),
            "check_rc": F.lit(NO_COUNT),
            "mode": F.lit("full"),
        }
    )


def bypass_tables(registry: DataFrame, setups: DataFrame) -> DataFrame:
    """Regular checks of tables whose setup did not declare them inactive.

    ``setups`` has ``table_name`` and ``table_status`` per setup check.
    """
    off = setups.where(F.col("table_status") == "inactive").select("table_name").distinct()
    regular = registry.where(~F.col("check_type").isin(STAGE_TYPES))
    return regular.join(off, "table_name", "left_anti")


__all__ = [
    "REGISTRY_FIELDS",
    "RegistryError",
    "active_checks",
    "bypass_tables",
    "default_registry",
    "filter_registry",
    "inactive_rows",
    "registry_problems",
    "unknown_checks",
    "valid_entries",
    "with_problems",
]
