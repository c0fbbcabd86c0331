"""Roll-ups of the results history along instance, database, table and check.

Every function answers for all entities of a level at once; pick a branch with
:func:`drill_down` first. Setup and teardown rows are no violations and left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.scoring import clean_name, pass_label
from tablewarden.schema import LEVELS, STAGE_TYPES

LAST_MONTH_POINTS = 32
LAST_WEEK_POINTS = 8


def path_to(level: str) -> list[str]:
    """The level's column and those above it: an entity is known by its whole path."""
    return LEVELS[: LEVELS.index(level) + 1]


def is_regular() -> Column:
    """Rows that count: all but setups and teardowns, told by type at every level, never by name."""
    return ~F.coalesce(F.col("check_type").isin(STAGE_TYPES), F.lit(False))


def violation_total(count: Column | str = "check_violation_cnt") -> Column:
    """Sum of known counts; -1 of older histories and NULL add nothing."""
    count = F.col(count) if isinstance(count, str) else count
    return F.coalesce(F.sum(F.when(count >= 0, count)), F.lit(0).cast("bigint"))


def drill_down(
    results: DataFrame,
    instance: str | None = None,
    database: str | None = None,
    table: str | None = None,
    check: str | None = None,
) -> DataFrame:
    """The branch of the hierarchy below the given names."""
    for column, name in zip(LEVELS, (instance, database, table, check)):
        if name is not None:
            results = results.where(F.col(column) == name)
    return results


def entities(results: DataFrame, level: str) -> DataFrame:
    """Distinct entities of a level, with ``clean_name``; checks without setups."""
    if level == "check_name":
        results = results.where(is_regular())
    keys = path_to(level)
    return results.select(*keys).distinct().withColumn("clean_name", clean_name(F.col(level)))


def search(results: DataFrame, level: str, text: str = "") -> DataFrame:
    """Entities whose name contains the text; ``%`` and ``_`` are wildcards, case is ignored."""
    found = entities(results, level)
    if text:
        found = found.where(F.col(level).ilike(f"%{text}%"))
    return found


def period_of(unit: str, ts: str = "run_start_timestamp") -> Column:
    """The day, or the first day of the month; dates, so no time zone comes in."""
    if unit not in ("day", "month"):
        raise ValueError(f"unknown period: {unit}")
    day = F.to_date(ts)
    return (day if unit == "day" else F.trunc(day, "month")).alias("period")


def _series(results: DataFrame, level: str, unit: str) -> DataFrame:
    period = period_of(unit)
    return (
        results.where(is_regular())
        .groupBy(*path_to(level), period)
        .agg(violation_total().alias("violations"))
    )


def monthly(results: DataFrame, level: str) -> DataFrame:
    """Violations per entity and month; ``period`` is the first of the month."""
    return _series(results, level, "month")


def daily(results: DataFrame, level: str) -> DataFrame:
    """Violations per entity and day."""
    return _series(results, level, "day")


def in_series_order(series: DataFrame, level: str) -> DataFrame:
    return series.orderBy(*path_to(level), "period")


def last_points(series: DataFrame, level: str, n: int) -> DataFrame:
    """The latest ``n`` points each entity has, however far apart they are.

    Works on a series: an entity has one row per period, and Spark keeps only the
    top ``n`` of each before shuffling.
    """
    newest = Window.partitionBy(*path_to(level)).orderBy(F.col("period").desc())
    ranked = series.withColumn("_rank", F.row_number().over(newest))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def series_lengths(results: DataFrame, level: str) -> DataFrame:
    """Number of points of the year, month and week series per entity, 0 without runs."""
    days = results.groupBy(*path_to(level), period_of("day").alias("day")).agg(
        F.count_if(is_regular()).alias("n")
    )
    counted = F.col("n") > 0
    points = F.count_if(counted)
    return days.groupBy(*path_to(level)).agg(
        F.count_distinct(F.when(counted, F.trunc("day", "month"))).alias("year_points"),
        F.least(points, F.lit(LAST_MONTH_POINTS)).cast("bigint").alias("month_points"),
        F.least(points, F.lit(LAST_WEEK_POINTS)).cast("bigint").alias("week_points"),
    )


def _place(ts: str, run_id: str) -> Column:
    """Moment and run as one number, in their order and without any time zone."""
    day = F.unix_date(F.to_date(ts)).cast("decimal(12,0)")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECONDS"), F.col(ts))
    micros = day * 86_400_000_000 + (seconds * 1_000_000).cast("decimal(12,0)")
    wide = micros.cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
    return (wide + F.coalesce(run_id, F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _latest_rows(results: DataFrame) -> DataFrame:
    """The latest regular row of each check: ``run_start_timestamp``, ``violations``, NULL for setups.

    Start and run id make one number to compare by, so the whole history goes through a hash
    aggregation of plain numbers; what is left is a row per check.
    """
    regular = is_regular()
    when_run = F.when(regular, _place("run_start_timestamp", "run_id"))
    return results.groupBy(*LEVELS).agg(
        F.max(F.when(regular, F.col("run_start_timestamp"))).alias("run_start_timestamp"),
        F.max_by("check_violation_cnt", when_run).alias("violations"),
        F.max(regular).alias("_regular"),
    )


def current_status(results: DataFrame, *levels: str) -> DataFrame:
    """The latest count of each entity and whether it passes, for the given levels at once.

    Columns: the four levels (NULL below an entity's own), ``level``, ``run_start_timestamp``,
    ``violations``, ``status``. Rows of the same start are told apart by their path, the last one
    counts. An entity without any regular row has 0 violations; a setup is no check, so at check
    level there is none for it. The history is read once; the levels are made of its latest rows.
    """
    levels = levels or tuple(LEVELS)
    latest = _latest_rows(results)
    each = latest.withColumn("level", F.explode(F.array(*[F.lit(level) for level in levels])))
    each = each.where((F.col("level") != LEVELS[-1]) | F.col("_regular"))
    path = [
        F.when(F.array_contains(F.array(*[F.lit(x) for x in LEVELS[i:]]), F.col("level")), F.col(c)).alias(f"_{c}")
        for i, c in enumerate(LEVELS)
    ]
    keyed = each.select("*", *path)
    newest = Window.partitionBy("level", *[f"_{c}" for c in LEVELS]).orderBy(
        F.col("_regular").desc(), F.col("run_start_timestamp").desc_nulls_last(), *[F.col(c).desc() for c in LEVELS[1:]]
    )
    first = keyed.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    count = F.when(F.col("_regular"), F.col("violations")).otherwise(F.lit(0).cast("bigint"))
    return first.select(
        *[F.col(f"_{c}").alias(c) for c in LEVELS], "level", "run_start_timestamp", count.alias("violations")
    ).withColumn("status", pass_label(F.col("violations")))


def rollup_levels(results: DataFrame, unit: str = "month") -> DataFrame:
    """The series of all four levels in one pass; ``level`` names each row's level.

    The history is summed per check and period first, so the four copies made by
    the grouping sets are of that much smaller table.
    """
    base = results.where(is_regular()).groupBy(*LEVELS, period_of(unit))
    return rolled_up(base.agg(violation_total().alias("violations")))


def rolled_up(checks: DataFrame) -> DataFrame:
    """The series of all levels, from ``violations`` per check and ``period``."""
    sets = [[F.col(c) for c in [*path_to(level), "period"]] for level in LEVELS]
    level = F.lit(LEVELS[0])
    for name in LEVELS[1:]:
        level = F.when(F.grouping(name) == 0, F.lit(name)).otherwise(level)
    return checks.groupingSets(sets, *LEVELS, "period").agg(
        F.sum("violations").alias("violations"), level.alias("level")
    )


def run_history(
    results: DataFrame, instance: str, database: str, table: str, check: str
) -> DataFrame:
    """The runs of one check."""
    return drill_down(results, instance, database, table, check).select(
        "check_type",
        "check_mode",
        "check_unit",
        "check_status",
        "run_id",
        "run_start_timestamp",
        "run_stop_timestamp",
    )


def check_series(
    results: DataFrame, instance: str, database: str, table: str, check: str, unit: str = "day"
) -> DataFrame:
    """Violations of one check per day or month, setup checks included if asked for."""
    branch = drill_down(results, instance, database, table, check)
    return branch.groupBy(period_of(unit)).agg(violation_total().alias("violations")).orderBy("period")


def tables_affected(
    results: DataFrame, instance: str, database: str, table: str, check: str
) -> DataFrame:
    return drill_down(results, instance, database, table, check).select("table_name").distinct()


def max_rc(results: DataFrame) -> DataFrame:
    """The status of a run: its largest return code, at least 0."""
    worst = F.greatest(F.lit(0), F.coalesce(F.max("check_rc"), F.lit(0)))
    return results.agg(worst.alias("max_rc"))
