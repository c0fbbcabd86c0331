"""Variables and data windows carried from one run to the next."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.moments import moment
from tablewarden.functions.variables import as_prior
from tablewarden.schema import LEVELS


def prior_vars(history: DataFrame, check_type: str | None = "setup") -> DataFrame:
    """What the latest successful run of each check left behind, for all checks at once.

    Columns: the four levels, ``run_start_timestamp``, ``env_vars`` as saved, and
    ``prior_vars`` with the names the next run sees. Runs with the same start are
    told apart by their id. A run that failed leaves nothing, so the one before it
    still counts.
    """
    rows = history.where(F.col("check_rc") == 0)
    if check_type is not None:
        rows = rows.where(F.col("check_type") == check_type)
    latest = F.max_by(
        F.struct("run_start_timestamp", "env_vars"), F.struct("run_start_timestamp", "run_id")
    )
    return (
        rows.groupBy(*LEVELS)
        .agg(latest.alias("_last"))
        .select(*LEVELS, "_last.run_start_timestamp", "_last.env_vars")
        .withColumn("prior_vars", as_prior(F.col("env_vars")))
    )


def prior_stop(history: DataFrame, *keys: str) -> DataFrame:
    """Where the data windows of earlier runs ended: ``prior_stop`` per key."""
    return history.groupBy(*keys).agg(F.max("data_stop_timestamp").alias("prior_stop"))


def high_water_mark(df: DataFrame, ts: str, *keys: str) -> DataFrame:
    """The latest moment in the data: ``data_stop`` per key, or of the whole table."""
    return df.groupBy(*keys).agg(F.max(ts).cast("timestamp_ntz").alias("data_stop"))


def next_windows(stops: DataFrame, marks: DataFrame, *keys: str) -> DataFrame:
    """The window each table is inspected in next: after the last one, up to the mark.

    Both inputs are one row per key. Without an earlier run ``data_start`` is
    NULL: the check then sees the whole table.
    """
    return marks.join(stops, list(keys), "left").select(
        *keys, F.col("prior_stop").alias("data_start"), "data_stop"
    )


#: How whole numbers write a day: strftime forms by the name a setup gives them.
DAY_FORMS = {"yyyyDDD": "%Y%j", "yyyyMMdd": "%Y%m%d"}


def day_of(number: Column, form: str) -> Column:
    """The day that a whole number such as 2024032 or 20240201 stands for."""
    if form == "yyyyDDD":
        first = F.make_date((number / 1000).cast("int"), F.lit(1), F.lit(1))
        return F.date_add(first, (number % 1000 - 1).cast("int"))
    if form == "yyyyMMdd":
        return F.make_date((number / 10000).cast("int"), (number / 100 % 100).cast("int"), (number % 100).cast("int"))
    raise ValueError(f"unknown form of a day: {form}")


def moment_of(df: DataFrame, column: str, value: Column, form: str = "yyyyDDD") -> Column:
    """A value of a window column as a moment: timestamps, dates, and numbers that write a day."""
    kind = df.schema[column].dataType
    return (day_of(value, form) if isinstance(kind, T.IntegralType) else value).cast("timestamp_ntz")


def bound(df: DataFrame, column: str, at: dt.datetime, form: str = "yyyyDDD") -> Column:
    """A moment as a literal of the column's own type, which file statistics and partitions can answer."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.lit(int(at.strftime(DAY_FORMS[form])))
    if isinstance(kind, T.DateType):
        return F.lit(at.date())
    return moment(at)


def in_window(
    ts: Column | str,
    start: Column | dt.datetime | None,
    stop: Column | dt.datetime | None,
    df: DataFrame | None = None,
    form: str = "yyyyDDD",
) -> Column:
    """The half-open window ``(start, stop]``; a missing bound is open.

    Bounds given as values are plain comparisons of the column with a literal,
    which prune partitions and skip Parquet row groups. With ``df`` the literals
    take the type of its column ``ts``.
    """
    name = ts
    literal = moment if df is None else lambda at: bound(df, name, at, form)
    ts = F.col(ts) if isinstance(ts, str) else ts

    within = F.lit(True)
    if start is not None:
        within = ts > literal(start)
    if stop is not None:
        upper = ts <= literal(stop)
        within = upper if start is None else within & upper
    return within


def on_days(df: DataFrame, column: str, days: Sequence[dt.date], form: str = "yyyyDDD") -> Column:
    """Rows of the given days, as ranges of the column's own type: neighbouring days are one range."""
    runs: list[list[dt.date]] = []
    for day in sorted(set(days)):
        if runs and day - runs[-1][1] == dt.timedelta(days=1):
            runs[-1][1] = day
        else:
            runs.append([day, day])
    found = F.lit(False)
    for first, last in runs:
        begin, end = (dt.datetime.combine(d, dt.time()) for d in (first, last + dt.timedelta(days=1)))
        value = F.col(column)
        found |= (value >= bound(df, column, begin, form)) & (value < bound(df, column, end, form))
    return found


@dataclass(frozen=True)
class DataWindow:
    """The part of a table an incremental check looks at.

    ``days`` lie before the start; they got rows after they had been inspected and are looked at again.
    """

    column: str
    start: dt.datetime | None = None
    stop: dt.datetime | None = None
    form: str = "yyyyDDD"
    days: tuple[dt.date, ...] = ()

    def of(self, df: DataFrame, column: str | None = None) -> DataFrame:
        """The window of a table, by a column of its own where its name differs."""
        column = column or self.column
        if column not in df.columns:
            raise ValueError(f"no column {column} to tell the window by")
        inside = in_window(column, self.start, self.stop, df, self.form)
        if self.days:
            before = in_window(column, None, self.stop, df, self.form)
            inside |= before & on_days(df, column, self.days, self.form)
        return df.where(inside)


def stamp_window(
    results: DataFrame, start: Column, stop: Column, mode: str = "check_mode"
) -> DataFrame:
    """Only a check that reports having run incrementally carries the window."""
    incremental = F.col(mode) == "incremental"
    return results.withColumns(
        {
            "data_start_timestamp": F.when(incremental, start),
            "data_stop_timestamp": F.when(incremental, stop),
        }
    )
