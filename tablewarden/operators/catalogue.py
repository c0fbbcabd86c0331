"""The checks a registry can name, built-in ones and the user's own.

Four kinds exist. All get a :class:`CheckContext`:

row        returns the predicate a bad row meets; counted with the table's other
           row checks in one scan - or two: those that file statistics can answer
           go separately, so that others do not keep them from skipping. It may
           return a one-row DataFrame instead, as a table check does
aggregate  returns an aggregate that is the count; shares a scan with row checks
table      returns a one-row DataFrame with ``violations``, optionally ``rc``,
           ``mode``, and a map ``vars`` that is saved with the result; or a function
           without arguments that returns it when the check's turn comes
partition  returns a row per partition, ``partition_value`` and ``violations``; kept
           by partition beside the history, and their sum is the count
setup      returns the JSON object (as a dict, or a one-row DataFrame with
           ``raw_output``) that carries variables and the data window

A check of one's own can call the built-in functions, or another check's
function, and add to what they return.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.moments import ISO_BASIC, moment
from tablewarden.operators import consistency, key_checks, key_index, policy, row_checks, statistics
from tablewarden.operators.fused import count_bad_rows, count_by_partition
from tablewarden.schema import (
    CHECK_CUSTOM_PREFIX,
    TABLE_CUSTOM_PREFIX,
    TABLE_PREFIX,
    VAR_PREFIX,
)
from tablewarden.sources.day_facts import DayFacts
from tablewarden.sources.tables import list_files
from tablewarden.streaming.incremental import DataWindow, in_window, moment_of


@dataclass(frozen=True)
class CheckMemory:
    """Where a check keeps what it knows of older rows, and which runs have stored their result."""

    path: str
    run: str
    committed: Callable[[list[str]], set[str]]
    #: the stored results of the check; None before the first
    results: DataFrame | None = None


@dataclass(frozen=True)
class CheckContext:
    """What a check gets to see: its table, the other tables, and its variables."""

    spark: SparkSession
    table: str
    df: DataFrame
    tables: Mapping[str, DataFrame]
    vars: Mapping[str, str]
    #: when each table was last profiled; None if the run was given no history
    profiled: Mapping[str, dt.datetime] | None = None
    #: when the run began
    started: dt.datetime | None = None
    #: the part of the table an incremental check sees; ``df`` is cut to it already
    window: DataWindow | None = None
    #: what the check keeps from run to run, if the run has a history to keep it beside
    memory: CheckMemory | None = None

    def custom(self, name: str, default: str | None = None) -> str:
        """A custom variable of the registry entry, without its prefix."""
        value = self.vars.get(CHECK_CUSTOM_PREFIX + name, default)
        if value is None:
            raise KeyError(f"the check needs {CHECK_CUSTOM_PREFIX}{name}")
        return value

    def names(self, name: str, default: str | None = None) -> list[str]:
        return [c.strip() for c in self.custom(name, default).split(",") if c.strip()]

    def number(self, name: str) -> int | float | None:
        """Whole numbers stay whole: a comparison with them reaches the file reader."""
        value = self.custom(name, "").strip()
        if not value:
            return None
        return int(value) if value.lstrip("+-").isdigit() else float(value)

    def limit(self, name: str, column: str) -> int | float | dt.date | Column | None:
        """A bound for a column: a day or moment for dates and timestamps, otherwise a number."""
        kind = self.df.schema[column].dataType
        value = self.custom(name, "").strip()
        if value and isinstance(kind, T.DateType):
            return dt.date.fromisoformat(value)
        if value and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return moment(dt.datetime.fromisoformat(value))
        return self.number(name)

    def other(self, name: str) -> DataFrame:
        """Another table, cut to the data window of an incremental check as this one is.

        The window column has the same name there, or the one given as ``other_window_col``.
        Without such a column both sides can't be compared, and the check fails.
        """
        df = self.tables[name]
        if self.window is None:
            return df
        return self.window.of(df, self.custom("other_window_col", "") or None)


@dataclass(frozen=True)
class Check:
    kind: str
    body: Callable
    unit: str = "rows"
    policy: str = "quality"
    #: the predicate compares columns with literals, so file statistics can answer it
    skips: bool = False


@dataclass
class Catalogue:
    """Check bodies by name. Copy the built-in one to add to it."""

    checks: dict[str, Check] = field(default_factory=dict)

    def add(
        self,
        name: str,
        kind: str,
        unit: str = "rows",
        policy: str = "quality",
        skips: bool = False,
    ):
        if kind not in ("row", "aggregate", "table", "partition", "setup"):
            raise ValueError(f"unknown kind of check: {kind}")

        def register(body: Callable) -> Callable:
            self.checks[name] = Check(kind, body, unit, policy, skips)
            return body

        return register

    def copy(self) -> Catalogue:
        return Catalogue(dict(self.checks))


BUILT_IN = Catalogue()
_row = lambda name, **options: BUILT_IN.add(name, "row", **options)
_table = lambda name, policy="quality": BUILT_IN.add(name, "table", policy=policy)


@_row("not_null", skips=True)
def _not_null(ctx: CheckContext) -> Column:
    return row_checks.missing(*ctx.names("cols"))


@_row("case")
def _case(ctx: CheckContext) -> Column:
    return row_checks.wrong_case(ctx.custom("col"), ctx.custom("case", "upper"))


@_row("range", skips=True)
def _range(ctx: CheckContext) -> Column:
    col = ctx.custom("col")
    low, high = ctx.limit("min", col), ctx.limit("max", col)
    if isinstance(ctx.df.schema[col].dataType, T.StringType):
        return _range_of_text(ctx.df, col, low, high)
    return row_checks.out_of_range(col, low, high)


def _range_of_text(df: DataFrame, col: str, low, high) -> DataFrame:
    """Numbers written as text; a value that is none leaves the check without a count."""
    number = F.col(col).try_cast("double")
    bad = row_checks.out_of_range(number, low, high)
    lost = F.count_if(F.col(col).isNotNull() & number.isNull())
    return df.agg(F.when(lost == 0, F.count_if(bad)).alias("violations"))


@_row("length")
def _length(ctx: CheckContext) -> Column:
    return row_checks.wrong_length(ctx.custom("col"), ctx.number("min"), ctx.number("max"))


@_row("type")
def _type(ctx: CheckContext) -> Column:
    return row_checks.wrong_type(ctx.custom("col"), ctx.custom("type", "bigint"))


@_row("unknown")
def _unknown(ctx: CheckContext) -> Column:
    return row_checks.is_unknown(ctx.custom("col"), ctx.names("values"))


@_row("enum", skips=True)
def _enum(ctx: CheckContext) -> Column:
    return row_checks.not_in_set(ctx.custom("col"), ctx.names("values"))


@_row("ordered_pair")
def _ordered_pair(ctx: CheckContext) -> Column:
    strict = ctx.custom("strict", "true") == "true"
    return row_checks.out_of_order(ctx.custom("start"), ctx.custom("stop"), strict)


@_row("format")
def _format(ctx: CheckContext) -> Column:
    return row_checks.bad_format(ctx.custom("col"), ctx.custom("pattern"))


@_row("numeric")
def _numeric(ctx: CheckContext) -> Column:
    return row_checks.not_numeric(ctx.custom("col"))


@_row("iso8601")
def _iso8601(ctx: CheckContext) -> Column:
    return row_checks.not_iso8601(ctx.custom("col"), ctx.custom("form", "any"))


@_row("retention", policy="data-management", skips=True)
def _retention(ctx: CheckContext) -> Column:
    reference = dt.datetime.fromisoformat(ctx.custom("reference"))
    return row_checks.too_old(ctx.custom("col"), reference, int(ctx.custom("days")))


@BUILT_IN.add("not_empty", "table", unit="tables")
def _not_empty(ctx: CheckContext) -> DataFrame:
    return key_checks.not_empty_violations(ctx.df)


@_table("rule_uniqueness")
def _uniqueness(ctx: CheckContext) -> DataFrame | Callable[[], DataFrame]:
    """Keys on several rows; an incremental check also finds those that rows before its window have.

    Without a history to keep an index beside, it counts in the whole table.
    """
    keys = ctx.names("cols")
    if ctx.window is None:
        return key_checks.uniqueness_violations(ctx.df, keys)
    whole = ctx.tables[ctx.table]
    if ctx.memory is None:
        return key_checks.uniqueness_violations(whole, keys).withColumn("mode", F.lit("full"))
    window, memory = ctx.window, ctx.memory
    day = moment_of(ctx.df, window.column, F.col(window.column), window.form).cast("date")
    older = None if window.start is None else whole.where(in_window(window.column, None, window.start, whole, window.form))
    key_index.digested(ctx.df, keys, day)  # a missing column shows now

    def count() -> DataFrame:
        with key_index.KeyIndex(ctx.spark, memory.path, memory.run, memory.committed) as index:
            n = key_index.new_violations(index, ctx.df, keys, day, window.days, older)
        return ctx.spark.range(1).select(F.lit(n).cast("bigint").alias("violations"))

    return count


@_table("foreign_key")
def _foreign_key(ctx: CheckContext) -> DataFrame:
    keys = ctx.names("cols")
    parent = ctx.tables[ctx.custom("parent")]
    return key_checks.foreign_key_violations(
        ctx.df, parent, keys, ctx.names("parent_cols", ",".join(keys))
    )


def _day(ctx: CheckContext) -> Column:
    window = ctx.window
    return moment_of(ctx.df, window.column, F.col(window.column), window.form).cast("date").alias("day")


def _day_facts(ctx: CheckContext, kind: str, fields: list[T.StructField]) -> DayFacts:
    memory = ctx.memory
    return DayFacts(ctx.spark, f"{memory.path}/{kind}", fields, memory.run, memory.results)


@_table("outlier")
def _outlier(ctx: CheckContext) -> DataFrame | Callable[[], DataFrame]:
    """Values too far from the mean. An incremental check compares with all rows up to the window's end.

    Those before the window are known by their moments. Rows of days that are opened again are judged again.
    """
    col, deviations = ctx.custom("col"), float(ctx.custom("deviations", "3"))
    if ctx.window is None or ctx.memory is None:
        return count_bad_rows(ctx.df, statistics.outliers(ctx.df, col, deviations))
    parts = statistics.moments(ctx.df, col, _day(ctx))

    def count() -> DataFrame:
        known = _day_facts(ctx, "moments", statistics.MOMENTS).add(parts, list(ctx.window.days))
        return count_bad_rows(ctx.df, statistics.outliers_against(known, col, deviations))

    return count


@_table("base_vs_summary", "consistency")
def _base_vs_summary(ctx: CheckContext) -> DataFrame:
    keys = ctx.names("cols")
    measure = ctx.custom("measure", "")
    bad = consistency.base_vs_summary(
        ctx.other(ctx.custom("base")),
        ctx.df,
        ctx.names("base_cols", ",".join(keys)),
        keys,
        F.expr(measure) if measure else F.lit(1),
        ctx.custom("total"),
        ctx.number("tolerance"),
    )
    return bad.agg(F.count(F.lit(1)).alias("violations"))


@_table("peer_row_count", "consistency")
def _peer_row_count(ctx: CheckContext) -> DataFrame:
    return consistency.peer_row_count(ctx.df, ctx.other(ctx.custom("peer")))


@_table("peer_field_spot_check", "consistency")
def _peer_field_spot_check(ctx: CheckContext) -> DataFrame:
    share = float(ctx.custom("share", "0.01"))
    bad = consistency.peer_spot_check(
        ctx.df, ctx.other(ctx.custom("peer")), ctx.names("cols"), ctx.names("fields"), share
    )
    return bad.agg(F.count(F.lit(1)).alias("violations"))


@_table("target_vs_source", "consistency")
def _target_vs_source(ctx: CheckContext) -> DataFrame:
    source = ctx.other(ctx.custom("source"))
    return consistency.count_row_differences(source, ctx.df, ctx.names("partition", ""))


@_table("ordered_pair_across")
def _ordered_pair_across(ctx: CheckContext) -> DataFrame:
    """Rows of this table whose stop is not after the start another table has for their key."""
    return key_checks.ordered_pair_violations(
        ctx.tables[ctx.custom("starts")],
        ctx.df,
        (ctx.custom("starts_key"), ctx.custom("key")),
        ctx.custom("start"),
        ctx.custom("stop"),
        ctx.custom("strict", "true") == "true",
    )


@BUILT_IN.add("range_by_partition", "partition")
def _range_by_partition(ctx: CheckContext) -> DataFrame:
    """A range check counted by partition."""
    col = ctx.custom("col")
    bad = row_checks.out_of_range(col, ctx.limit("min", col), ctx.limit("max", col))
    return count_by_partition(ctx.df, ctx.custom("partition"), {"n": bad}).where("violations > 0")


@_table("profile")
def _profile(ctx: CheckContext) -> DataFrame | Callable[[], DataFrame]:
    """Statistics without pass or fail, saved as variables of the result.

    An incremental profile reads the window only: its sketches by day are kept and merged with those of earlier
    windows, so it is one of all rows up to the window's end.
    """
    columns = ctx.names("cols", ",".join(ctx.df.columns))
    if ctx.window is None or ctx.memory is None:
        return _saved_profile(statistics.profile(ctx.df, columns))
    parts = statistics.sketches(ctx.df, columns, _day(ctx))

    def merge() -> DataFrame:
        known = _day_facts(ctx, "sketches", statistics.SKETCHES).add(parts, list(ctx.window.days))
        return _saved_profile(statistics.merged_profile(known))

    return merge


def _saved_profile(facts: DataFrame) -> DataFrame:
    names = [c for c in facts.columns if c != "column_name"]
    entries = F.array(
        *[
            F.struct(
                F.concat(F.lit(f"{VAR_PREFIX}profile_"), "column_name", F.lit(f"_{n}")).alias("key"),
                F.coalesce(F.col(n).cast("string"), F.lit("")).alias("value"),
            )
            for n in names
        ]
    )
    return facts.agg(
        F.lit(0).alias("violations"),
        F.map_from_entries(F.flatten(F.collect_list(entries))).alias("vars"),
    )


def _newest_profile(ctx: CheckContext) -> dt.datetime | None:
    """When the table was last profiled. The run has read that for all its tables at once."""
    if ctx.profiled is None:
        raise ValueError("the check looks at the results of earlier runs")
    return ctx.profiled.get(ctx.table)


def _verdict(ctx: CheckContext, bad: bool) -> DataFrame:
    return ctx.spark.range(1).select(F.lit(int(bad)).alias("violations"))


@BUILT_IN.add("stats_exist", "table", unit="tables", policy="data-management")
def _stats_exist(ctx: CheckContext) -> DataFrame:
    return _verdict(ctx, _newest_profile(ctx) is None)


@BUILT_IN.add("stats_not_stale", "table", unit="tables", policy="data-management")
def _stats_not_stale(ctx: CheckContext) -> DataFrame:
    limit = ctx.started - dt.timedelta(days=int(ctx.custom("days")))
    newest = _newest_profile(ctx)
    return _verdict(ctx, newest is not None and newest < limit)


def _bad_files(ctx: CheckContext, bad: Column) -> DataFrame:
    return policy.audit_files(list_files(ctx.spark, *ctx.names("path")), bad=bad)


@_table("block_size", "data-management")
def _block_size(ctx: CheckContext) -> DataFrame:
    return _bad_files(ctx, policy.too_small(int(ctx.custom("min_bytes"))))


@_table("file_format", "data-management")
def _file_format(ctx: CheckContext) -> DataFrame:
    return _bad_files(ctx, policy.wrong_extension(*ctx.names("formats", "parquet")))


@_table("sql")
def _sql(ctx: CheckContext) -> DataFrame:
    return sql_check(ctx, ctx.custom("sql"))


def sql_check(ctx: CheckContext, template: str) -> DataFrame:
    """Run a SQL template; it selects one row with ``violations``.

    ``{table}`` is the inspected table and ``{name}`` any other known table whose
    name the template mentions. Variables come in as named parameters, e.g.
    ``:hapinsp_checkcustom_max``: as values, never as pieces of SQL text.
    """
    frames = {n: df for n, df in ctx.tables.items() if f"{{{n}}}" in template}
    if "{table}" in template:
        frames["table"] = ctx.df
    args = {k: v for k, v in ctx.vars.items() if f":{k}" in template}
    if frames:  # braces that name no table, such as those of patterns, are text
        names = "|".join(re.escape(n) for n in frames)
        parts = re.split(rf"(\{{(?:{names})\}})", template)
        template = "".join(p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts))
    return ctx.spark.sql(template, args=args, **frames)


@BUILT_IN.add("incremental_window", "setup")
def _incremental_window(ctx: CheckContext) -> DataFrame:
    """Data window of a growing table: from the last window's end to the newest row.

    The column holds timestamps, dates, or numbers that write a day (``form``). Only what is newer
    than the last window's end is read; where nothing is, the window ends where it began. Days before
    that get looked at again if rows come late; ``look_back_days`` says how far back, else all are counted.
    """
    column, form = ctx.custom("col"), ctx.custom("form", "yyyyDDD")
    prior = ctx.vars.get(f"{TABLE_PREFIX}_data_stop_ts_prior") or None
    newer, stop = ctx.df, F.lit(None).cast("timestamp_ntz")
    if prior is not None:
        at = dt.datetime.strptime(prior, ISO_BASIC)
        newer, stop = newer.where(in_window(column, at, None, newer, form)), moment(at)
    mark = F.coalesce(moment_of(ctx.df, column, F.max(column), form), stop)
    back = ctx.custom("look_back_days", "")
    window = F.struct(
        F.lit("0").alias("rc"),
        F.lit("incremental").alias("mode"),
        F.lit(prior).cast("string").alias("data_start_ts"),
        F.date_format(mark, "yyyyMMdd'T'HHmmssSSSSSS").alias("data_stop_ts"),
        F.lit(column).alias(f"{TABLE_CUSTOM_PREFIX}window_col"),
        F.lit(form).alias(f"{TABLE_CUSTOM_PREFIX}window_form"),
        *([F.lit(back).alias(f"{TABLE_CUSTOM_PREFIX}look_back_days")] if back else []),
    )
    return newer.agg(F.to_json(window).alias("raw_output"))
