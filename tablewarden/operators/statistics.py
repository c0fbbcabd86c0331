"""Profiles of tables, anomalies, and whether profiles exist and are fresh."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.moments import moment
from tablewarden.operators.consistency import digestible
from tablewarden.operators.fused import MAX_PER_SCAN

_FACTS = 6


def _number(df: DataFrame, name: str) -> Column:
    """The column as a number for averages, NULL for types that have none."""
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return F.col(name).cast("double") if numeric else F.lit(None).cast("double")


def outliers(df: DataFrame, value: str, deviations: float) -> Column:
    """Rows further from the column's mean than so many sample standard deviations.

    Mean and deviation are one row computed first and handed to the scan as a
    scalar subquery; nothing is joined.
    """
    stats = df.agg(
        F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).alias("s")
    ).scalar()
    return F.abs(F.col(value) - stats["mean"]) > F.lit(deviations) * stats["sd"]


#: Moments of a column, which merge: rows, mean, and the sum of squared distances from it.
MOMENTS = [T.StructField(n, t) for n, t in (("n", T.LongType()), ("mean", T.DoubleType()), ("m2", T.DoubleType()))]


def moments(df: DataFrame, value: str, *keys: Column) -> DataFrame:
    """``n``, ``mean`` and ``m2`` of a column, by the given keys."""
    number = F.col(value).cast("double")
    n = F.count(number)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.avg(number).alias("mean"), (F.var_pop(number) * n).alias("m2")
    ).where("n > 0")


def merged_moments(rows: DataFrame) -> DataFrame:
    """One row: the moments of all rows together, and ``sd``, the sample standard deviation.

    Parts are joined pairwise by the distance of their means, which keeps digits that sums of squares lose. There
    is a part for each day, few as days are.
    """
    parts = F.sort_array(F.collect_list(F.struct("n", "mean", "m2")))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def join(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + gap * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
        )

    total = rows.agg(F.aggregate(parts, none, join).alias("t")).select("t.*")
    return total.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))))


def outliers_against(known: DataFrame, value: str, deviations: float) -> Column:
    """Rows further from the mean of ``known`` moments than so many of their standard deviations."""
    stats = merged_moments(known).agg(F.first(F.struct("mean", "sd")).alias("s")).scalar()
    return F.abs(F.col(value) - stats["mean"]) > F.lit(deviations) * stats["sd"]


#: What is kept of a column, so that windows merge: sketches of its distinct values and of its distribution.
SKETCHES = [
    T.StructField(n, t)
    for n, t in (
        ("column_name", T.StringType()), ("n_rows", T.LongType()), ("n_null", T.LongType()),
        ("min_value", T.StringType()), ("min_key", T.DoubleType()), ("max_value", T.StringType()),
        ("max_key", T.DoubleType()), ("total", T.DoubleType()), ("distinct_sketch", T.BinaryType()),
        ("quantile_sketch", T.BinaryType()),
    )
]

#: 2^12 registers: a distinct count is within 1.6 % (one standard error), a quantile's rank within 1.7 %.
HLL_BITS, KLL_SIZE = 12, 200
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def sketches(df: DataFrame, columns: Sequence[str] | None = None, *keys: Column) -> DataFrame:
    """Facts of each column that merge, in one scan: the fields of :data:`SKETCHES`, by the given keys."""
    columns = list(columns or df.columns)

    def of(c: str) -> Column:
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        number, text = _number(df, c), F.col(c).cast("string")
        none = F.lit(None).cast("double")
        return F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.min(c).cast("string").alias("min_value"),
            (F.min(number) if numeric else none).alias("min_key"),
            F.max(c).cast("string").alias("max_value"),
            (F.max(number) if numeric else none).alias("max_key"),
            (F.sum(number) if numeric else none).alias("total"),
            F.hll_sketch_agg(text, F.lit(HLL_BITS)).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)) if numeric else F.lit(None).cast("binary")).alias("quantile_sketch"),
        )

    wide = df.groupBy(*keys).agg(*[of(c).alias(f"c{i}") for i, c in enumerate(columns)])
    kept = wide.columns[: len(keys)]
    return wide.select(*kept, F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def merged_profile(parts: DataFrame) -> DataFrame:
    """The profile of all parts together: as :func:`profile`, with ``q25``, ``median`` and ``q75`` of numbers.

    Numbers find their least by value, others by text; dates and moments sort as their texts do.
    """
    numeric = F.max(F.col("min_key").isNotNull())
    least = F.when(numeric, F.min_by("min_value", "min_key")).otherwise(F.min("min_value"))
    most = F.when(numeric, F.max_by("max_value", "max_key")).otherwise(F.max("max_value"))
    known = F.sum("n_rows") - F.sum("n_null")
    merged = parts.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        least.alias("min_value"),
        most.alias("max_value"),
        F.try_divide(F.sum("total"), known).alias("avg_value"),
        F.when(F.max(F.col("min_key")).isNotNull(), F.kll_merge_agg_double("quantile_sketch")).alias("_q"),
    )
    quantiles = [
        F.when(F.col("_q").isNotNull(), F.kll_sketch_get_quantile_double("_q", F.lit(share))).alias(name)
        for name, share in QUANTILES.items()
    ]
    return merged.select("*", *quantiles).drop("_q")


def profile(df: DataFrame, columns: Sequence[str] | None = None, distinct: bool = True) -> DataFrame:
    """Statistics per column; up to 15 columns share a scan, and each scan reads only its own.

    ``n_rows, n_null, n_distinct`` (a sketch, within about 5 %; left out unless ``distinct``),
    ``min_value, max_value`` as text, ``avg_value`` of numbers.
    """
    columns = list(columns or df.columns)
    parts = []
    step = MAX_PER_SCAN // _FACTS
    for at in range(0, len(columns), step):
        names = columns[at : at + step]
        wide = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(F.col(c).isNull()).alias("n_null"),
                    *([F.approx_count_distinct(c).alias("n_distinct")] if distinct else []),
                    F.min(c).cast("string").alias("min_value"),
                    F.max(c).cast("string").alias("max_value"),
                    F.avg(_number(df, c)).alias("avg_value"),
                ).alias(f"c{i}")
                for i, c in enumerate(names)
            ]
        )
        parts.append(wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(names))]))))
    return reduce(DataFrame.unionByName, parts)


def profile_exact(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same with exact distinct counts, in two scans whatever the number of columns.

    One has the plain figures. The other lays columns out below each other and reduces them to a row per column
    and 128-bit digest of a value, in the tasks first, so a frequent value costs one row per task.
    """
    columns = list(columns or df.columns)
    facts = profile(df, columns, distinct=False)
    digests = [
        F.struct(
            F.lit(i).alias("i"),
            F.xxhash64(F.lit(1), digestible(df, c)).alias("d1"),
            F.xxhash64(F.lit(2), digestible(df, c)).alias("d2"),
            F.col(c).isNotNull().alias("known"),
        )
        for i, c in enumerate(columns)
    ]
    values = df.select(F.explode(F.array(*digests)).alias("v")).select("v.*").where("known")
    once = values.groupBy("i", "d1", "d2").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count("one").alias("n_distinct"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    exact = once.select(names.alias("column_name"), "n_distinct")
    counted = F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
    return facts.join(exact, "column_name", "left").select(
        "column_name", "n_rows", "n_null", counted, "min_value", "max_value", "avg_value"
    )


def stats_missing(expected: DataFrame, profiles: DataFrame, table: str = "table_name") -> DataFrame:
    """Expected tables without any stored profile."""
    known = profiles.select(F.col(table).alias("_known")).distinct()
    return expected.join(known, expected[table] == known["_known"], "left_anti")


def stats_stale(
    profiles: DataFrame,
    reference: dt.datetime | Column,
    days: int,
    table: str = "table_name",
    taken: str = "run_start_timestamp",
) -> DataFrame:
    """Tables whose newest profile is more than ``days`` older than the reference."""
    newest = profiles.groupBy(table).agg(F.max(taken).alias("newest"))
    limit = moment(reference) - F.make_dt_interval(F.lit(days))
    return newest.where(F.col("newest") < limit)
