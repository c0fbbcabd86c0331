"""Comparing a table with its summary, its replica or its source.

No rows are paired up here. The two sides are stacked and aggregated by key, so
one shuffle serves both, equal rows collapse in the task that reads them, and a
key that is frequent on both sides never multiplies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def base_vs_summary(
    base: DataFrame,
    summary: DataFrame,
    base_keys: Sequence[str],
    summary_keys: Sequence[str],
    measure: Column,
    total: str,
    tolerance: float | None = None,
) -> DataFrame:
    """Groups whose recomputed ``measure`` disagrees with the summary's ``total``.

    ``measure`` is the per-row value that is summed over the base rows (``lit(1)``
    counts them). A group is listed if it is missing on either side, if the
    summary has several rows for it, or if the values differ - by more than
    ``tolerance`` where one is given. Columns: the keys, ``base_value``,
    ``summary_value``, ``problem``.
    """
    keys = [f"_k{i}" for i in range(len(base_keys))]
    from_base = base.select(
        *[F.col(b).alias(k) for b, k in zip(base_keys, keys)],
        measure.alias("_m"),
        F.lit(None).alias("_t"),
        F.lit(1).alias("_b"),
        F.lit(0).alias("_s"),
    )
    from_summary = summary.select(
        *[F.col(s).alias(k) for s, k in zip(summary_keys, keys)],
        F.lit(None).alias("_m"),
        F.col(total).alias("_t"),
        F.lit(0).alias("_b"),
        F.lit(1).alias("_s"),
    )
    groups = (
        from_base.unionByName(from_summary)
        .groupBy(*keys)
        .agg(
            F.sum("_m").alias("base_value"),
            F.max("_t").alias("summary_value"),
            F.max("_b").alias("_b"),
            F.sum("_s").alias("_s"),
        )
    )
    a, b = F.col("base_value"), F.col("summary_value")
    if tolerance is None:
        same = a.eqNullSafe(b)
    else:
        same = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    problem = (
        F.when(F.col("_s") == 0, F.lit("missing in summary"))
        .when(F.col("_b") == 0, F.lit("missing in base"))
        .when(F.col("_s") > 1, F.lit("repeated in summary"))
        .when(~same, F.lit("different"))
    )
    named = [F.col(k).alias(s) for k, s in zip(keys, summary_keys)]
    return groups.select(*named, "base_value", "summary_value", problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )


def peer_row_count(table: DataFrame, peer: DataFrame) -> DataFrame:
    """One row: ``n_table``, ``n_peer`` and their absolute difference ``violations``.

    Apply the data window to both sides before the call for an incremental check.
    """
    n = F.count(F.lit(1))
    counts = table.agg(n.alias("n"), F.lit(True).alias("own")).unionByName(
        peer.agg(n.alias("n"), F.lit(False).alias("own"))
    )
    return counts.agg(
        F.sum(F.when(F.col("own"), F.col("n"))).alias("n_table"),
        F.sum(F.when(~F.col("own"), F.col("n"))).alias("n_peer"),
    ).withColumn("violations", F.abs(F.col("n_table") - F.col("n_peer")))


def in_sample(keys: Sequence[str], share: float) -> Column:
    """A repeatable pseudo-random share of the keys, the same on every cluster.

    The sample is drawn on the MD5 of the key's text, of which the leading 60 bits
    are compared with the share, so even a tiny share is proportionate.
    """
    if not 0 < share <= 1:
        raise ValueError("the share of a sample is above 0 and at most 1")
    if share == 1:
        return F.lit(True)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    leading = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return leading < F.lit(max(1, int(share * 2**60)))


def _groupable(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Maps cannot be grouping keys; their sorted entries can."""
    out = []
    for c in cols:
        if isinstance(df.schema[c].dataType, T.MapType):
            out.append(F.array_sort(F.map_entries(F.col(c))).alias(c))
        else:
            out.append(F.col(c))
    return out


def row_differences(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows that come a different number of times: ``n_left``, ``n_right``."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(
        *_groupable(left, cols), one.alias("_l"), none.alias("_r")
    ).unionByName(right.select(*_groupable(right, cols), none.alias("_l"), one.alias("_r")))
    return (
        both.groupBy(*cols)
        .agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
        .where(F.col("n_left") != F.col("n_right"))
    )


def peer_spot_check(
    table: DataFrame, peer: DataFrame, keys: Sequence[str], fields: Sequence[str], share: float
) -> DataFrame:
    """Sampled keys whose rows differ between a table and its peer.

    The sample is the feature: it is taken before anything is shuffled, and on
    both sides alike, so a key missing from one of them is found too. One row per
    differing key with ``n_table`` and ``n_peer`` (rows that have no equal on the
    other side) and ``fields_differing``, the names of the fields that do.
    """
    picked = in_sample(keys, share)
    cols = [*keys, *fields]
    rows = row_differences(table.where(picked), peer.where(picked), cols)
    gap = F.col("n_left") - F.col("n_right")
    # of each field the values that one side has more often: none is left where the sides agree; the nameless
    # field stands for the whole row
    whole = F.struct(F.lit("").alias("field"), F.to_json(F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])).alias("v"))
    values = F.array(whole, *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    own = [f"_k{i}" for i in range(len(keys))]
    each = rows.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], gap.alias("_gap"), F.explode(values).alias("_f"))
    parts = each.groupBy(*own, "_f.field", "_f.v").agg(F.sum("_gap").alias("_gap"))
    row = F.col("field") == ""
    uneven = parts.groupBy(*own).agg(
        F.coalesce(F.sum(F.when(row, F.greatest("_gap", F.lit(0)))), F.lit(0)).alias("n_table"),
        F.coalesce(F.sum(F.when(row, F.greatest(-F.col("_gap"), F.lit(0)))), F.lit(0)).alias("n_peer"),
        F.collect_set(F.when(~row & (F.col("_gap") != 0), F.col("field"))).alias("_names"),
    )
    listed = F.concat_ws(",", *[F.when(F.array_contains(F.col("_names"), f), F.lit(f)) for f in fields])
    # the same values, paired differently: rows differ though no field on its own does
    paired = F.when(listed == "", F.lit(",".join(fields))).otherwise(listed)
    return uneven.select(
        *[F.col(o).alias(k) for k, o in zip(keys, own)], "n_table", "n_peer", paired.alias("fields_differing")
    )


def target_vs_source(source: DataFrame, target: DataFrame) -> DataFrame:
    """Whole rows without a counterpart, by side: ``n_missing`` and ``n_extra``.

    The numbers are those of EXCEPT ALL in both directions: ``n_missing`` copies
    are in the source only, ``n_extra`` in the target only.
    """
    cols = source.columns
    diff = row_differences(source, target.select(*cols), cols)
    gap = F.col("n_left") - F.col("n_right")
    return diff.select(
        *cols,
        F.greatest(gap, F.lit(0)).alias("n_missing"),
        F.greatest(-gap, F.lit(0)).alias("n_extra"),
    )


def count_differences(differences: DataFrame) -> DataFrame:
    """Totals of :func:`target_vs_source`; ``violations`` is their sum."""
    zero = F.lit(0).cast("bigint")
    return differences.agg(
        F.coalesce(F.sum("n_missing"), zero).alias("n_missing"),
        F.coalesce(F.sum("n_extra"), zero).alias("n_extra"),
    ).withColumn("violations", F.col("n_missing") + F.col("n_extra"))


#: Buckets of a partition whose fingerprints are compared before its rows are.
FINGERPRINT_BUCKETS = 1024


def digestible(df: DataFrame, c: str) -> Column:
    """A column as the hash functions see all of it: they pass over NULL inside arrays and structs, JSON does not."""
    if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        value = _groupable(df, [c])[0]
        return F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.col(c)


def row_digests(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """``d1`` and ``d2``, a 128-bit digest of each row, which NULLs are part of, and ``bucket``."""
    values = [digestible(df, c) for c in cols]
    blanks = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    digests = df.select(
        *[F.col(k).alias(f"_p{i}") for i, k in enumerate(keep)],
        F.xxhash64(F.lit("first"), blanks, *values).alias("d1"),
        F.xxhash64(F.lit("second"), blanks, *values).alias("d2"),
    )
    return digests.withColumn("bucket", F.pmod("d1", F.lit(FINGERPRINT_BUCKETS)).cast("int"))


def fingerprints(digests: DataFrame, *by: str) -> DataFrame:
    """Rows and an order-free sum of their digests, for each combination of ``by``.

    Digests are summed in halves, which do not overflow below two thousand million rows of a combination (a sum
    that did would raise). ``n`` is part of the comparison.
    """
    half = lambda d, k: F.shiftrightunsigned(d, 32) if k else F.col(d).bitwiseAND(F.lit(0xFFFFFFFF))
    sums = [F.sum(half(d, k)).alias(f"f{i}") for i, (d, k) in enumerate([("d1", 0), ("d1", 1), ("d2", 0), ("d2", 1)])]
    return digests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def differing_places(source: DataFrame, target: DataFrame, *by: str) -> DataFrame:
    """Combinations of ``by`` whose fingerprints differ between two frames of digests. A row of each is sent per task."""
    prints = ["n", "f0", "f1", "f2", "f3"]
    left = fingerprints(source, *by).select(*by, *prints, F.lit(1).alias("side"))
    right = fingerprints(target, *by).select(*by, *prints, F.lit(-1).alias("side"))
    gaps = [F.sum(F.col(c) * F.col("side")).alias(c) for c in prints]
    some = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in prints])
    return left.unionByName(right).groupBy(*by).agg(*gaps).where(some).select(*by)


def count_row_differences(source: DataFrame, target: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """The same totals by descent: fingerprints of partitions' buckets, then digests of rows where those differ.

    Equal tables are read once and next to nothing is sent. Where buckets differ, a second read sends the 128-bit
    digests of their rows only, and with ``partition`` columns it skips partitions without any difference.
    """
    cols = source.columns
    keep = [f"_p{i}" for i in range(len(partition))]
    left, right = row_digests(source, cols, *partition), row_digests(target.select(*cols), cols, *partition)
    by = [*keep, "bucket"]
    places = differing_places(left, right, *by).select(*[F.col(c).alias(f"{c}_") for c in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by])
    if not partition:
        places = F.broadcast(places)  # at most as many rows as there are buckets
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(*by, "d1", "d2", one.alias("_l"), none.alias("_r")).unionByName(
        right.select(*by, "d1", "d2", none.alias("_l"), one.alias("_r"))
    )
    gap = F.sum("_l") - F.sum("_r")
    gaps = both.join(places, same, "left_semi").groupBy("d1", "d2").agg(gap.alias("gap")).where("gap <> 0")
    return count_differences(
        gaps.select(
            F.greatest(F.col("gap"), F.lit(0)).alias("n_missing"),
            F.greatest(-F.col("gap"), F.lit(0)).alias("n_extra"),
        )
    )
