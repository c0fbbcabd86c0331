"""Variables given to checks: ``map<string,string>`` columns.

Spark refuses to build a map in which a key comes up twice. Overridden keys are
therefore dropped first, so no session setting has to change.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.schema import PRIOR_SUFFIX, TABLE_PREFIX


def no_vars() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def or_empty(m: Column) -> Column:
    return F.coalesce(m, no_vars())


def clean_vars(m: Column) -> Column:
    """NULL and any spelling of ``none`` become the empty string."""
    return F.transform_values(
        or_empty(m),
        lambda _, v: F.when(v.isNull() | (F.lower(F.trim(v)) == "none"), F.lit("")).otherwise(v),
    )


def merge_vars(left: Column, right: Column) -> Column:
    """All variables of both; where both know a name, ``right`` wins."""
    left, right = or_empty(left), or_empty(right)
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def as_prior(m: Column) -> Column:
    """Rename variables of an earlier run: ``x`` becomes ``x_prior``.

    The saved window bounds get their variable names first. Names that already
    carry the suffix keep it, unless the earlier run also had the plain name:
    then the plain one is the more recent value and wins.
    """
    m = or_empty(m)
    bounds = [F.lit("data_start_ts"), F.lit("data_stop_ts")]
    m = F.transform_keys(
        m, lambda k, _: F.when(k.isin(bounds), F.concat(F.lit(TABLE_PREFIX + "_"), k)).otherwise(k)
    )
    older = F.map_filter(m, lambda k, _: k.endswith(PRIOR_SUFFIX))
    plain = F.map_filter(m, lambda k, _: ~k.endswith(PRIOR_SUFFIX))
    renamed = F.transform_keys(plain, lambda k, _: F.concat(k, F.lit(PRIOR_SUFFIX)))
    return merge_vars(older, renamed)


def last_wins(m: Column) -> Column:
    """A parsed JSON object can repeat a key; keep its last value.

    Hand in a column, not the parsing expression: it is used several times here.
    """
    keys = F.map_keys(m)
    n = F.size(keys)
    entries = F.filter(
        F.map_entries(m), lambda e, i: F.array_position(F.reverse(keys), e["key"]) == n - i
    )
    return F.when(F.size(F.array_distinct(keys)) == n, m).otherwise(F.map_from_entries(entries))


def sorted_vars_text(m: Column, sep: str = ",") -> Column:
    """``k=v`` pairs in key order, a stable text form of a map."""
    pairs = F.transform(
        F.array_sort(F.map_entries(or_empty(m))),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))),
    )
    return F.array_join(pairs, sep)


def vars_json(m: Column) -> Column:
    """The JSON text of a map, empty text for none."""
    return F.when(m.isNull(), F.lit("")).otherwise(F.to_json(m))
