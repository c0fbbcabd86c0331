"""Checks that look at one row: each function gives the predicate a bad row meets.

As with SQL CHECK constraints a NULL input passes, except for :func:`missing`:
the predicate is then NULL, which counts as not met.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.functions.moments import moment
from tablewarden.functions.validators import is_iso8601, is_numeric, whole_number

INTEGERS = ("tinyint", "byte", "smallint", "short", "int", "integer", "bigint", "long")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(*cols: Column | str) -> Column:
    """A required field is NULL, any one of them if there are several."""
    return reduce(lambda a, b: a | b, [_col(c).isNull() for c in cols])


def wrong_case(c: Column | str, case: str = "upper") -> Column:
    c = _col(c)
    if case not in ("upper", "lower"):
        raise ValueError(f"unknown case: {case}")
    return c != (F.upper(c) if case == "upper" else F.lower(c))


def out_of_range(c: Column | str, low=None, high=None) -> Column:
    """Below ``low`` or above ``high``; either bound may be left open."""
    c = _col(c)
    if low is None and high is None:
        raise ValueError("a range needs at least one bound")
    if low is None:
        return c > high
    if high is None:
        return c < low
    return (c < low) | (c > high)


def wrong_length(c: Column | str, low=None, high=None) -> Column:
    return out_of_range(F.length(_col(c)), low, high)


def wrong_type(c: Column | str, type_name: str = "bigint") -> Column:
    """The value does not convert to the type, e.g. text that is no integer."""
    c = _col(c)
    converted = c.try_cast(type_name)
    if type_name.lower() in INTEGERS:
        is_text = F.typeof(c) == "string"
        converted = F.when(is_text, whole_number(c.cast("string"), type_name)).otherwise(converted)
    return c.isNotNull() & converted.isNull()


def is_unknown(c: Column | str, unknown: list[str]) -> Column:
    """The value is one of those that stand for *unknown*, blanks and case aside."""
    return F.lower(F.trim(_col(c))).isin([u.lower() for u in unknown])


def not_in_set(c: Column | str, domain: list) -> Column:
    return ~_col(c).isin(domain)


def out_of_order(start: Column | str, stop: Column | str, strict: bool = True) -> Column:
    """``start < stop`` does not hold (``<=`` unless strict)."""
    start, stop = _col(start), _col(stop)
    return ~(start < stop) if strict else ~(start <= stop)


def bad_format(c: Column | str, pattern: str) -> Column:
    return ~_col(c).rlike(pattern)


def not_numeric(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & ~is_numeric(c)


def not_iso8601(c: Column | str, kind: str = "any") -> Column:
    c = _col(c)
    return c.isNotNull() & ~is_iso8601(c, kind)


def too_old(ts: Column | str, reference: dt.date | dt.datetime, days: int) -> Column:
    """Older than ``days`` before the reference date: retained for too long.

    The limit is a literal, so a scan with this predicate alone skips files.
    """
    limit = dt.datetime.combine(reference, dt.time()) if type(reference) is dt.date else reference
    return _col(ts) < moment(limit - dt.timedelta(days=days))
