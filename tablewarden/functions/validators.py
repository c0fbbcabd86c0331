"""Validity of text: numbers and ISO-8601 timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that reads as a whole number.
WHOLE = r"^\s*[+-]?\d+\s*$"

# --- Fixed values: the accepted forms, and how they read with separators ----------
ISO_FORMS = {
    "basic": [
        (r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6"),
        (r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(\d{6})$", "$1-$2-$3 $4:$5:$6.$7"),
    ],
    "ext": [
        (r"^(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)$", "$1 $2"),
        (r"^(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d\.\d{6})$", "$1 $2"),
    ],
}
# --- End of fixed values -------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_number(text: Column, type_name: str = "bigint") -> Column:
    """The number a text stands for, NULL if it is none or does not fit the type.

    Failing casts are costly, so only text of the right shape is cast.
    """
    return F.when(text.rlike(WHOLE), text.try_cast(type_name))


def is_numeric(c: Column | str) -> Column:
    """True where the value converts to a whole number.

    Numbers qualify whatever their fraction; text only if it is digits, however
    many, with an optional sign and surrounding blanks. NULL, ``''`` and ``'3.7'``
    do not. The column's type picks the branch when the query is planned.
    """
    c = _col(c)
    as_text = c.cast("string").rlike(WHOLE)
    as_number = c.try_cast("bigint").isNotNull()
    numeric = F.when(F.typeof(c) == "string", as_text).otherwise(as_number)
    return F.coalesce(numeric, F.lit(False))


def iso_timestamp(c: Column | str, kind: str = "any") -> Column:
    """The timestamp (no zone) an ISO-8601 text stands for, NULL if it is not valid.

    ``kind`` is ``basic`` (20150430T000000, optionally six more digits of
    microseconds), ``ext`` (2015-04-30T00:00:00, optionally .mmmmmm) or ``any``.
    """
    if kind not in ("basic", "ext", "any"):
        raise ValueError(f"unknown ISO-8601 kind: {kind}")
    c = _col(c)
    forms = [f for k in ISO_FORMS for f in ISO_FORMS[k] if kind in (k, "any")]
    text = F.upper(c)
    # the year 0000 exists for Spark, not for calendars that start at 0001
    dated = ~c.startswith("0000")
    parsed = None
    for shape, spaced in forms:
        value = F.regexp_replace(text, shape, spaced).try_cast("timestamp_ntz")
        case = dated & text.rlike(shape)
        parsed = F.when(case, value) if parsed is None else parsed.when(case, value)
    return parsed


def is_iso8601(c: Column | str, kind: str = "any") -> Column:
    """True where the text is a real date and time in the asked form; NULL gives False."""
    return iso_timestamp(c, kind).isNotNull()
