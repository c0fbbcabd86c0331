"""Moments without time zone, whatever the zones of session and machine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO basic form with microseconds, as variables carry moments.
ISO_BASIC = "%Y%m%dT%H%M%S%f"


def moment(value: Column | dt.datetime | None) -> Column:
    """A literal of a naive datetime.

    It goes through text: a Python datetime as such becomes a moment of the
    session's time zone and may shift. Planning folds it into a plain literal.
    """
    if isinstance(value, Column):
        return value
    text = None if value is None else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
