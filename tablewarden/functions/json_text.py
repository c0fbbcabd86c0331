"""Strict reading of JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_object(text: Column, schema: str) -> Column:
    """The JSON object the text consists of, NULL if it is anything else.

    ``from_json`` alone ignores whatever follows the closing brace. As the single
    element of an array the same text has to be complete and on its own.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    closed = F.rtrim(text, F.lit(" \t\r\n")).endswith("}")
    return F.when(alone & closed, F.from_json(text, schema, {"allowSingleQuotes": "false"}))


def strict_struct(text: Column, schema: str) -> Column:
    """The fields of the JSON object the text consists of, NULL if it is anything else.

    One parse, as the single element of an array; of a repeated key the last value counts.
    """
    closed = F.rtrim(text, F.lit(" \t\r\n")).endswith("}")
    options = {"allowSingleQuotes": "false"}
    alone = F.from_json(F.when(closed, F.concat(F.lit("["), text, F.lit("]"))), f"array<{schema}>", options)
    return F.when(F.size(alone) == 1, alone[0])
