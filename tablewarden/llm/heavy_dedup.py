"""Exact deduplication with a heavy-hitter split.

Digests that more than one row in ``counters + 1`` carries are found by Misra-Gries summaries, counted
exactly, and their winners broadcast: such rows meet their winner without a shuffle. All other digests
go through an ordinary shuffle, where no group can hold more than that share of the rows.

Defined results: NULL text counts as empty. Of equal texts the longest original stays, then the smallest
key (NULL last); of rows that agree in both, one stays. An empty table gives an empty result. Extra
columns are ignored by :func:`exact_groups` and returned by :func:`exact_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import numbered, stored, text_or_empty

#: Counters of a summary. Bounds the broadcast: at most so many digests, of about 100 bytes each.
COUNTERS = 512
#: Summaries of so many groups of tasks are merged side by side, then in one step.
FAN_IN = 32


def with_digest(docs: DataFrame, text: str) -> DataFrame:
    """Adds the digest of the text without ASCII white space, and the size of the original."""
    body = text_or_empty(text)
    packed = F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")
    return docs.withColumns({"_digest": F.unhex(F.sha2(packed, 256)), "_size": F.length(body)})


def reduce_counters(weights: pd.Series, counters: int) -> pd.Series:
    """Keeps at most ``counters`` entries: the next largest weight is taken off all of them.

    The Misra-Gries merge. The sum of all that is ever taken off a digest is at most
    rows / (counters + 1), so whatever is more frequent keeps a positive weight.
    """
    if len(weights) <= counters:
        return weights
    ordered = weights.sort_values(ascending=False)
    left = ordered.iloc[:counters] - ordered.iloc[counters]
    return left[left > 0]


def heavy_digests(digests: DataFrame, counters: int) -> DataFrame:
    """Candidates: every digest that more than 1 / (counters + 1) of the rows have, and maybe others."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = reduce_counters(held.add(batch["_digest"].value_counts(), fill_value=0), counters)
        task = TaskContext.get().partitionId() % FAN_IN
        yield pd.DataFrame({"task": task, "_digest": held.index, "weight": held.to_numpy(dtype="int64")})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        held = reduce_counters(part.groupby("_digest")["weight"].sum(), counters)
        return pd.DataFrame(
            {"task": part["task"].iloc[0], "_digest": held.index, "weight": held.to_numpy(dtype="int64")}
        )

    shape = "task int, _digest binary, weight long"
    summaries = digests.select("_digest").mapInPandas(summarise, shape)
    merged = summaries.groupBy("task").applyInPandas(merge, shape)
    return merged.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(merge, shape).select("_digest")


def winners(digests: DataFrame) -> DataFrame:
    """Of each digest: its number of rows, and the row that stays."""
    order = F.struct(
        (-F.col("_size")).alias("size"), F.col("_key").isNull().alias("last"), F.col("_key").alias("key"), F.col("_row")
    )
    best = digests.groupBy("_digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    return best.select("_digest", "group_size", F.col("best.key").alias("keep_id"), F.col("best._row").alias("_kept"))


def grouped(digests: DataFrame, counters: int) -> DataFrame:
    """Adds ``group_size``, ``keep_id`` and ``_kept``, the row that stays, to rows of _key, _digest, _size and _row."""
    rows = digests.count()
    candidates = stored(heavy_digests(digests, counters))  # at most ``counters`` rows
    heavy = stored(
        winners(digests.join(F.broadcast(candidates), "_digest", "left_semi")).where(
            F.col("group_size") > rows // (counters + 1)
        )
    )
    dealt = digests.join(F.broadcast(heavy), "_digest", "left")
    rest = dealt.where(F.col("_kept").isNull()).select(digests.columns)
    return dealt.where(F.col("_kept").isNotNull()).unionByName(rest.join(winners(rest), "_digest"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id, group_size, kept, text_sha256, and the size of the text."""
    digests = stored(
        with_digest(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").select(
            "_key", "_digest", "_size", F.monotonically_increasing_id().alias("_row")
        )
    )
    return grouped(digests, counters).select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        (F.col("_row") == F.col("_kept")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        F.col("_size").alias("n_chars_original"),
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    It is decided on light rows; whole rows meet the decision by their number, so copies of one document, whatever
    their keys, are spread as all other rows are.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = numbered(docs, names)
    digests = with_digest(rows.select(F.col(names[key]).alias("_key"), F.col(names[text]).alias("_text"), "_row"), "_text")
    groups = grouped(stored(digests.select("_key", "_digest", "_size", "_row")), counters)
    kept = groups.where(F.col("_row") == F.col("_kept")).select("_row")
    return rows.join(kept, "_row", "left_semi").select([F.col(n).alias(c) for c, n in names.items()])
