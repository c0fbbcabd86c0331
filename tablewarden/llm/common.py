"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.session import shared_folder

#: The ASCII white space of the contracts, ``[\\x20\\x09-\\x0D]``.
WHITE = " \t\n\x0b\f\r"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage: an executor lost later costs a re-read, not the work before, and what
    is not deterministic (row numbers) is fixed for all readers.
    """
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, names: dict[str, str], row: str = "_row") -> DataFrame:
    """``docs`` with its columns renamed, and a number of each row that is the same whenever it is read.

    Rows of files are numbered by their file and place in it; rows of any other plan are written down first.
    """
    renamed = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    try:
        if "_metadata" not in docs.columns:
            place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            return docs.select(*renamed, place.alias(row))
    except AnalysisException:
        pass
    return stored(docs.select(*renamed, F.monotonically_increasing_id().alias(row)))


def text_or_empty(column: str):
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(key_column, modulus: int):
    """crc32 of the key as text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(F.coalesce(key_column.cast("string"), F.lit(""))) % modulus


#: Rows of a table of keys and labels up to which it is broadcast (some 30 MB); above, the join shuffles.
BROADCAST_ROWS = 500_000


def joined_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their labels, joined on ``_key``; the labels are broadcast if they are few."""
    if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        labels = F.broadcast(labels)
    return docs.join(labels, "_key")


#: Rows of a class that a sample holds at least, if there are as many; where texts are too long for that, their starts.
LEAST_ROWS = 20


def sampled(df: DataFrame, bounds: dict) -> DataFrame:
    """A sample of ``_text`` and ``_label`` with ``_weight``, the rows each one stands for; the same one each time.

    ``bounds`` gives the most rows and characters for each label. Equal texts of a label are one row. Rows are taken
    in order of a hash over their number of copies until a bound is met (priority sampling), so a large group of
    copies is always in, once, and weighs its share of the rows.
    """
    spark, h = df.sparkSession, F.xxhash64(F.lit("sample"), "_text")
    groups = df.groupBy("_label", h.alias("_h")).agg(
        F.count("*").alias("n"), F.max(F.coalesce(F.length("_text"), F.lit(0))).alias("c")
    )
    rank = ((F.col("_h") / 2.0**64 + 0.5 + 2.0**-54) / F.col("n")).alias("rank")
    groups = stored(groups.select("_label", "_h", "n", "c", rank))
    chosen = []
    for label, (rows, chars) in bounds.items():
        first = groups.where(F.col("_label") == label).orderBy("rank", "_h").limit(rows + 1).collect()
        chosen += [(label, *x) for x in taken([(r["_h"], r["n"], r["c"], r["rank"]) for r in first], rows, chars)]
    kind = df.schema["_label"].dataType.simpleString()
    keys = spark.createDataFrame(chosen, f"_label {kind}, _h long, _weight double, _most int")
    found = df.select("_text", "_label", h.alias("_h")).join(F.broadcast(keys), ["_label", "_h"])
    start = F.substr("_text", F.lit(1), F.col("_most"))
    return found.dropDuplicates(["_label", "_h"]).select(start.alias("_text"), "_label", "_weight")


def taken(first: list[tuple], rows: int, chars: int) -> list[tuple[int, float, int]]:
    """Hash, weight and the most characters of the rows to take of (hash, copies, characters, rank) in order."""

    def prefix(most: int) -> int:
        total, k = 0, 0
        while k < min(len(first), rows) and total + min(first[k][2], most) <= chars:
            total, k = total + min(first[k][2], most), k + 1
        return k

    most = max(chars, 1)
    k = prefix(most)
    if k < min(LEAST_ROWS, len(first), rows):
        most = max(chars // LEAST_ROWS, 1)
        k = prefix(most)
    least = 1 / first[k][3] if k < len(first) else 0.0
    return [(h, float(max(n, least)), most) for h, n, _, _ in first[:k]]
