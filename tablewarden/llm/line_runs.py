"""Line deduplication over levelled sorted runs, in DataFrame operations only.

Documents are taken in batches of ascending key. The seen line digests are kept in runs: tables bucketed
and sorted by digest. A batch is laid out the same way once and merge-anti-joined with each run, which is
not shuffled; what is new becomes a run of level 0. When a level has ``fan`` runs they are merged into one
run of the next level, so a batch meets a few runs however many came before.

Defined results: NULL or empty text is one empty line. Lines whose trimmed, A-Z-lowered key has fewer than
``min_chars`` code points always stay. A NULL key counts as one document after all others. Rows that share a
key count as one document. An empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import WHITE, stored, text_or_empty
from tablewarden.session import shared_folder

#: A key after all others.
LAST = 2**63 - 1


class Runs:
    """Levels of runs; each run is a catalogue table in the shared folder, bucketed and sorted by digest.

    With as many buckets as the session has shuffle partitions, the joins read the runs as they lie.
    """

    def __init__(self, like: DataFrame, fan: int, buckets: int):
        self.spark, self.fan, self.buckets = like.sparkSession, fan, buckets
        self.levels: list[list[str]] = []
        self.written: list[str] = []

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` laid out as the runs are: the one shuffle of a batch's digests."""
        return rows.repartition(self.buckets, "h1", "h2")

    def write(self, run: DataFrame) -> str:
        """Stores rows that are laid out as the runs are."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.written.append(name)
        (
            run.write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", f"{shared_folder(self.spark)}/run")
            .saveAsTable(name)
        )
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of dealt ``lines`` whose digest is in no run: a chain of merge anti joins."""
        for run in self.tables():
            lines = lines.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, run: DataFrame) -> DataFrame:
        """Stores a run at level 0 and merges the levels that are full."""
        name = self.write(run)
        added = self.spark.table(name)
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fan:
                return added
            # runs hold different digests, so their union is the merged run
            parts = [self.spark.table(n) for n in self.levels[level]]
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.unionByName(part)
            name = self.write(self.dealt(merged))
            self.levels[level] = []
            level += 1

    def forget(self) -> None:
        """Takes all runs out of the catalogue, merged ones too; their files go with the shared folder."""
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_key(line: Column) -> Column:
    """The line trimmed of ASCII white space, A-Z lowered."""
    bare = F.btrim(line, F.lit(WHITE))
    plain = F.octet_length(bare) == F.char_length(bare)
    folded = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(bare)).otherwise(folded)


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines long enough to count: the document's key and text hash, the position, a 128-bit digest."""
    parts = docs.select("_key", "_hash", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    keyed = parts.select("_key", "_hash", "pos", line_key(F.col("line")).alias("line"))
    return keyed.where(F.char_length("line") >= min_chars).select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "_key", "_hash", "pos"
    )


def batches_of(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` cut at quantiles of its key, in ascending order."""
    steps = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx("_key", steps, 10_000)).first()[0] or []))
    bounds = [None, *cuts, None]
    out = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = docs
        if low is not None:
            part = part.where(F.col("_key") > F.lit(low))
        if high is not None:
            part = part.where(F.col("_key") <= F.lit(high))
        out.append(part)
    return out


def repeated_lines(
    docs: DataFrame, min_chars: int = 10, batches: int = 4, fan: int = 2, buckets: int | None = None
) -> DataFrame:
    """What to drop of a document: _key, _hash, ``_n_gone`` lines, and ``_gone``, a byte ``1`` for each that goes.

    ``docs`` has _key, _text and _hash. The bytes end with the last line that goes.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = Runs(docs, fan, buckets)
    try:
        found = dropped_places(docs, runs, min_chars, batches)
        places = found.groupBy("_key", "_hash").agg(F.sort_array(F.collect_set("pos")).alias("at"))
        # zeros up to each place, then a one: as long as the text has lines, in one go
        before = lambda k: F.when(k > 0, F.get("at", k - 1) + 1).otherwise(F.lit(0))
        marks = F.transform("at", lambda at, k: F.concat(F.repeat(F.lit("0"), at - before(k)), F.lit("1")))
        bits = F.array_join(marks, "").cast("binary").alias("_gone")
        return stored(places.select("_key", "_hash", F.size("at").cast("long").alias("_n_gone"), bits))
    finally:
        runs.forget()


def dropped_places(docs: DataFrame, runs: Runs, min_chars: int, batches: int) -> DataFrame:
    """``_key``, ``_hash`` and ``pos`` of each line that an earlier document has."""
    dropped = []
    for batch in batches_of(docs, batches):
        lines = stored(document_lines(batch, min_chars))
        # written, as the anti joins would else be moved below the counting and meet a hot line's every row
        firsts = stored(lines.groupBy("h1", "h2").agg(F.min("_key").alias("first")))
        added = runs.add(runs.unseen(runs.dealt(firsts)))
        # joined on the document too, so that a line of many documents is spread by document
        keepers = added.select("h1", "h2", F.col("first").alias("_key"))
        dropped.append(lines.join(keepers, ["h1", "h2", "_key"], "left_anti").select("_key", "_hash", "pos"))
    found = dropped[0]
    for part in dropped[1:]:
        found = found.unionByName(part)
    return found


def line_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, fan: int = 2
) -> DataFrame:
    """One row per row of ``docs``: key, n_lines, n_dropped, and the kept text."""
    body = text_or_empty(text)
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_key"),
        F.col(key),
        body.alias("_text"),
        F.xxhash64(body).alias("_hash"),
    )
    gone = repeated_lines(rows.select("_key", "_text", "_hash"), min_chars, batches, fan)
    lines = F.split("_text", "\n", -1)
    both = rows.join(gone, ["_key", "_hash"], "left")
    one = F.lit(b"1")
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.array_join(F.filter(lines, lambda _, i: F.substr("_gone", i + 1, F.lit(1)) != one), "\n")
    )
    return both.select(
        F.col(key),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("_n_gone", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
