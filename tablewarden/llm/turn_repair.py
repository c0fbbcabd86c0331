"""Repair of conversations: the cheapest edits that give turns the order system?, (user, assistant)+.

Rows of a conversation follow ``turn`` (NULL first), then role, then the MD5 of role and text. A row's first fault
counts: blank text, duplicate of an earlier row (role and text), truncated (no ``.``, ``!`` or ``?`` at the end).
Blank and duplicate rows must go. :mod:`edit_grammar` has the costs and finds the edits; its rules are learned from
the commonest sequences of a bounded sample and only save time.

Conversations are dealt by key and sorted, and a task works on one after the other as they stream by. Those of more
than ``long_rows`` rows or ``long_bytes`` of text take another way to the same rows: a range sort over all their
rows splits them, duplicates are found by aggregation, each task turns its stretch into a text of symbols (a byte
for a row, as much as the audit itself takes), and edits go back to the rows by position. Only the SHA-256 of a
repaired conversation is one chain over its bytes, which one task streams.

Defined results: NULL roles and texts are one space; NULL keys are one conversation. Without rows a conversation has
zeros, an empty audit and the hash of nothing. Very long texts are handled as they are. Repeated rows are duplicates.
An empty table gives an empty result; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import edit_grammar as eg
from tablewarden.llm.common import WHITE, stored
from tablewarden.llm.words import column

#: Rows and text bytes of a conversation above which its rows are spread over tasks.
LONG_ROWS, LONG_BYTES = 5_000, 16_000_000
#: Rows of the sample that rules are learned from, and its commonest sequences that are looked at.
SAMPLE_ROWS, SAMPLE_SEQUENCES = 200_000, 2_000
#: Symbols of a stretch at most.
STRETCH = 100_000
#: Rows a task looks at together.
TOGETHER = 2_000

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
RESULT = f"{COUNTS}, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32(``conv:turn``) modulo 20; ``present`` is false for rows that are dropped."""
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank)
    )
    given = rows.select(
        F.col(conv), F.col(turn), F.coalesce(role, blank).alias(role), F.coalesce(text, blank).alias(text),
        (F.crc32(key) % 20).alias("_fault"),
    )
    fault = F.col("_fault")
    changed = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = given.select(
        conv, turn, F.when(fault == 4, F.lit("user")).otherwise(F.col(role)).alias(role), changed.alias(text),
        (fault != 0).alias("present"), F.explode(copies).alias("_copy"),
    )
    return out.drop("_copy")


def prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Plain names, faults that a row shows by itself, and the digest that orders and compares rows."""
    here = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    out = rows.select(
        F.col(conv).alias("_conv"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("_text"),
        here.alias("_here"),
    )
    end = F.rtrim("_text", F.lit(WHITE))
    sized = F.concat(F.octet_length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text"))
    return out.select(
        "*",
        (end == "").alias("_blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("_cut"),
        F.unhex(F.md5(sized)).alias("_digest"),
    )


def in_order() -> list:
    return [F.col("_conv"), F.asc_nulls_first("_turn"), F.col("_role"), F.col("_digest")]


class Tally:
    """What is counted along the rows of a conversation, or of a stretch of it."""

    def __init__(self):
        self.symbols: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.turn = None
        self.first = self.initial = None

    def add(self, turn, role: str, blank: bool, duplicate: bool, cut: bool) -> None:
        duplicate = duplicate and not blank
        cut = cut and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        else:
            self.first = initial
        self.initial = initial
        if turn is not None:
            self.distinct += turn != self.turn
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
        self.symbols.append(eg.symbol(role, blank, duplicate, cut))

    def join(self, other: dict) -> None:
        """The stretch that follows, as :meth:`record` wrote it."""
        self.blank += other["blank"]
        self.duplicate += other["duplicate"]
        self.truncated += other["truncated"]
        self.illegal += other["illegal"]
        if self.initial is not None:
            self.illegal += self.initial + other["first"] not in LEGAL
        self.initial = other["last"]
        if other["least"] is not None:
            self.distinct += other["distinct"] - (self.turn is not None and self.turn == other["least"])
            self.least = other["least"] if self.least is None else self.least
            self.most = self.turn = other["most"]
        self.symbols.append(other["symbols"])

    def record(self) -> list:
        return [
            "".join(self.symbols), self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.initial,
            self.distinct, self.least, self.most,
        ]

    def counts(self) -> list[int]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def edits_of(roles: list[str], audit: str) -> Iterator[tuple[int, str, str]]:
    """Row (the one after, for inserts), edit and role of the result, for all edits but deletions."""
    at, state = 0, 0
    for edit in audit:
        if edit == eg.INSERT:
            role, state = eg.inserted(state)
            yield at, edit, role
            continue
        if edit == eg.REROLE:
            role, state = eg.inserted(state)
            yield at, edit, role
        elif edit == eg.KEEP:
            state = eg.kept(roles[at], state)
            yield at, edit, roles[at]
        at += 1


def conversations(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """Keys and rows of conversations that come one after the other; rows that are not there are left out."""
    open_, key, rows = False, None, []
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            part = batch.slice(at, TOGETHER)
            values = [column(part, n).to_pylist() for n in ("_conv", "_here", *names)]
            for conv, here, *row in zip(*values, strict=True):
                if not open_ or conv != key:
                    if open_:
                        yield key, rows
                    open_, key, rows = True, conv, []
                if here:
                    rows.append(row)
    if open_:
        yield key, rows


NOTHING = hashlib.sha256(b"").hexdigest()


def tallied(rows: list[tuple]) -> Tally:
    tally, seen = Tally(), set()
    for turn, role, blank, cut, digest, *_ in rows:
        tally.add(turn, role, blank, digest in seen, cut)
        seen.add(digest)
    return tally


def learned(rows: DataFrame) -> tuple[str, ...]:
    """Rules from the commonest sequences of some whole conversations."""
    total = rows.count()
    share = min(1.0, SAMPLE_ROWS / total) if total else 1.0
    some = rows.where(F.pmod(F.xxhash64("_conv"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    names = ["_turn", "_role", "_blank", "_cut", "_digest"]
    light = some.select("_conv", "_here", *names).repartition("_conv").sortWithinPartitions(*in_order())

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, found in conversations(batches, names):
            out.append("".join(tallied(found).symbols))
            if len(out) == TOGETHER:
                yield pa.RecordBatch.from_pydict({"symbols": out})
                out = []
        yield pa.RecordBatch.from_pydict({"symbols": pa.array(out, pa.string())})

    found = light.mapInArrow(sequences, "symbols string").groupBy("symbols").count()
    found = found.where(F.length("symbols") > 1).orderBy(F.desc("count"), "symbols").limit(SAMPLE_SEQUENCES)
    return eg.learn_rules((r["symbols"], r["count"]) for r in found.collect())


def repaired(rows: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Conversations of bounded size, each in one go."""
    kind = rows.schema["_conv"].dataType
    names = ["_turn", "_role", "_blank", "_cut", "_digest", "_text"]
    schema = pa.schema([(f, pa.int64()) for f in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    fields = [*(f.name for f in schema), "audit", "repaired_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, out, keys, key_type = eg.grammar(rules), [], [], None

        def packed():
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *arrays], ["_conv", *fields])

        def seen(given):
            nonlocal key_type
            for batch in given:
                key_type = column(batch, "_conv").type
                yield batch

        for key, found in conversations(seen(batches), names):
            tally = tallied(found)
            cost, audit = tool.solve("".join(tally.symbols))
            lines = [
                f"{role}:{'' if edit == eg.INSERT else found[at][5]}"
                for at, edit, role in edits_of([r[1] for r in found], audit)
            ]
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            out.append([*tally.counts(), cost, audit, digest])
            keys.append(key)
            if len(out) == TOGETHER:
                yield packed()
                out, keys = [], []
        if out:
            yield packed()

    dealt = rows.repartition("_conv").sortWithinPartitions(*in_order())
    return dealt.mapInArrow(work, f"_conv {kind.simpleString()}, {RESULT}")


STRETCHES = (
    "symbols string, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "distinct long, least long, most long"
)


def stretched(light: DataFrame) -> DataFrame:
    """One row per stretch of a conversation whose rows lie next to each other: ``_conv``, ``_pos`` and its tally."""
    kind = light.schema["_conv"].dataType.simpleString()
    names = ["_pos", "_turn", "_role", "_blank", "_again", "_cut"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key_type = [], None
        open_, key, begin, tally = False, None, 0, Tally()

        def packed():
            columns = list(zip(*out, strict=True))
            types = [key_type, pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.string()] * 2, *[pa.int64()] * 3]
            fields = ["_conv", "_pos", *(f.strip().split(" ")[0] for f in STRETCHES.split(","))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

        for batch in batches:
            key_type = column(batch, "_conv").type
            for at in range(0, len(batch), TOGETHER):
                part = batch.slice(at, TOGETHER)
                for conv, pos, turn, role, blank, again, cut in zip(
                    *(column(part, n).to_pylist() for n in ("_conv", *names)), strict=True
                ):
                    n = len(tally.symbols)
                    if not open_ or conv != key or pos != begin + n or n >= STRETCH:
                        if open_:
                            out.append([key, begin, *tally.record()])
                        open_, key, begin, tally = True, conv, pos, Tally()
                    tally.add(turn, role, blank, again, cut)
                if len(out) >= TOGETHER:
                    yield packed()
                    out = []
        if open_:
            out.append([key, begin, *tally.record()])
            yield packed()

    return light.mapInArrow(work, f"_conv {kind}, _pos long, {STRETCHES}")


def solved(stretches: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Counts, cost, audit and ``edits`` (position, edit, inserted roles before, role) of each conversation."""
    fields = [f for f in stretches.columns if f not in ("_conv", "_pos")]
    kind = stretches.schema["_conv"].dataType.simpleString()
    lists = stretches.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_pos", *fields))).alias("parts"))
    edit = "array<struct<pos:long, edit:string, before:array<string>, after:array<string>, role:string>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = eg.grammar(rules)
        for batch in batches:
            for at in range(len(batch)):
                parts = column(batch, "parts")[at].as_py()
                tally, places = Tally(), []
                for part in parts:
                    tally.join(part)
                    places.append((part["_pos"], len(part["symbols"])))
                symbols = "".join(tally.symbols)
                cost, audit = tool.solve(symbols)
                key = column(batch, "_conv").slice(at, 1)
                numbers = [pa.array([v], pa.int64()) for v in (*tally.counts(), cost)]
                changes = pa.array([list(changed(symbols, audit, places))], EDITS)
                yield pa.RecordBatch.from_arrays(
                    [key, *numbers, pa.array([audit]), changes],
                    ["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits"],
                )

    return lists.mapInArrow(work, f"_conv {kind}, {COUNTS}, cost long, audit string, edits {edit}")


EDITS = pa.list_(
    pa.struct(
        [
            ("pos", pa.int64()), ("edit", pa.string()), ("before", pa.list_(pa.string())),
            ("after", pa.list_(pa.string())), ("role", pa.string()),
        ]
    )
)


def changed(symbols: str, audit: str, places: list[tuple[int, int]]) -> Iterator[dict]:
    """The rows that do not stay as they are: what is inserted before (after the last: behind) them, and their new role."""
    where = (first + i for first, n in places for i in range(n))
    state, before, at, held = 0, [], -1, None
    for edit in audit:
        if edit == eg.INSERT:
            role, state = eg.inserted(state)
            before.append(role)
            continue
        if held is not None:
            yield held
            held = None
        at += 1
        pos, role = next(where), None
        if edit == eg.REROLE:
            role, state = eg.inserted(state)
        elif edit == eg.KEEP:
            state = eg.kept(symbols[at].lower(), state)
        plain = edit == eg.KEEP and not before
        held = {"pos": pos, "edit": edit, "before": before, "after": [], "role": role}
        before = []
        if plain and at < len(symbols) - 1:
            held = None
    if held is not None:
        held["after"] = before
        yield held


def long_repaired(rows: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """The same for conversations of any length, whose rows are spread over tasks."""
    here = rows.where("_here").drop("_here")
    dealt = here.repartitionByRange(*in_order()).sortWithinPartitions(*in_order())
    rows_at = stored(dealt.withColumn("_pos", F.monotonically_increasing_id()))
    seen = rows_at.groupBy("_conv", "_digest").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    seen = seen.where(F.col("_n") > 1).select(F.col("_conv").alias("_c"), F.col("_digest").alias("_d"), "_first")
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_digest") == F.col("_d"))
    again = F.coalesce(F.col("_pos") != F.col("_first"), F.lit(False)).alias("_again")
    light = rows_at.drop("_text").join(seen, same, "left")
    light = light.select("_conv", "_pos", "_turn", F.left("_role", F.lit(1)).alias("_role"), "_blank", "_cut", again)
    ordered = light.repartitionByRange("_pos").sortWithinPartitions("_pos")
    found = stored(solved(stretched(ordered), rules))

    edits = found.select(F.explode("edits").alias("e")).select(F.col("e.pos").alias("_pos"), "e.edit", "e.before", "e.after", "e.role")
    lines = rows_at.select("_conv", "_pos", "_role", "_text").join(edits, "_pos", "left")
    empty = F.array().cast("array<string>")
    opened = F.transform(F.coalesce("before", empty), lambda r: F.concat(r, F.lit(":")))
    closed = F.transform(F.coalesce("after", empty), lambda r: F.concat(r, F.lit(":")))
    own = F.array(F.concat(F.coalesce("role", "_role"), F.lit(":"), F.col("_text")))
    own = F.when(F.coalesce("edit", F.lit(eg.KEEP)) == eg.DELETE, empty).otherwise(own)
    lines = lines.select("_conv", "_pos", F.concat(opened, own, closed).alias("lines")).where(F.size("lines") > 0)
    hashes = chained(lines.select("_conv", "_pos", F.array_join("lines", "\n").alias("_line")))

    keys = rows.select("_conv").distinct()
    out = null_safe(keys, found.drop("edits"))
    out = null_safe(out, hashes)
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256")
    return out.select("_conv", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), sha)


def null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on ``_conv`` in which NULL meets NULL."""
    named = right.withColumnRenamed("_conv", "_c")
    return left.join(named, F.col("_conv").eqNullSafe(F.col("_c")), "left").drop("_c")


def chained(lines: DataFrame) -> DataFrame:
    """The SHA-256 of each conversation's lines, joined by a line break; one line at a time is held."""
    kind = lines.schema["_conv"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key, chain, keys, out, key_type = False, None, hashlib.sha256(), [], [], None
        for batch in batches:
            key_type = column(batch, "_conv").type
            for at in range(0, len(batch), TOGETHER):
                part = batch.slice(at, TOGETHER)
                for conv, line in zip(column(part, "_conv").to_pylist(), column(part, "_line").to_pylist(), strict=True):
                    if open_ and conv == key:
                        chain.update(b"\n")
                    else:
                        if open_:
                            keys.append(key)
                            out.append(chain.hexdigest())
                        open_, key, chain = True, conv, hashlib.sha256()
                    chain.update(line.encode())
        if open_:
            keys.append(key)
            out.append(chain.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(out)], ["_conv", "repaired_sha256"])

    dealt = lines.repartition("_conv").sortWithinPartitions("_conv", "_pos")
    return dealt.mapInArrow(work, f"_conv {kind}, repaired_sha256 string")


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """One row per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``present`` names a column that is false for rows that only say that the conversation exists.
    """
    given = prepared(rows, conv, turn, role, text, present)
    sizes = given.groupBy("_conv").agg(F.count("*").alias("_n"), F.sum(F.octet_length("_text").cast("long")).alias("_b"))
    longs = stored(sizes.where((F.col("_n") > long_rows) | (F.col("_b") > long_bytes)).select(F.col("_conv").alias("_c")))
    is_long = F.col("_conv").eqNullSafe(F.col("_c"))
    short = given.join(longs, is_long, "left_anti")
    rules = learned(short)
    out = repaired(short, rules)
    if not longs.isEmpty():
        out = out.unionByName(long_repaired(given.join(longs, is_long, "left_semi"), rules))
    return out.withColumnRenamed("_conv", conv)
