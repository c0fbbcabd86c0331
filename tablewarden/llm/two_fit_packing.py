"""Best-two-fit packing: whole documents into as few sequences as possible, cut only where one is too long.

A bin is filled greedily, always with the longest document that still fits. Then its shortest document gives way
to two unpacked ones whose sum fits the widened gap more tightly, as long as there are such two. All that matters
to this rule is how many documents of each length are left, so :func:`plan` works on those counts (at most one for
each length up to that of a sequence, however large the corpus) and makes a bin once together with its number of
repeats: a bin comes out the same until one of the lengths that its making touched runs short.

Spark does the rest: tasks encode and cut the documents, a range sort over (length, row) numbers the pieces of a
length across its partitions, so that a length that a third of all documents share is many tasks' work, and each
piece reads its bin and place off the plan by that number.

Defined results: NULL and empty text is the closing id alone. Repeated rows are packed each, equal lengths in order
of their rows. An empty table gives an empty result; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import stored
from tablewarden.llm.words import column, slices

#: Bytes of text that are encoded together.
CHUNK_BYTES = 2_000_000
#: Words an encoder remembers (twice as many are held at most), and the longest one it does.
REMEMBERED, LONGEST = 300_000, 48
#: Where Python and the tokenizer do not agree on what white space is.
UNSURE = re.compile("[\x1c-\x1f]")
#: Printable ASCII and the Latin letters that no normal form changes and that have one lower case each.
LETTERS = [chr(c) for c in range(0x21, 0x250) if not 0x7F <= c <= 0xA0 and c != 0x130]
PLAIN = re.compile(f"[\t\n\v\f\r {re.escape(''.join(LETTERS))}]*")


class Memory(dict):
    """Packed ids by word; what is missing is encoded when first asked for. The older half is let go when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next free one."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_pattern(path: str) -> re.Pattern | None:
    """The pattern by which the tokenizer of a file cuts words, for plain lower-case texts."""
    with open(path, encoding="utf-8") as f:
        steps = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers", [])
    given = [s["pattern"].get("Regex") for s in steps if s["type"] == "Split" and s["invert"]]
    if not given or not given[0]:
        return None
    pattern = given[0]
    letters = sorted({x for c in LETTERS for x in (c, c.lower())})  # some lower cases lie beyond the plain ones
    for kind in "LN":
        members = "".join(re.escape(c) for c in letters if unicodedata.category(c)[0] == kind)
        pattern = pattern.replace(rf"\p{{{kind}}}", members)
    return None if r"\p" in pattern else re.compile(pattern)


class WordEncoder:
    """Token ids, as little-endian unsigned 32-bit bytes, by a tokenizer none of whose tokens has white space in it.

    Plain texts are cut into words by the tokenizer's own pattern, and the ids of words are remembered. Other texts
    are cut at white space; their plain stretches go the same way, the rest through the tokenizer as it is. Where a
    trial text gets other ids so, or the file names no pattern, the tokenizer gets whole texts.
    """

    TRIAL = " It's a trial,\n\n isn't  it? Größe   12,345\t(x_y)...\r\n日本 語 we'll Œuvre?!don't'd ½² "

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.words = Memory(self.word)
        self.pattern = None if any(re.search(r"\s", s) for s in self.special) else word_pattern(path)
        plain = self.TRIAL.replace("日本 語", "")
        if self.pattern and any(self.encode(t) != self.whole(t) for t in (self.TRIAL, plain)):
            self.pattern = None

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        named = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        return np.asarray([t.id for t in self.tokenizer.model.tokenize(named)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.pattern is None or UNSURE.search(text):
            return self.whole(text)
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            parts = text.split()
            if len(parts) == 1:
                return self.whole(text)
            return b"".join(map(self.encode, parts))
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower())))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECE = "piece int, start long, length long, ids_crc32 long"


def cut_documents(
    docs: DataFrame, tokenizer_path: str, key: str, text: str, length: int, closing: int, with_ids: bool
) -> DataFrame:
    """One row per piece of at most ``length`` ids: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = word_encoder(tokenizer_path)
        end = np.asarray([closing], "<u4").tobytes()
        for batch in batches:
            texts = column(batch, text)
            for a, b in slices(texts, CHUNK_BYTES):
                owner, place, size, sums, packed = [], [], [], [], []
                for d, t in enumerate(texts.slice(a, b - a).to_pylist()):
                    ids = tool.encode(t or "") + end
                    for at in range(0, len(ids), 4 * length):
                        part = ids[at : at + 4 * length]
                        owner.append(d)
                        place.append(at // 4)
                        size.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        packed.append(part)
                start = np.array(place, np.int64)
                columns = [
                    column(batch, key).slice(a, b - a).take(pa.array(owner, pa.int64())),
                    pa.array(start // length, pa.int32()),
                    pa.array(start),
                    pa.array(size, pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(packed), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(encode, f"`{key}` {kind}, {PIECE}" + ", ids array<int>" * with_ids)


def best_pair(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two lengths among those left with the largest sum up to ``room``; of equal sums, with the shortest one."""
    sizes = np.flatnonzero(left[: room + 1])
    short = sizes[sizes <= room // 2]
    if not len(short):
        return None
    at = np.searchsorted(sizes, room - short, side="right") - 1
    long = sizes[at]
    alone = (long == short) & (left[short] < 2)  # a length cannot be its own partner then
    total = np.where((long < short) | alone, -1, short + long)
    best = int(np.argmax(total))
    return None if total[best] < 0 else (int(short[best]), int(long[best]))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (documents per length, repeats), for so many documents of each length up to ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    bins = []
    while True:
        open_ = np.flatnonzero(left)
        if not len(open_):
            return bins
        gap, held, touched, rest = capacity, {}, {}, left.copy()

        def take(size: int, n: int, held=held, touched=touched, rest=rest) -> None:
            held[size] = held.get(size, 0) + n
            rest[size] -= n
            # the most of this length that were out of the pool at a time
            touched[size] = max(touched.get(size, 0), held[size])

        fits = open_
        while len(fits):
            size = int(fits[-1])
            n = int(min(gap // size, rest[size]))
            take(size, n)
            gap -= n * size
            fits = fits[: np.searchsorted(fits, min(gap, size - 1), side="right")]
        while gap:
            least = min(held)
            pair = best_pair(rest, gap + least)
            if pair is None or sum(pair) <= least:
                break
            held[least] -= 1
            if not held[least]:
                del held[least]
            rest[least] += 1
            for size in pair:
                take(size, 1)
            gap -= sum(pair) - least
        repeats = min(int(left[size]) // n for size, n in touched.items())
        for size, n in held.items():
            left[size] -= n * repeats
        bins.append((held, repeats))


def stretches_of(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """The plan by length: rows of length, first number, documents a bin, first bin, offset; sorted."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for held, repeats in bins:
        offset = 0
        for size in sorted(held, reverse=True):
            n = held[size]
            rows.append((size, used.get(size, 0), n, first, offset))
            used[size] = used.get(size, 0) + n * repeats
            offset += size * n
        first += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``_number``: the place of a row among those of its ``length``, in order of ``_row``."""
    dealt = stored(rows.repartitionByRange("length", "_row").withColumn("_part", F.spark_partition_id()))
    # a row per partition and length in it; as the sort is by length, little more than their sum
    sums = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", "length").orderBy("_row")
    ranked = dealt.withColumn("_inside", F.row_number().over(inside))
    return ranked.join(bases, ["_part", "length"]).withColumn("_number", F.col("_base") + F.col("_inside") - 1)


def placed(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` by ``length`` and ``_number``."""
    names = rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0].astype(np.uint64) << np.uint64(48)) | table[:, 1].astype(np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            size, number = (np.asarray(column(batch, c)) for c in ("length", "_number"))
            wanted = (size.astype(np.uint64) << np.uint64(48)) | number.astype(np.uint64)
            _, first, n, bin_, offset = table[np.searchsorted(keys, wanted, side="right") - 1].T
            since = number - first
            more = [pa.array(bin_ + since // n), pa.array(offset + since % n * size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "sequence_id", "offset"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    return rows.mapInArrow(place, f"{fields}sequence_id long, offset long")


def pack(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = 4096,
    closing: int = 1, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked).

    Documents of at most ``length`` ids are one piece. No sequence holds more than ``length`` ids; offsets in it have no gaps.
    """
    given = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    cut = cut_documents(given, tokenizer_path, key, "_text", length, closing, with_ids)
    rows = stored(cut.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``length`` rows
    light = numbered(rows.drop("ids"))
    out = placed(light, stretches_of(plan(counts, length)))
    wanted = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if with_ids:
        out, wanted = out.join(rows.select("_row", "ids"), "_row"), [*wanted, "ids"]
    return out.select(*wanted)
