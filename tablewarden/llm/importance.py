"""Importance resampling towards a target: documents are drawn as their word pairs are likelier in the target.

Features are hashed runs of one and two words. A dictionary of distinct words, each between two delimiters and with
its CRC-32 and length as payload, is compiled to an Aho-Corasick automaton. One scan of a stretch of folded texts
emits the payload of every word; the bucket of a word is its CRC, that of a pair follows from two adjacent payloads
alone: ``crc(a + " " + b)`` is ``crc(a + " ")`` moved on by the length of ``b`` (a linear map of bits), combined with
``crc(b)``. The dictionary is made of a bounded sample of the words and only saves time: a word that it lacks is the
gap between two hits, and its CRC is computed where it stands, so every word of every text counts.

One pass counts buckets (each task sends one row per bucket in use), one pass scores, and the ranks come from a range
sort of light rows, with a running count over its partitions; no task sees all scores.

Defined results: NULL and empty texts have no features, weigh 0 and are not drawn. Rows of one key and one score are
ranked in an order of their own, NULL keys last (their key is written as nothing in the hash). An empty table gives
an empty result, an empty target has no features. Texts of any length are cut between words into stretches. Other
columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import stored
from tablewarden.llm.words import column

BUCKETS = 10_000
#: Words of the dictionary, the longest of them in bytes, and the bytes of text they are gathered from.
DICTIONARY, WORD_BYTES, SAMPLE_BYTES = 65_536, 32, 64_000_000
#: Bytes of text that are scanned together; longer texts are cut.
CHUNK_BYTES = 1_000_000
#: Up to this length in bytes the map that moves a CRC on is kept as tables.
TABLED = 64

#: A-Z to a-z, and every other byte that is no ASCII digit or letter and below 0x80 to a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def byte_steps() -> np.ndarray:
    """What a CRC-32 register becomes when a zero byte is fed to its low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


STEP = byte_steps()


def with_space(crc: np.ndarray) -> np.ndarray:
    """CRCs of the same texts with a space after them."""
    register = ~crc
    return ~(STEP[(register ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (register >> np.uint32(8)))


@lru_cache(maxsize=TABLED)
def moving(length: int) -> np.ndarray:
    """Four tables of 256: the parts of a CRC, byte by byte, moved on by ``length`` bytes."""
    tables = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(length):
        tables = STEP[tables & np.uint32(0xFF)] ^ (tables >> np.uint32(8))
    return tables


def pair_crcs(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of ``a + " " + b`` from those of ``a`` and ``b`` and the bytes of ``b``, none above ``TABLED``."""
    out, open_ = second.copy(), with_space(first)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        crc, tables = open_[at], moving(int(n))
        for part in range(4):
            out[at] ^= tables[part][(crc >> np.uint32(8 * part)) & np.uint32(0xFF)]
    return out


@lru_cache(maxsize=2)
def automaton(words: tuple[bytes, ...]):
    """Words between delimiters, each with ``length << 32 | crc``; bytes are written as Latin-1 letters."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for word in words:
        out.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | zlib.crc32(word))
    out.make_automaton()
    return out


def scan(texts: list[bytes], words: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of folded texts, of each word's pair with the one before, and where texts begin.

    The first word of a text has -1 as its pair.
    """
    blob = b" " + b"  ".join(texts) + b" "
    starts = np.cumsum([1, *(len(t) + 2 for t in texts)])[:-1]
    inside = np.frombuffer(blob, np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    first = np.searchsorted(begin, [*starts, len(blob)])
    crc, length = np.zeros(len(begin), np.uint32), np.zeros(len(begin), np.int64)
    if words:
        # the last letter of a hit is the delimiter after its word
        hits = np.fromiter(chain.from_iterable(automaton(words).iter(blob.decode("latin-1"))), np.int64).reshape(-1, 2)
        at = np.searchsorted(end, hits[:, 0])
        crc[at], length[at] = (hits[:, 1] & 0xFFFFFFFF).astype(np.uint32), hits[:, 1] >> 32
    gaps = np.flatnonzero(length == 0)
    for k, b, e in zip(gaps.tolist(), begin[gaps].tolist(), end[gaps].tolist(), strict=True):
        crc[k], length[k] = zlib.crc32(blob[b:e]), e - b
    pairs = np.full(len(begin), -1, np.int64)
    inner = np.ones(len(begin), bool)
    inner[first[:-1][first[:-1] < len(begin)]] = False
    short = np.flatnonzero(inner & (length <= TABLED))
    pairs[short] = pair_crcs(crc[short - 1], crc[short], length[short]) % np.uint32(BUCKETS)
    for k in np.flatnonzero(inner & (length > TABLED)).tolist():
        opened = int(with_space(crc[k - 1 : k])[0])
        pairs[k] = zlib.crc32(blob[begin[k] : end[k]], opened) % BUCKETS
    return (crc % np.uint32(BUCKETS)).astype(np.int64), pairs, first


def cut(text: bytes, limit: int) -> Iterator[tuple[bytes, bool]]:
    """Stretches of a folded text; all but the first begin with the last word of the one before (and say so)."""
    if len(text) <= limit:
        yield text, False
        return
    at, again = 0, False
    while True:
        # the stretch ends behind a word; it holds at least one word that the one before did not
        new = at
        if again:
            while new < len(text) and text[new] != 0x20:
                new += 1
            while new < len(text) and text[new] == 0x20:
                new += 1
        stop = text.find(b" ", max(at + limit, new))
        stop = len(text) if stop < 0 else stop
        yield text[at:stop], again
        if not text[stop:].strip(b" "):
            return
        body = text[at:stop].rstrip(b" ")
        if body:
            at, again = at + body.rfind(b" ") + 1, True
        else:
            at, again = stop, False


def stretches(texts: pa.Array, limit: int) -> Iterator[tuple[list[int], list[bytes], list[bool]]]:
    """Folded texts in groups of about ``limit`` bytes: rows, stretches, and whether the first word was seen before."""
    rows, parts, seen, size = [], [], [], 0
    for d, text in enumerate(texts):
        folded = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(FOLD)
        for part, again in cut(folded, limit):
            rows.append(d)
            parts.append(part)
            seen.append(again)
            size += len(part)
            if size >= limit:
                yield rows, parts, seen
                rows, parts, seen, size = [], [], [], 0
    if rows:
        yield rows, parts, seen


def scans(texts: pa.Array, words: tuple[bytes, ...], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of stretches: row of each word, bucket of the word or -1 if counted before, bucket of its pair or -1."""
    for rows, parts, seen in stretches(texts, limit):
        single, pairs, first = scan(parts, words)
        repeated = first[:-1][np.array(seen) & (first[:-1] < first[1:])]
        single[repeated] = -1
        yield np.repeat(np.array(rows), np.diff(first)), single, pairs


def dictionary(docs: DataFrame, text: str, words: int = DICTIONARY, sample_bytes: int = SAMPLE_BYTES) -> tuple[bytes, ...]:
    """The words found most often in a sample of about ``sample_bytes``, at most ``words`` of them."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    share = min(1.0, sample_bytes / total) if total else 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
            seen.clear()
            return out

        for batch in batches:
            for _, parts, again in stretches(column(batch, text), CHUNK_BYTES):
                for part, known in zip(parts, again, strict=True):
                    seen.update(w for w in part.split()[known:] if len(w) <= WORD_BYTES)
                if len(seen) > 4 * DICTIONARY:
                    yield rows()
        if seen:
            yield rows()

    found = docs.select(text).sample(False, share, 7).mapInArrow(count, "word binary, n long")
    best = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return tuple(sorted(bytes(r["word"]) for r in best.collect()))


def bucket_counts(texts: DataFrame, text: str, words: tuple[bytes, ...]) -> dict[int, int]:
    """How often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, single, pairs in scans(column(batch, text), words, CHUNK_BYTES):
                total += np.bincount(single + 1, minlength=BUCKETS + 1) + np.bincount(pairs + 1, minlength=BUCKETS + 1)
        used = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[1:][used])], ["bucket", "n"])

    found = texts.select(text).mapInArrow(count, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, with one added to each, floored."""
    s_all, t_all = float(sum(source.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    ratio = (
        (target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all) for b in range(BUCKETS)
    )
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def luck(seed: int, key: str | None) -> int:
    """1000 times a Gumbel variate made of the SHA-256 of seed and key, floored."""
    h = int(hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, text: str, tag: str, words: tuple[bytes, ...], gain: np.ndarray, seed: int) -> DataFrame:
    """``n_words``, ``n_features``, ``weight`` and ``score`` in place of the text and of ``tag``, the key as text."""
    others = [c for c in docs.columns if c not in (text, tag)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = np.concatenate([gain, [0]])  # -1 is the last
        for batch in batches:
            n, features, total = (np.zeros(len(batch), np.int64) for _ in range(3))
            for rows, single, pairs in scans(column(batch, text), words, CHUNK_BYTES):
                np.add.at(n, rows, single >= 0)
                np.add.at(features, rows, (single >= 0).astype(np.int64) + (pairs >= 0))
                np.add.at(total, rows, by_bucket[single] + by_bucket[pairs])
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            drawn = np.array([luck(seed, k) for k in column(batch, tag).to_pylist()], np.int64)
            values = [pa.array(v, pa.int64()) for v in (n, features, weight, weight + drawn)]
            names = [*others, "n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in others), *values], names)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(others).schema)
    return docs.mapInArrow(score, f"{fields}n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` from 1: the highest ``score`` first, then the smallest key, then ``_row``."""
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("_row")]
    dealt = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_inside", inside).join(F.broadcast(bases), "_part")
    return out.withColumn("rank", F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 25, least_words: int = 20, seed: int = 7, words: int = DICTIONARY,
) -> DataFrame:
    """One row per document: key, n_words, n_features, weight, score, rank (NULL if not drawn).

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn (floored).
    """
    given = docs.select(
        F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(key).cast("string").alias("_tag")
    )
    wanted = target.select(F.col(target_text).cast("string").alias("_text"))
    known = dictionary(given, "_text", words)
    gain = gains(bucket_counts(given, "_text", known), bucket_counts(wanted, "_text", known))
    out = scored(given, "_text", "_tag", known, gain, seed)
    rows = stored(out.withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    ranks = ranked(rows.where(able), "_key").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    both = ranks.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return both.select(F.col("_key").alias(key), "n_words", "n_features", "weight", "score", F.col("rank").cast("long"))
