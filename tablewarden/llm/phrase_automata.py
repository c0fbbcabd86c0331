"""Substring deduplication by automata of repeated phrases.

Confirm: every window of ``window`` words is hashed; packed batches of hashes meet by bucket (see
:mod:`exchange`), which tells which windows also start elsewhere. The answers are bits, joined to the documents
by text. Texts that occur twice as a whole are found by their digest and need no bits. Compile and stream: for
each shard of documents the maximal runs of confirmed windows are its recurring passages; pyahocorasick
compiles them, one symbol a word, and all documents of the shard are streamed to locate every occurrence. A
shard has the passages of its own documents only, so the work stays in proportion to the corpus and an
automaton has at most as many nodes as its shard has words.

Defined results: NULL and empty text has no words and nothing is removed. Fewer words than a window: nothing
is removed. Rows with the same text are occurrences of one another, whatever their keys. An empty table gives
an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import exchange, words
from tablewarden.llm.common import stored, text_or_empty

#: Words of a passage.
WINDOW = 35
#: Bytes of documents in a shard.
SHARD_BYTES = 4_000_000
#: Code points a word can be given, without surrogates.
SYMBOLS = 0x110000 - 0x800 - 1

ASKED = "bucket int, k1 array<long>, k2 array<long>, counts array<int>, hashes array<long>, repeated array<long>, known array<binary>"
ANSWERED = "slice int, bucket int, k1 array<long>, k2 array<long>, bits array<binary>"
FLAGS = "k1 long, k2 long, _flags array<struct<bucket:int,bits:binary>>"
#: Stands for the bucket of what a batch found out by itself.
OWN = -1


def windows_of(part: words.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at each word, and whether it lies in one text; both as long as the words."""
    values, valid = np.zeros(len(part), np.uint64), np.zeros(len(part), bool)
    found = words.sequence_hashes(part.hashes(), window)
    values[: len(found)] = found
    valid[: len(found)] = words.inner_starts(part.first, window)
    return values, valid


def ask(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed questions of all batches; ``docs`` has k1, k2 and _text."""

    def chunk(k1: np.ndarray, k2: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        _, firsts, copies = np.unique(np.column_stack([k1, k2]), axis=0, return_index=True, return_counts=True)
        k1, k2 = k1[firsts], k2[firsts]
        part = words.words_of(texts.take(pa.array(firsts)), words.SPACED)
        values, valid = windows_of(part, window)
        at = np.flatnonzero(valid)
        values, document = values[at], part.document()[at]
        order, heads = exchange.grouped(values)
        size = np.diff(np.append(heads, len(values)))
        twice = np.zeros(len(values), bool)
        twice[order] = np.repeat(size > 1, size)
        twice |= copies[document] > 1
        repeated = np.unique(values[twice])
        single = np.flatnonzero(~twice)
        single = single[np.argsort(exchange.bucket_of(values[single], buckets), kind="stable")]
        # a header for each bucket and document
        bucket = exchange.bucket_of(values[single], buckets)
        pair = bucket * len(k1) + document[single]
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        counts = np.diff(np.append(heads, len(single)))
        owner, of = document[single][heads], bucket[heads]
        every = np.arange(buckets + 1)
        header, entry = np.searchsorted(of, every), np.searchsorted(bucket, every)
        repeated = repeated[np.argsort(exchange.bucket_of(repeated, buckets), kind="stable")]
        shared = np.searchsorted(exchange.bucket_of(repeated, buckets), every)
        # what this batch knows already, as bits over the windows of a document that is no copy
        told = [d for d in np.unique(document[twice]) if copies[d] == 1]
        ends = np.searchsorted(document, np.arange(len(k1) + 1))
        bits = [np.packbits(twice[ends[d] : ends[d + 1]]).tobytes() for d in told]
        none = [[]] * buckets
        asked = pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(buckets), pa.int32()),
                exchange.lists(k1[owner], header, pa.int64()),
                exchange.lists(k2[owner], header, pa.int64()),
                exchange.lists(counts, header, pa.int32()),
                exchange.lists(exchange.signed(values[single]), entry, pa.int64()),
                exchange.lists(exchange.signed(repeated), shared, pa.int64()),
                pa.array(none, pa.list_(pa.binary())),
            ],
            NAMES,
        )
        if not told:
            return [asked]
        nothing = pa.array([[]], pa.list_(pa.int64()))
        known = pa.RecordBatch.from_arrays(
            [
                pa.array([int(k1[told[0]] % buckets)], pa.int32()),
                pa.array([k1[told].tolist()], pa.list_(pa.int64())),
                pa.array([k2[told].tolist()], pa.list_(pa.int64())),
                pa.array([[]], pa.list_(pa.int32())),
                nothing,
                nothing,
                pa.array([bits], pa.list_(pa.binary())),
            ],
            NAMES,
        )
        return [asked, known]

    NAMES = ["bucket", "k1", "k2", "counts", "hashes", "repeated", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(words.column(batch, c)) for c in ("k1", "k2"))
            texts = words.column(batch, "_text")
            for a, b in words.slices(texts, exchange.CHUNK_BYTES):
                yield from chunk(k1[a:b], k2[a:b], texts.slice(a, b - a))

    return docs.select("k1", "k2", "_text").mapInArrow(run, ASKED)


def answer(table: pa.Table, buckets: int) -> pa.Table:
    """For one bucket: of each document that asked, a bit per hash that also occurs elsewhere."""
    bucket = table["bucket"][0].as_py()
    asked = np.asarray(table["known"].combine_chunks().value_lengths()) == 0
    own = table.filter(pa.array(~asked))
    table = table.filter(pa.array(asked))
    hashes, _ = exchange.flat(table["hashes"])
    repeated, _ = exchange.flat(table["repeated"])
    k1, _ = exchange.flat(table["k1"])
    k2, _ = exchange.flat(table["k2"])
    counts, _ = exchange.flat(table["counts"])
    both = np.concatenate([hashes, repeated])
    order, heads = exchange.grouped(both)
    size = np.diff(np.append(heads, len(both)))
    found = np.zeros(len(both), bool)
    found[order] = np.repeat(size > 1, size)
    found = found[: len(hashes)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(found)])
    hit = np.flatnonzero(total[ends[1:]] > total[ends[:-1]])
    bits = [np.packbits(found[ends[i] : ends[i + 1]]).tobytes() for i in hit]
    own1, n = exchange.flat(own["k1"])
    own2, _ = exchange.flat(own["k2"])
    known = [b for row in own["known"].to_pylist() for b in row]
    parts = [(bucket, k1[hit], k2[hit], bits), (OWN, own1, own2, known)]
    return pa.concat_tables([packed_answers(*part, buckets) for part in parts])


def packed_answers(bucket: int, k1: np.ndarray, k2: np.ndarray, bits: list[bytes], slices: int) -> pa.Table:
    """Answers in a row per slice of the documents."""
    to = exchange.bucket_of(k1.astype(np.int64).view(np.uint64), slices)
    order = np.argsort(to, kind="stable")
    used, heads = np.unique(to[order], return_index=True)
    ends = np.append(heads, len(order)) if len(used) else np.zeros(1, np.int64)
    values = pa.array(bits, pa.binary()).take(pa.array(order, pa.int64()))
    return pa.table(
        {
            "slice": pa.array(used, pa.int32()),
            "bucket": pa.array(np.full(len(used), bucket), pa.int32()),
            "k1": exchange.lists(k1[order], ends, pa.int64()),
            "k2": exchange.lists(k2[order], ends, pa.int64()),
            "bits": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
        }
    )


def by_text(table: pa.Table) -> pa.Table:
    """For one slice of the documents: all answers to a text in one row."""
    k1, n = exchange.flat(table["k1"])
    k2, _ = exchange.flat(table["k2"])
    bucket = np.repeat(np.asarray(table["bucket"]), n)
    bits = pa.concat_arrays([c.flatten() for c in table["bits"].chunks])
    order = np.lexsort((bucket, k2, k1))
    k1, k2 = k1[order], k2[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    heads = np.flatnonzero(fresh)
    kind = [pa.field("bucket", pa.int32()), pa.field("bits", pa.binary())]
    answers = pa.StructArray.from_arrays(
        [pa.array(bucket[order], pa.int32()), bits.take(pa.array(order, pa.int64()))], fields=kind
    )
    ends = pa.array(np.append(heads, len(order)), pa.int32())
    return pa.table(
        {"k1": k1[heads], "k2": k2[heads], "_flags": pa.ListArray.from_arrays(ends, answers)}
    )


def confirmed(part: words.Words, copied: list, flags: list, window: int, buckets: int) -> np.ndarray:
    """Truth per word: a window that recurs starts there."""
    values, valid = windows_of(part, window)
    out = np.zeros(len(part), bool)
    for d, (whole, told) in enumerate(zip(copied, flags, strict=True)):
        a, b = int(part.first[d]), int(part.first[d + 1]) - window + 1
        if b <= a:
            continue
        if whole:
            out[a:b] = True
        elif told:
            by = {t["bucket"]: np.unpackbits(np.frombuffer(t["bits"], np.uint8)).astype(bool) for t in told}
            mask = by[OWN][: b - a].copy() if OWN in by else np.zeros(b - a, bool)
            open_ = np.flatnonzero(~mask)
            bucket = exchange.bucket_of(values[a:b][open_], buckets)
            for k, bits in by.items():
                if k != OWN:
                    here = open_[bucket == k]
                    mask[here] |= bits[: len(here)]
            out[a:b] = mask
    return out & valid


def symbol_text(symbols: np.ndarray, wide: bool) -> str:
    """One code point a word, or two where there are more words than code points."""
    if wide:
        symbols = np.column_stack([symbols // SYMBOLS, symbols % SYMBOLS]).ravel()
    points = symbols + 1
    points = np.where(points >= 0xD800, points + 0x800, points)
    return points.astype("<u4").tobytes().decode("utf-32-le")


def locate(part: words.Words, starts: np.ndarray, window: int) -> np.ndarray:
    """Truth per word: it lies in an occurrence of a recurring passage of this shard."""
    edges = np.zeros(len(part) + 1, np.int64)
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(len(part), bool)
    distinct, symbols = np.unique(part.hashes(), return_inverse=True)
    wide = len(distinct) > SYMBOLS
    step = 1 + wide
    document = np.searchsorted(part.first, at, side="right")
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(document) > 0)) + 1
    automaton = ahocorasick.Automaton()
    for run in np.split(at, cuts):
        phrase = symbol_text(symbols[run[0] : run[-1] + window], wide)
        automaton.add_word(phrase, len(phrase) // step)
    automaton.make_automaton()
    for a, b in zip(part.first[:-1].tolist(), part.first[1:].tolist(), strict=True):
        if b - a >= window:
            for last, size in automaton.iter(symbol_text(symbols[a:b], wide)):
                if wide and last % 2 == 0:
                    continue
                stop = a + last // step + 1
                edges[stop - size] += 1
                edges[stop] -= 1
    return np.cumsum(edges)[:-1] > 0


def stream(docs: DataFrame, key: str, window: int, buckets: int) -> DataFrame:
    """Compiles and streams shard by shard: key, n_words, n_removed, kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.column(batch, "_text")
            for a, b in words.slices(texts, SHARD_BYTES):
                some = texts.slice(a, b - a)
                part = words.words_of(some, words.SPACED)
                copied = words.column(batch, "_copied").slice(a, b - a).to_pylist()
                flags = words.column(batch, "_flags").slice(a, b - a).to_pylist()
                gone = locate(part, confirmed(part, copied, flags, window, buckets), window)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[part.first[1:]] - total[part.first[:-1]]
                kept = []
                for d, text in enumerate(some.cast(pa.large_binary()).to_pylist()):
                    own = text.split()
                    if removed[d]:
                        keep = ~gone[part.first[d] : part.first[d + 1]]
                        own = [w for w, stays in zip(own, keep.tolist(), strict=True) if stays]
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        words.column(batch, key).slice(a, b - a),
                        pa.array(part.counts.astype(np.int64)),
                        pa.array(removed.astype(np.int64)),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    [key, "n_words", "n_removed", "kept_text"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept_text string")


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, buckets: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, and the kept words joined by single spaces."""
    given = docs.select(F.col(key), text_or_empty(text).alias("_text"))
    given = given.withColumns({"k1": F.xxhash64("_text"), "k2": F.xxhash64(F.lit("second"), "_text")})
    buckets = buckets or exchange.buckets_for(given, "_text")
    copied = stored(given.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"))
    answers = ask(given, window, buckets).groupBy("bucket").applyInArrow(lambda t: answer(t, buckets), ANSWERED)
    flags = stored(answers.groupBy("slice").applyInArrow(by_text, FLAGS))  # a row per text
    flags = flags.join(copied, ["k1", "k2"], "left_anti")
    marks = flags.withColumn("_copied", F.lit(False)).unionByName(
        copied.withColumn("_copied", F.lit(True)), allowMissingColumns=True
    )
    return stream(given.join(marks, ["k1", "k2"], "left"), key, window, buckets)
