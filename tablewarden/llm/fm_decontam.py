"""Benchmark decontamination by an FM-index per shard of training documents.

A shard is a stretch of some documents. Its words become symbols of the benchmark's vocabulary; words the
benchmark lacks cannot lie in a match and end a run, and runs shorter than the shortest phrase are left out.
Over the runs that remain stands a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and
suffix positions sampled at every eighth place and at the starts of runs. All test phrases are searched
backward at once by wavelet ranks, their occurrences located by walks to sampled positions, and the spans
merged. Memory is bounded by the shard; the benchmark is taken in blocks of bounded size, one after the other.

Defined results: NULL and empty text has no words, no hits and is not contaminated. A benchmark item of fewer
words than a window, but not none, is one window; items with a NULL text have none. Items with a NULL id hit as others do;
together they are one item, a NULL in the list of items. Repeated rows are judged alike, and repeated item ids count once. An empty benchmark leaves every document clean; an empty table gives an empty
result. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import stored
from tablewarden.llm.words import LETTERED, Words, column, slices, words_of

#: Words of a window.
WINDOW = 10
#: Characters of benchmark text that are compiled to one block of phrases and broadcast (some 30 MB as arrays).
BLOCK_CHARS = 4_000_000
#: Bytes of documents in a shard.
SHARD_BYTES = 6_000_000
SAMPLE = 8


@dataclass
class Phrases:
    """Distinct windows of a block of items as symbols, by length, and the items that have them."""

    vocabulary: np.ndarray  # ascending word hashes; symbol = place + 1
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (windows x length symbols, item offsets, items)
    items: list[str | None]

    @property
    def shortest(self) -> int:
        return min((g[0].shape[1] for g in self.groups), default=0)


def compile_phrases(items: list[str], texts: list[str | None], window: int = WINDOW) -> Phrases:
    part = words_of(pa.array(texts, pa.string()), LETTERED, fold=True)
    vocabulary, symbols = np.unique(part.hashes(), return_inverse=True)
    symbols = (symbols + 1).astype(np.int32)
    by_length: dict[int, dict[bytes, set[int]]] = {}
    for i in range(len(items)):
        own = symbols[part.first[i] : part.first[i + 1]]
        size = min(len(own), window)
        for a in range(len(own) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(own[a : a + size].tobytes(), set()).add(i)
    groups = []
    for size, found in sorted(by_length.items()):
        windows = np.frombuffer(b"".join(found), np.int32).reshape(-1, size)
        owners = [sorted(x) for x in found.values()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
        groups.append((windows, offsets, np.array([i for x in owners for i in x])))
    return Phrases(vocabulary, groups, items)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane per bit of a symbol, with counts of zeros before each place."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.zeros, self.bits = [], bits
        for b in range(bits - 1, -1, -1):
            off = ((sequence >> b) & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(off, dtype=np.int32)]).astype(np.int32))
            sequence = np.concatenate([sequence[off], sequence[~off]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(place), place
        for level, zeros in enumerate(self.zeros):
            on = ((symbol >> (self.bits - 1 - level)) & 1) == 1
            low = np.where(on, zeros[-1] + low - zeros[low], zeros[low])
            high = np.where(on, zeros[-1] + high - zeros[high], zeros[high])
        return high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Zeros end runs: each differs from all others, in order of place."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        both = rank * (n + int(rank.max()) + 2) + after
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if rank.max() == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Counts and locates phrases in a sequence of runs; symbols from 1 up, zeros end runs."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.suffixes = suffix_array(text)
        self.before = text[self.suffixes - 1]  # the symbol before each suffix; the last one's is a zero
        self.tree = WaveletMatrix(self.before, max(int(symbols).bit_length(), 1))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        starts = np.concatenate([[True], text[:-1] == 0])
        kept = starts[self.suffixes] | (self.suffixes % SAMPLE == 0)
        self.sampled = np.where(kept, self.suffixes, -1)
        del self.suffixes

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window (a row of symbols) the range of suffixes that begin with it."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), len(self.before), np.int64)
        alive = np.arange(len(windows))
        for at in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, at]
            low[alive] = self.smaller[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        gone = np.ones(len(windows), bool)
        gone[alive] = False
        low[gone] = high[gone] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes, by steps backward to a sampled one."""
        place = np.full(len(rows), -1, np.int64)
        rows, steps = rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            found = self.sampled[rows[open_]]
            done = found >= 0
            place[open_[done]] = found[done] + steps
            open_ = open_[~done]
            symbol = self.before[rows[open_]]
            rows[open_] = self.smaller[symbol] + self.tree.rank(symbol, rows[open_])
            steps += 1
        return place


def occurrences(part: Words, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """Per length of phrases: word places of occurrences, the length, the number of the phrase in its group."""
    shortest = phrases.shortest
    if not shortest or not len(part):
        return
    h = part.hashes()
    at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == h
    # runs of known words inside one document
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    heads = part.first[:-1][part.counts > 0]
    opens[heads] = known[heads]
    run = np.cumsum(opens)
    size = np.bincount(run[known], minlength=int(run.max()) + 1 if len(run) else 1)
    places = np.flatnonzero(known & (size[run] >= shortest))
    if not len(places):
        return
    breaks = np.flatnonzero(np.diff(run[places]) != 0) + 1
    text = np.insert(at[places] + 1, breaks, 0)
    origin = np.insert(places, breaks, -1)
    text, origin = np.append(text, 0).astype(np.int64), np.append(origin, -1)
    index = FMIndex(text, len(phrases.vocabulary))
    for number, (windows, _, _) in enumerate(phrases.groups):
        low, high = index.search(windows)
        count = high - low
        phrase = np.repeat(np.arange(len(windows)), count)
        rows = np.repeat(low, count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
        yield origin[index.locate(rows)], windows.shape[1], phrase, number


SPANS = "array<struct<begin:int,end:int>>"
FOUND = f"n_words long, items array<string>, hits {SPANS}, spans {SPANS}"


def spans_in(text: bytes, part: Words, d: int, hit: np.ndarray) -> list[dict]:
    """Runs of hit words of document ``d`` as code point offsets of the text."""
    first, at = int(part.first[d]), np.flatnonzero(hit)
    out, done, chars = [], 0, 0
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        a, b = (int(x - part.rows[d]) for x in (part.begin[first + run[0]], part.end[first + run[-1]]))
        chars += len(text[done:a].decode())
        size = len(text[a:b].decode())
        out.append({"begin": chars, "end": chars + size})
        chars, done = chars + size, b
    return out


def search_block(docs: DataFrame, phrases: Phrases, text: str) -> DataFrame:
    """The other columns, n_words, the items found, hit word ranges and removal spans (code points)."""
    held = docs.sparkSession.sparkContext.broadcast(phrases)  # bounded by BLOCK_CHARS
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    others = [c for c in docs.columns if c != text]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        for batch in batches:
            texts = column(batch, text)
            for a, b in slices(texts, SHARD_BYTES):
                some = texts.slice(a, b - a)
                part = words_of(some, LETTERED, fold=True)
                edges = np.zeros(len(part) + 1, np.int64)
                items: list[set] = [set() for _ in range(b - a)]
                for place, size, phrase, number in occurrences(part, phrases):
                    np.add.at(edges, place, 1)
                    np.add.at(edges, place + size, -1)
                    document = np.searchsorted(part.first, place, side="right") - 1
                    _, offsets, owners = phrases.groups[number]
                    for d, p in np.unique(np.column_stack([document, phrase]), axis=0):
                        items[d].update(phrases.items[i] for i in owners[offsets[p] : offsets[p + 1]])
                hit = np.cumsum(edges)[:-1] > 0
                hits, spans = [], []
                for d in range(b - a):
                    own = hit[part.first[d] : part.first[d + 1]] if items[d] else hit[:0]
                    at = np.flatnonzero(own)
                    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
                    hits.append([{"begin": int(r[0]), "end": int(r[-1]) + 1} for r in runs])
                    spans.append(spans_in(some[d].as_py().encode(), part, d, own) if len(at) else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(a, b - a).select(others).columns,
                        pa.array(part.counts.astype(np.int64)),
                        pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string())),
                        pa.array(hits, span),
                        pa.array(spans, span),
                    ],
                    [*others, "n_words", "items", "hits", "spans"],
                )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(others).schema)
    return docs.mapInArrow(search, f"{fields}{FOUND}")


def blocks_of(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_CHARS) -> Iterator[Phrases]:
    """The benchmark's phrases, compiled from blocks of items chosen by hash."""
    known = benchmark.select(F.col(item).cast("string").alias("_item"), F.col(text).cast("string").alias("_text"))
    chars = known.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // most))
    for block in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block)
        rows = part.collect()  # about ``most`` characters
        yield compile_phrases([r[0] for r in rows], [r[1] for r in rows])


def merged_spans(spans):
    """A list of ranges with overlapping ones merged."""

    def add(done, x):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (last["end"] >= x["begin"])
        wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(rest, F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
    item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per row of ``docs``: columns ``keep``, n_words, items, hits (word ranges) and spans (code points to remove).

    Items with a NULL id hit like others, and together are one NULL in ``items``. A benchmark beyond one block takes
    a pass per block; blocks are compiled one after the other, and what each finds is written before the next.
    """
    keep = [c for c in keep]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_searched"))
    blocks = blocks_of(benchmark, item, item_text, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return search_block(given, first, "_searched")
    keyed = stored(given.withColumn("_numbered", F.monotonically_increasing_id()))
    lists = ("items", "hits", "spans")
    total, parts, block = stored(search_block(keyed, first, "_searched")), [], second
    del first, second
    while block is not None:
        more = search_block(keyed.select("_numbered", "_searched"), block, "_searched").where(F.size("hits") > 0)
        parts.append(stored(more.select("_numbered", *[F.col(c).alias(f"_{c}") for c in lists])))
        block = next(blocks, None)
    found = reduce(DataFrame.unionByName, parts).groupBy("_numbered")
    found = found.agg(*[F.flatten(F.collect_list(f"_{c}")).alias(f"_{c}") for c in lists])
    both = total.join(found, "_numbered", "left")
    every = {c: F.concat(F.col(c), F.coalesce(F.col(f"_{c}"), F.array())) for c in lists}
    return both.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", F.array_sort(F.array_distinct(every["items"])).alias("items"),
        merged_spans(every["hits"]).alias("hits"), merged_spans(every["spans"]).alias("spans"),
    )


def cut(text, spans):
    """The text without its spans; NULL stays NULL."""
    ends = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.length(text)))
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    kept = F.zip_with(begins, ends, lambda b, e: F.substr(text, b + 1, e - b))
    return F.when(text.isNotNull(), F.array_join(kept, ""))
