"""Packing along a space-filling curve: documents of like content share training sequences.

Each document's token ids are hashed into a signed count vector, which fixed random directions project to a
few dimensions; the cell it falls into has a Hilbert key. Documents are range-sorted by that key and laid end
to end; the stream is cut every ``length`` tokens, so only the last sequence has padding. Positions come from
light rows (key and token count): a running sum inside each range partition plus the partitions' sums.

Defined results: NULL and empty text is the closing id alone. Equal keys keep the order of their rows.
Repeated rows are packed each. An empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import stored
from tablewarden.llm.words import column, slices

#: Bytes of text that are encoded together.
CHUNK_BYTES = 2_000_000
#: Up to here (the Latin blocks) both encoders' tables of letters and spaces are the same.
PLAIN = "\u0250"
#: Documents that are cut together.
PIECED = 1_000
#: Size of the hashed vectors, number of dimensions, bits of each.
VECTOR, DIMENSIONS, BITS = 1024, 4, 12


class Encoder:
    """Token ids of texts by a ``tokenizers`` file, as packed bytes.

    ``ranks``, if given, is the same vocabulary as a tiktoken file, and the pattern of its pre-tokens: plain
    texts get the same ids from it several times faster. Texts with other letters or with the string of a
    special token go through ``tokenizers``, and all do where the two disagree on a trial text.
    """

    TRIAL = "It's a trial, isn't it?  Größe\u00a0élan 12,345\n\n\tÑandú (x_y) ... \r\n end "

    def __init__(self, path: str, ranks: tuple[str, str] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks is not None:
            import tiktoken

            with open(ranks[0], "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            fast = tiktoken.Encoding("plain", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})
            if fast.encode_ordinary(self.TRIAL) == self.whole(self.TRIAL):
                self.fast = fast

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        plain = self.fast is not None and (text.isascii() or max(text) < PLAIN)
        if plain and not any(s in text for s in self.special):
            return self.packed(self.fast.encode_to_numpy(text))
        return self.packed(self.whole(text))


@lru_cache(maxsize=2)
def encoder(path: str, ranks: tuple[str, str] | None = None) -> Encoder:
    return Encoder(path, ranks)


@lru_cache(maxsize=1)
def directions() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).standard_normal((VECTOR, DIMENSIONS))


def projections(documents: list[np.ndarray]) -> np.ndarray:
    """Unit-norm signed hash vectors of token ids, projected: about standard normal in each dimension."""
    out = np.zeros((len(documents), DIMENSIONS))
    for d, ids in enumerate(documents):
        h = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        sign = 1.0 - 2.0 * (h >> np.uint32(31))
        vector = np.bincount((h >> np.uint32(8)) % np.uint32(VECTOR), sign, VECTOR)
        out[d] = vector @ directions() / max(np.sqrt(vector @ vector), 1e-9)
    return out


def cells(points: np.ndarray) -> np.ndarray:
    """The normal distribution's quantile of each coordinate, in 2**BITS steps."""
    share = 0.5 * (1 + np.vectorize(erf)(points / np.sqrt(2)))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows), all at once.

    From the top bit down, each dimension either flips or swaps the lower bits of the first one, which turns
    the sub-cube into its place on the curve; a Gray code then orders the bits.
    """
    x = cell.T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(
    docs: DataFrame, tokenizer_path: str, ranks: tuple[str, str] | None, closing: int, text: str
) -> DataFrame:
    """Adds ``_ids`` (packed), ``_width`` (bytes of an id), ``_n`` and ``_curve`` to the other columns."""
    others = [c for c in docs.columns if c != text]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer_path, ranks)
        end = tool.packed([closing])
        for batch in batches:
            texts = column(batch, text)
            for a, b in slices(texts, CHUNK_BYTES):
                packed = [tool.encode(t or "") + end for t in texts.slice(a, b - a).to_pylist()]
                arrays = [np.frombuffer(p, tool.dtype) for p in packed]
                curve = hilbert_keys(cells(projections(arrays)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(a, b - a).select(others).columns,
                        pa.array(packed, pa.binary()),
                        pa.array(np.full(b - a, tool.dtype.itemsize, np.int32)),
                        pa.array(np.array([len(x) for x in arrays], np.int64)),
                        pa.array(curve),
                    ],
                    [*others, "_ids", "_width", "_n", "_curve"],
                )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(others).schema)
    return docs.mapInArrow(encode, f"{fields}_ids binary, _width int, _n long, _curve long")


def places(rows: DataFrame) -> DataFrame:
    """``_row`` and ``_place``: the tokens before each row when rows follow the curve."""
    order = rows.select("_row", "_n", "_curve").repartitionByRange("_curve", "_row")
    dealt = stored(order.withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # a row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_curve", "_row").rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.select("_row", "_part", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_before"))
    return running.join(F.broadcast(bases), "_part").select("_row", (F.col("_base") + F.col("_before")).alias("_place"))


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(rows: DataFrame, key: str, length: int, with_ids: bool) -> DataFrame:
    """Cuts rows of ``key``, ``_ids``, ``_width``, ``_n`` and ``_place`` at the ends of sequences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECED) for b in batches for at in range(0, len(b), PIECED)):
            place, n = (np.asarray(column(batch, c)) for c in ("_place", "_n"))
            first = place // length
            count = (place + n - 1) // length - first + 1
            owner = np.repeat(np.arange(len(n)), count)
            sequence = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(sequence * length, place[owner])
            stop = np.minimum((sequence + 1) * length, (place + n)[owner])
            start, size = begin - place[owner], stop - begin
            ids, width = column(batch, "_ids"), np.asarray(column(batch, "_width"))
            sums, flat, held, wide = np.zeros(len(owner), np.int64), [], -1, np.zeros(0, "<u4")
            for i, d in enumerate(owner):
                if d != held:
                    held, wide = d, np.frombuffer(ids[int(d)].as_buffer(), f"<u{width[d]}").astype("<u4")
                    if with_ids:
                        flat.append(wide.view("<i4"))
                sums[i] = zlib.crc32(wide[start[i] : start[i] + size[i]])
            values = [start, size, sums, n[owner], sequence, begin - sequence * length]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [column(batch, key).take(pa.array(owner)), *(pa.array(v, pa.int64()) for v in values)]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(size)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat))))
            yield pa.RecordBatch.from_arrays(columns, [*names, *["ids"] * with_ids])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(cut, f"`{key}` {kind}, {PIECE}" + ", ids array<int>" * with_ids)


def pack(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = 1024,
    closing: int = 0, with_ids: bool = False, ranks: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per piece of a document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``ranks`` (a tiktoken file of the same vocabulary and its pattern) only makes it faster.
    """
    given = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    rows = stored(
        tokenised(given, tokenizer_path, ranks, closing, "_text").withColumn("_row", F.monotonically_increasing_id())
    )
    return pieces(rows.drop("_curve").join(places(rows), "_row"), key, length, with_ids)
