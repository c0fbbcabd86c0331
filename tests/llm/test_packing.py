"""Packing: an exact round trip, gapless sequences, and the curve itself."""

import zlib

import numpy as np
import pytest
from brute import SCHEMA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewarden.llm import curve_packing
from tablewarden.llm.queries import default_ranks, default_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def check_pieces(pieces, rows, tokenizer, length=1024):
    """Every id of every row is in exactly one piece, and sequences have no gaps."""
    expected = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows)
    streams = {}
    for p in pieces:
        streams.setdefault(p.sequence_id, []).append(p)
    assert sorted(streams) == list(range(len(streams)))
    sums = []
    for s in sorted(streams):
        at = 0
        for p in sorted(streams[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes())
        sums.append(at)
    assert all(n == length for n in sums[:-1]) and (not sums or 0 < sums[-1] <= length)
    # pieces of a document follow one another along the stream
    got, open_ = [], []
    ordered = [p for s in sorted(streams) for p in sorted(streams[s], key=lambda p: p.offset)]
    for p in ordered:
        assert p.start == sum(len(x.ids) for x in open_) and len(p.ids) == p.length
        open_.append(p)
        if p.start + p.length == p.doc_tokens:
            got.append(tuple(i for x in open_ for i in x.ids))
            open_ = []
    assert not open_ and sorted(got) == expected


@pytest.mark.parametrize(("length", "fast"), [(64, True), (1024, True), (512, False)])
def test_round_trip(frame, corpus, tokenizer, length, fast):
    odd = [(500, "a  b"), (501, " lead"), (502, "trail "), (503, "x \n y"), (504, "\u00a0 nb\u2003sp ace"), (505, "<|endoftext|> in text <|endoftext|>")]
    rows = corpus + odd + [(506, "z" * 3000), (507, "日本語 テキスト 🙂 ok"), (508, "it's 12,345 o'clock\t\ttabs")]
    ranks = default_ranks() if fast else None
    got = curve_packing.pack(frame(rows), default_tokenizer(), length=length, with_ids=True, ranks=ranks).collect()
    check_pieces(got, rows, tokenizer, length)


def test_empty_table(spark):
    assert curve_packing.pack(spark.createDataFrame([], SCHEMA), default_tokenizer()).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F, codec="utf-8"), st.sampled_from(" \n\t\r.,'s12aÄé\x85\xa0"), st.characters(codec="utf-8")), max_size=60))
def test_both_encoders_give_the_same_ids(text):
    tool = curve_packing.encoder(default_tokenizer(), default_ranks())
    assert tool.fast is not None
    assert np.frombuffer(tool.encode(text), tool.dtype).tolist() == tool.whole(text)


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_and_moves_one_step_at_a_time(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), axis=-1).reshape(-1, dimensions)
    keys = curve_packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_neighbours_are_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    pieces = curve_packing.pack(docs, default_tokenizer()).join(docs.select("doc_id", "lang"), "doc_id")
    mixed = pieces.groupBy("sequence_id").agg(F.count_distinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    shuffled = pieces.withColumn("lang", F.col("lang")).toPandas()
    shuffled["lang"] = shuffled["lang"].sample(frac=1, random_state=1).to_numpy()
    assert mixed < 0.85 * shuffled.groupby("sequence_id")["lang"].nunique().mean()
