"""The FM-index and what it finds, against brute force."""

import brute
import numpy as np
import pytest
from brute import SCHEMA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewarden.llm import fm_decontam


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 5))
def test_index_counts_and_locates_like_a_scan(runs, size):
    text = np.array([x for run in runs for x in [*run, 0]])
    index = fm_decontam.FMIndex(text, 4)
    windows = np.stack(np.meshgrid(*[np.arange(1, 5)] * size), axis=-1).reshape(-1, size)
    low, high = index.search(windows)
    for window, a, b in zip(windows, low, high, strict=True):
        places = sorted(index.locate(np.arange(a, b)).tolist())
        assert places == [i for i in range(len(text) - size + 1) if (text[i : i + size] == window).all()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=60))
def test_wavelet_ranks(values):
    sequence = np.array(values)
    tree = fm_decontam.WaveletMatrix(sequence, 5)
    for symbol in range(22):
        ranks = tree.rank(np.full(len(values) + 1, symbol), np.arange(len(values) + 1))
        assert ranks.tolist() == [values[:i].count(symbol) for i in range(len(values) + 1)]


def items_of(corpus):
    texts = dict(corpus)
    long = [texts[i] for i in (1, 2, 4) if texts[i]]
    items = [(f"i{n}", t[:400]) for n, t in enumerate(long)]
    return items + [("short", "one"), ("pair", "Two, words!"), ("none", None), ("blank", " ?! "), ("same", long[0][:400]), ("same", long[0][:300]), (None, "lost item")]


@pytest.mark.parametrize("block_chars", [10**9, 500])
def test_found_passages(spark, frame, corpus, block_chars):
    rows = corpus + [(200, "before " + dict(corpus)[1].upper() + " after"), (201, "x,one.y"), (202, "TWO\nwords two-words")]
    items = items_of(corpus)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    known = [(i, t) for i, t in items if i is not None]
    got = fm_decontam.find_contamination(frame(rows), benchmark, block_chars=block_chars).collect()
    found = sorted(
        ((r.doc_id, r.n_words, [i for h in r.hits for i in range(h.begin, h.end)], list(r["items"])) for r in got), key=repr
    )
    assert found == sorted(brute.leaks(rows, known), key=repr)


def test_spans_are_cut_out_of_the_text(spark, frame):
    passage = "Größe und Ähnliches stehen hier in einem langen Satz, der geprüft wird"
    rows = [(1, f"«Vorher» {passage}! Nachher é."), (2, "nichts"), (3, None), (4, passage)]
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = fm_decontam.find_contamination(frame(rows), benchmark, keep=("doc_id", "text"))
    cut = {r.doc_id: r.t for r in found.select("doc_id", fm_decontam.cut(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert cut == {1: "«Vorher» ! Nachher é.", 2: "nichts", 3: None, 4: ""}


def test_empty_sides(spark, frame, corpus):
    empty = spark.createDataFrame([], "item_id long, text string")
    got = fm_decontam.find_contamination(frame(corpus), empty).collect()
    assert len(got) == len(corpus) and not any(r["items"] or r.hits for r in got)
    assert fm_decontam.find_contamination(spark.createDataFrame([], SCHEMA), empty).collect() == []


def test_items_of_one_long_run_take_few_rounds():
    text = np.concatenate([np.tile([1, 2], 5000), [0], np.tile([1, 2], 5000), [0]])
    index = fm_decontam.FMIndex(text, 2)
    low, high = index.search(np.array([[1, 2, 1, 2, 1, 2, 1, 2, 1, 2]]))
    assert high[0] - low[0] == 2 * (10_000 - 9) // 2 + 1 or high[0] - low[0] == 9992


@pytest.mark.parametrize("block_chars", [10**9, 20])
def test_items_without_an_id_hit_and_count_as_one(spark, frame, block_chars):
    rows = [(1, "here is a lost item again"), (2, "found thing, lost item"), (3, "nothing"), (4, "a stray word")]
    items = [(None, "lost item"), (None, "stray"), ("f", "found thing"), (None, None), (None, "found")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = fm_decontam.find_contamination(frame(rows), benchmark, block_chars=block_chars).collect()
    hits = {r.doc_id: [i for h in r.hits for i in range(h.begin, h.end)] for r in got}
    assert hits == {1: [3, 4], 2: [0, 1, 2, 3], 3: [], 4: [1]}
    assert {r.doc_id: list(r["items"]) for r in got} == {1: [None], 2: ["f", None], 3: [], 4: [None]}
