"""Best-two-fit packing: a round trip, bins without gaps, and the plan against packing one document at a time."""

import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewarden.llm import two_fit_packing as packing


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def one_by_one(sizes, capacity):
    """Bins of the rule, a document at a time."""
    left, bins = sorted(sizes), []
    while left:
        held, gap = [], capacity
        while fits := [s for s in left if s <= gap]:
            held.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        while gap:
            least = min(held)
            best, pair = least, None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if best < a + b <= gap + least:
                        best, pair = a + b, (a, b)
            if pair is None:
                break
            held.remove(least)
            for s in pair:
                left.remove(s)
            left = sorted([*left, least])
            held += pair
            gap -= best - least
        bins.append(sorted(held))
    return sorted(bins)


def unrolled(bins):
    return sorted(sorted(s for s, n in held.items() for _ in range(n)) for held, repeats in bins for _ in range(repeats))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=40))
def test_plan_is_the_rule_one_document_at_a_time(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    bins = packing.plan(counts, 24)
    assert unrolled(bins) == one_by_one(sizes, 24)


def test_two_that_fit_better_replace_the_shortest():
    # 6 and 3 leave one free; 3 gives way to 2 + 2
    assert unrolled(packing.plan({6: 1, 3: 1, 2: 2}, 10)) == [[2, 2, 6], [3]]


def test_plan_of_many_documents_is_short_and_tight():
    rng = np.random.Generator(np.random.PCG64(4))
    sizes, n = np.unique(np.clip(rng.lognormal(6, 1.2, 3_000_000), 1, 4096).astype(int), return_counts=True)
    bins = packing.plan(dict(zip(sizes.tolist(), n.tolist(), strict=True)), 4096)
    total = int((sizes * n).sum())
    assert sum(r for _, r in bins) <= 1.001 * total / 4096 + 1
    assert len(packing.stretches_of(bins)) < 100_000
    used = {}
    for held, repeats in bins:
        assert sum(s * k for s, k in held.items()) <= 4096
        for s, k in held.items():
            used[s] = used.get(s, 0) + k * repeats
    assert used == dict(zip(sizes.tolist(), n.tolist(), strict=True))


def check(pieces, rows, path, length):
    tool = Tokenizer.from_file(path)
    wanted = sorted(tuple(tool.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows)
    bins, docs = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) and 0 < p.length <= length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        assert p.start == p.piece * length
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    # rows of one key and piece can be told apart by nothing, so whole documents are compared where the key is alone
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
    alone = [k for k, _ in rows if [x for x, _ in rows].count(k) == 1]
    texts = dict(rows)
    for key in alone:
        ids = [i for p in sorted(docs[key], key=lambda p: p.piece) for i in p.ids]
        assert ids == tool.encode(texts[key] or "", add_special_tokens=False).ids + [1]
        assert all(p.length == length for p in sorted(docs[key], key=lambda p: p.piece)[:-1])
    assert sum(p.length for p in pieces) == sum(map(len, wanted))
    return len(bins), sum(map(len, wanted))


@pytest.mark.parametrize("length", [64, 4096])
def test_round_trip(frame, corpus, path, length):
    odd = [(500, "a  b"), (501, "<|endoftext|> in text"), (502, "日本語 テキスト 🙂 ok"), (503, "it's 12,345 o'clock\x1cx"), (504, "é İ ǅ ½")]
    rows = corpus + odd + [(505, "z" * 3000)]
    pieces = packing.pack(frame(rows), path, length=length, with_ids=True).collect()
    sequences, total = check(pieces, rows, path, length)
    assert sequences <= 1.05 * total / length + 1
    light = packing.pack(frame(rows), path, length=length)
    assert light.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert light.count() == len(pieces)


def test_empty_table(spark, path):
    assert packing.pack(spark.createDataFrame([], brute.SCHEMA), path).collect() == []


def test_a_length_that_most_rows_share_is_numbered_by_many_tasks(spark, apart):
    rows = spark.range(0, 9_000, 1, 6).selectExpr("id as _row", "case when id % 10 < 6 then 7 else id % 100 + 1 end as length")
    got = packing.numbered(rows.selectExpr("_row", "cast(length as long) as length"))
    hot = got.where("length = 7")
    assert hot.select("_part").distinct().count() > 2
    numbers = sorted(r._number for r in hot.collect())
    assert numbers == list(range(len(numbers)))


ODD = st.sampled_from(list(" \n\t'.,’s12aÄéI!x½²\x85\xa0\x1ćİ日") + ["'ll", "<|endoftext|>", "don't"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(ODD, st.characters(max_codepoint=0x24F, codec="utf-8"), st.characters(codec="utf-8")), max_size=30))
def test_remembered_words_give_the_same_ids(parts):
    import public_tokenizers

    tool = packing.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert tool.pattern is not None
    text = "".join(parts)
    assert tool.encode(text) == tool.whole(text)
