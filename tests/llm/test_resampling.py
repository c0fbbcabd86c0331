"""Importance resampling: CRCs from payloads, buckets and draws against a plain version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import tuples
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewarden.llm import importance


def features(text):
    w = brute.lettered(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def resampled(rows, target):
    source = Counter(bucket(f) for _, t in rows for f in features(t))
    wanted = Counter(bucket(f) for t in target for f in features(t))
    s, t = sum(source.values()), sum(wanted.values())
    out = []
    for key, text in rows:
        gains = [
            math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000))))
            for b in map(bucket, features(text))
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(gains), weight, score, len(brute.lettered(text)) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able, 1):
        r[4] = place if place <= 25 * len(able) // 100 else None
    return [tuple(r[:4]) + (None if r[4] is False else r[4],) for r in out]


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("words", [0, 5, importance.DICTIONARY])
def test_against_a_plain_version(spark, frame, corpus, words):
    target = [(1, corpus[0][1]), (2, None), (3, ""), (4, "The ÖRLE ra-st, " + (corpus[4][1] or ""))]
    bench = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(frame(corpus), bench, words=words)
    assert tuples(got, *COLUMNS) == sorted(resampled(corpus, [t for _, t in target]), key=repr)
    assert {f.dataType.simpleString() for f in got.schema} == {"bigint"}


def test_stretches_of_long_texts_change_nothing(spark, frame, corpus, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK_BYTES", 50)
    rows = corpus[:40] + [(900, "x" * 200 + " one two " + "y" * 300), (901, "-" * 500), (902, " a" * 300), (903, "é" * 400)]
    bench = spark.createDataFrame([(1, corpus[0][1])], "item_id long, text string")
    words = tuple(sorted({w.encode() for _, t in rows for w in brute.lettered(t)}))[:20]
    texts = pa.array([t for _, t in rows], pa.string())
    whole, cut = [], []
    for limit, out in ((1 << 40, whole), (50, cut)):
        total = [Counter() for _ in rows]
        for at, single, pairs in importance.scans(texts, words, limit):
            for d, a, b in zip(at, single, pairs, strict=True):
                total[d].update(("one", int(a)) for _ in range(int(a >= 0)))
                total[d].update(("two", int(b)) for _ in range(int(b >= 0)))
        out += total
    assert whole == cut
    assert [sum(c.values()) for c in whole] == [len(features(t)) for _, t in rows]
    got = importance.resample(frame(rows), bench)
    assert tuples(got, *COLUMNS) == sorted(resampled(rows, [corpus[0][1]]), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], brute.SCHEMA)
    some = spark.createDataFrame([(i, f"word {i} " * 15) for i in range(8)], brute.SCHEMA)
    assert importance.resample(none, some).collect() == []
    got = importance.resample(some, none)
    assert tuples(got, *COLUMNS) == sorted(resampled([(i, f"word {i} " * 15) for i in range(8)], []), key=repr)


def test_repeated_rows_have_ranks_of_their_own(spark):
    rows = [(7, "alpha beta " * 12)] * 9 + [(None, "gamma delta " * 12)] * 7
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = tuples(importance.resample(spark.createDataFrame(rows, brute.SCHEMA).repartition(4), bench), *COLUMNS)
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4]
    assert got == sorted(resampled(rows, ["alpha beta gamma"]), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=80), min_size=2, max_size=6))
def test_pairs_of_crcs(words):
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words])
    got = importance.pair_crcs(crc[:-1], crc[1:], size[1:])
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


def test_draws_follow_the_target(spark):
    rng = random.Random(1)
    kinds = {True: "solar wind panel grid power".split(), False: "bread flour oven yeast salt".split()}
    rows = [(i, " ".join(rng.choices(kinds[i % 4 == 0], k=40))) for i in range(400)]
    bench = spark.createDataFrame([(1, " ".join(rng.choices(kinds[True], k=400)))], "item_id long, text string")
    drawn = importance.resample(spark.createDataFrame(rows, brute.SCHEMA), bench).where("rank is not null").collect()
    assert len(drawn) == 100 and sum(r.doc_id % 4 == 0 for r in drawn) > 90
