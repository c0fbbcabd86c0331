"""Toxicity: a linear-chain conditional random field marks toxic words; their marginals make document scores.

Labels are given per document. They become word labels by the lexicon that the labelled rows speak for: over
all of them Spark counts, by hash bucket, in how many toxic and other texts a word occurs; a word that toxic texts
have too often for chance is labelled toxic where it stands in a toxic text. On a bounded sample the
chain learns these labels from word and n-gram features and transitions, and a logistic curve maps the
marginals of a text (how many words are expected to be toxic, the surest one, their share) to its score. All
texts are then scored by forward-backward; runs of words with a marginal of one half or more are the spans.

Defined results: NULL and empty text has no words and no spans, and the score of that case on the curve.
Without labels, or with one class only, every score is the smoothed share of label 1. Rows are scored one by
one, so repeated rows agree. An empty table gives an empty result. Very long texts are scored whole (in the sample
that the chain is fitted on they may be cut, see :func:`common.sampled`); other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import chain_crf, words
from tablewarden.llm.common import joined_labels, sampled, stored

#: Hash buckets of the word statistics; bounds what is read to the driver.
BUCKETS = 1 << 18
#: Bounds of the sample the chain is fitted on, for each class: rows, and characters.
SAMPLE_ROWS = 800
SAMPLE_CHARS = 1_500_000


@dataclass
class Model:
    chain: chain_crf.Chain
    curve: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scores(self, summary: np.ndarray) -> np.ndarray:
        x = np.column_stack([(summary - self.mean) / self.spread, np.ones(len(summary))])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def class_counts(labelled: DataFrame) -> DataFrame:
    """In how many texts of each class a word bucket occurs: at most BUCKETS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts, labels = words.column(batch, "_text"), np.asarray(words.column(batch, "_label"))
            for a, b in words.slices(texts):
                part = words.words_of(texts.slice(a, b - a), words.LETTERED, fold=True)
                keys = np.unique(part.document() * BUCKETS + bucket_of(part))
                for label in (0, 1):
                    seen[label] += np.bincount(keys[labels[a:b][keys // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(seen[0, used]), pa.array(seen[1, used])], ["bucket", "no", "yes"]
        )

    counted = labelled.select("_text", "_label").mapInArrow(count, "bucket int, no long, yes long")
    return counted.groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))


def bucket_of(part: words.Words) -> np.ndarray:
    return (part.hashes() % np.uint64(BUCKETS)).astype(np.int64)


#: The chance that any word of no class at all gets into the lexicon.
CHANCE = 0.05


def least_statistic(tests: int, chance: float = CHANCE) -> float:
    """What the likelihood ratio statistic of none of so many words exceeds but with that chance (chi squared, one degree)."""
    return NormalDist().inv_cdf(1 - chance / (2 * max(tests, 1))) ** 2


def lexicon(no: np.ndarray, yes: np.ndarray, n_no: int, n_yes: int) -> np.ndarray:
    """Truth per bucket: toxic texts have the word more often (log odds over 1.5), and by a likelihood ratio statistic
    that chance does not reach among as many words as there are; the fewer, the rarer a word may be."""
    least = least_statistic(int(((yes + no) > 0).sum()))

    def gain(seen: np.ndarray, n: int) -> np.ndarray:
        share, rest = (yes + no) / (n_yes + n_no), n - seen
        here = np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(n * share, 1e-12)), 0.0)
        gone = np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(n * (1 - share), 1e-12)), 0.0)
        return here + gone

    odds = np.log((yes + 0.5) / (n_yes - yes + 0.5)) - np.log((no + 0.5) / (n_no - no + 0.5))
    return (odds > 1.5) & (2 * (gain(yes, n_yes) + gain(no, n_no)) >= least)


def summaries(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: log of one plus the expected number of toxic words, the surest word, the share of toxic words."""
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected = total[first[1:]] - total[first[:-1]]
    surest = np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        surest[some] = np.maximum.reduceat(p, first[:-1][some])
    return np.column_stack([np.log1p(np.maximum(expected, 0)), surest, np.sqrt(np.maximum(expected, 0) / np.maximum(n, 1))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights (the last for the constant) of a ridge logistic regression, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(labelled: DataFrame) -> Model | float:
    """A model of rows with ``_text`` and ``_label``; a number (the constant score) where there is one class."""
    labelled = labelled.where(F.col("_label").isin(0, 1))
    sizes = {r["_label"]: r for r in labelled.groupBy("_label").agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("c")).collect()}
    if len(sizes) < 2:
        return (sizes[1]["n"] if 1 in sizes else 0) / (sum(r["n"] for r in sizes.values()) + 2) if 0 in sizes or not sizes else 1 - 1 / (sizes[1]["n"] + 2)
    counts = class_counts(labelled).toPandas()  # at most BUCKETS rows
    no, yes = np.zeros(BUCKETS), np.zeros(BUCKETS)
    no[counts["bucket"]], yes[counts["bucket"]] = counts["no"], counts["yes"]
    toxic = lexicon(no, yes, sizes[0]["n"], sizes[1]["n"])

    drawn = sampled(labelled, {c: (SAMPLE_ROWS, SAMPLE_CHARS) for c in sizes})
    sample = sorted((r["_text"] or "", r["_label"], r["_weight"]) for r in drawn.collect())
    y = np.array([label for _, label, _ in sample])
    weight = np.array([w for _, _, w in sample])
    part = words.words_of(pa.array([t for t, _, _ in sample], pa.string()), words.LETTERED, fold=True)
    marked = (toxic[bucket_of(part)] & (y[part.document()] == 1)).astype(np.int64)
    chain = chain_crf.fit(part, marked, 2)
    p = chain.marginals(part)[:, 1]
    x = summaries(p, part.first)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    # the sample holds the classes in other shares than the labels do: the constant makes up for it
    drawn_rows = np.bincount(y, minlength=2)
    share = np.array([sizes[c]["n"] / max(drawn_rows[c], 1) for c in (0, 1)])
    weight = weight * (drawn_rows / np.maximum(np.bincount(y, weight, 2), 1e-9))[y]
    curve = logistic((x - mean) / spread, y.astype(float), weight)
    curve[-1] += np.log(share[1] / share[0])
    return Model(chain, curve, mean, spread)


SPANS = "array<struct<begin:int,end:int,p:double>>"


def spans_of(text: bytes, begin: np.ndarray, end: np.ndarray, p: np.ndarray, least: float) -> list[dict]:
    """Runs of words with a marginal of ``least`` or more: code point offsets and the surest marginal."""
    hot = np.flatnonzero(p >= least)
    out = []
    for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(hot) else []:
        a, b = int(begin[run[0]]), int(end[run[-1]])
        at = len(text[:a].decode("utf-8", "replace"))
        length = len(text[a:b].decode("utf-8", "replace"))
        out.append({"begin": at, "end": at + length, "p": float(p[run].max())})
    return out


def tagged(docs: DataFrame, model: Model | float, key: str, text: str, least: float = 0.5) -> DataFrame:
    """``key``, ``score`` and the toxic ``spans`` of every text."""
    given = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    if isinstance(model, float):
        return given.select(key, F.lit(model).alias("score"), F.array().cast(SPANS).alias("spans"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value.chain
        for batch in batches:
            for rows, texts, part in chain_crf.by_length(batch, "_text"):
                p = chain.marginals(part)[:, 1]
                scores = held.value.scores(summaries(p, part.first))
                spans: list[list] = [[] for _ in rows]
                hot = np.flatnonzero(p >= least)
                for d in np.unique(np.searchsorted(part.first, hot, side="right") - 1):
                    a, b = part.first[d], part.first[d + 1]
                    spans[d] = spans_of(
                        texts[int(d)].as_py().encode(), part.begin[a:b] - part.rows[d], part.end[a:b] - part.rows[d], p[a:b], least
                    )
                keys = words.column(batch, key).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([keys, pa.array(scores), pa.array(spans, kind)], [key, "score", "spans"])

    return given.mapInArrow(tag, f"`{key}` {given.schema[key].dataType.simpleString()}, score double, spans {SPANS}")


def detect(
    docs: DataFrame, labels: DataFrame, label: str, learn, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Scores and spans of every row of ``docs``; learns from rows of ``labels`` for whose key ``learn(key)`` holds."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    known = labels.where(F.col(label).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")
    )
    labelled = stored(joined_labels(slim, known.where(learn(F.col("_key")))).select("_text", "_label"))
    return tagged(docs, fit(labelled), key, text)
