"""Quality classifier: a support vector machine on naive Bayes features.

The features are indicators of hashed words and word pairs. Each is scaled by the log ratio of its counts in
the two classes, counted over all labelled rows in Spark; a linear hinge loss is then fitted by dual coordinate
descent on a bounded sample, and its margins are mapped to probabilities. Scoring is one map over all texts.

Defined results: NULL and empty text have no features and get the score of the bias. Without labels, or with
labels of one class only, every score is the smoothed share of label 1. A text labelled more than once counts
once for each label row. An empty table gives an empty result. Very long texts are scored whole (in the sample they may
be cut); other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import words
from tablewarden.llm.common import joined_labels, sampled, stored

#: Hash buckets of the features; bounds the statistics read to the driver.
BUCKETS = 1 << 18
#: Bounds of the sample on which the hinge loss is fitted: rows, and characters of their texts.
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 20_000_000


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, bucket) pairs of words, marks and word pairs, in order."""
    plain = words.words_of(texts, words.LETTERED, fold=True)
    marks = words.words_of(texts, MARKS)
    found = []
    for part, salt in ((plain, 0), (marks, 1)):
        h, row = part.hashes() + np.uint64(salt), part.document()
        pairs = words.sequence_hashes(h, 2)
        inner = words.inner_starts(part.first, 2)
        for values, rows in ((h, row), (pairs[inner], row[: len(pairs)][inner])):
            found.append(rows * BUCKETS + (values % np.uint64(BUCKETS)).astype(np.int64))
    keys = np.unique(np.concatenate(found))
    return keys // BUCKETS, keys % BUCKETS


#: Runs of ASCII marks, such as lists of bars or junk after words.
MARKS = words.byte_class(lambda b: 0x21 <= b < 0x7F and not chr(b).isalnum())


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratios
    weight: np.ndarray  # ratio times fitted weight
    bias: float
    slope: float
    shift: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        row, bucket = indicators(texts)
        return self.of(row, bucket, len(texts))

    def of(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(row, self.ratio[bucket] ** 2, n))
        return np.bincount(row, self.weight[bucket], n) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def class_counts(labelled: DataFrame) -> DataFrame:
    """In how many labelled texts of each class a bucket occurs: at most BUCKETS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts = words.column(batch, "_text")
            labels = np.asarray(words.column(batch, "_label"))
            for a, b in words.slices(texts):
                row, bucket = indicators(texts.slice(a, b - a))
                for label in (0, 1):
                    seen[label] += np.bincount(bucket[labels[a:b][row] == label], minlength=BUCKETS)
        used = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(seen[0, used]), pa.array(seen[1, used])], ["bucket", "no", "yes"]
        )

    counted = labelled.select("_text", "_label").mapInArrow(count, "bucket int, no long, yes long")
    return counted.groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))


def feature_rows(labelled: DataFrame) -> DataFrame:
    """Label, weight and distinct buckets (as packed int32) of each row."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.column(batch, "_text")
            labels, weights = words.column(batch, "_label"), words.column(batch, "_weight")
            for a, b in words.slices(texts):
                row, bucket = indicators(texts.slice(a, b - a))
                ends = np.searchsorted(row, np.arange(b - a + 1))
                packed = bucket.astype("<i4")
                sets = [packed[ends[i] : ends[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [labels.slice(a, b - a), weights.slice(a, b - a), pa.array(sets, pa.binary())], ["_label", "_weight", "buckets"]
                )

    return labelled.select("_text", "_label", "_weight").mapInArrow(featurise, "_label int, _weight double, buckets binary")


def hinge_dual(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float, epochs: int, weight: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss of weighted rows, unit-norm sparse vectors."""
    w, bias = np.zeros(BUCKETS), 0.0
    alpha, order = np.zeros(len(rows)), np.random.Generator(np.random.PCG64(1))
    # the bias is the weight of a feature that is always 1, so x.x = 2 (1 for a row without features)
    size = np.array([values @ values + 1.0 for _, values in rows])
    weight = np.ones(len(y)) if weight is None else weight
    total = weight.sum()
    upper = weight * np.where(
        y > 0, c * total / (2 * max(weight[y > 0].sum(), 1e-9)), c * total / (2 * max(weight[y < 0].sum(), 1e-9))
    )
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            bucket, values = rows[i]
            slope = y[i] * (w[bucket] @ values + bias) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[bucket] += step * values
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w, bias


def logistic_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted margins, by damped Newton steps (smoothed targets)."""
    yes, no = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - target) * x).sum() + 1e-3 * a, (weight * (p - target)).sum()])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def shared(mine: int, other: int, most: int) -> int:
    """The part of ``most`` for one of two classes of these sizes."""
    return max(1, min(mine, max(most // 2, most - other)))


def fit(labelled: DataFrame, smoothing: float = 1.0, c: float = 1.0, mix: float = 0.5, epochs: int = 20) -> Model | float:
    """A model of rows with ``_text`` and ``_label``; a number (the constant score) where there is one class."""
    labelled = labelled.where(F.col("_label").isin(0, 1))
    length = F.coalesce(F.length("_text"), F.lit(0))
    n, yes, chars, yes_chars = labelled.agg(
        F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("_label"), length, length * F.col("_label"))]
    ).first()
    if yes in (0, n):
        return (yes + 1) / (n + 2)
    counts = class_counts(labelled).toPandas()  # at most BUCKETS rows
    p, q = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    p[counts["bucket"]] += counts["yes"].to_numpy()
    q[counts["bucket"]] += counts["no"].to_numpy()
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    # half for each class; what one does not need is the other's
    bounds = {1: (shared(yes, n - yes, SAMPLE_ROWS), shared(yes_chars, chars - yes_chars, SAMPLE_CHARS))}
    bounds[0] = (SAMPLE_ROWS - bounds[1][0], SAMPLE_CHARS - bounds[1][1])
    sample = feature_rows(sampled(labelled, bounds)).collect()  # bounded by SAMPLE_ROWS and SAMPLE_CHARS
    sample.sort(key=lambda r: (bytes(r["buckets"]), r["_label"], r["_weight"]))
    rows = []
    for r in sample:
        bucket = np.frombuffer(r["buckets"], dtype="<i4")
        values = ratio[bucket]
        rows.append((bucket, values / max(np.sqrt(values @ values), 1e-9)))
    y = np.array([1.0 if r["_label"] else -1.0 for r in sample])
    weight = np.array([r["_weight"] for r in sample])
    weight *= min(1.0, SAMPLE_ROWS / weight.sum())
    if len(set(y)) < 2:
        return (yes + 1) / (n + 2)
    held = np.random.Generator(np.random.PCG64(2)).random(len(rows)) < 0.25  # for the probabilities
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(rows), bool)
    w, bias = hinge_dual([r for r, h in zip(rows, held, strict=True) if not h], y[~held], c, epochs, weight[~held])
    w = (1 - mix) * np.abs(w).mean() + mix * w
    margins = np.array([w[b] @ v + bias for b, v in rows])
    checked = held if held.any() else ~held
    slope, shift = logistic_line(margins[checked], y[checked], weight[checked])
    return Model(ratio, ratio * w, bias, slope, shift)


def scored(docs: DataFrame, model: Model | float, key: str, text: str, keep: list[str] = ()) -> DataFrame:
    """``key`` (and other columns) and the score of every text."""
    names = [key, *keep]
    given = docs.select(*names, F.col(text).cast("string").alias("_text"))
    if isinstance(model, float):
        return given.select(*names, F.lit(model).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.column(batch, "_text")
            out = [held.value.scores(held.value.margins(texts.slice(a, b - a))) for a, b in words.slices(texts)]
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(words.column(batch, c) for c in names), pa.array(scores)], [*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*names).schema)
    return given.mapInArrow(score, f"{fields}, score double")


def classify(
    docs: DataFrame, labels: DataFrame, label: str, learn, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Scores every row of ``docs``; learns from rows of ``labels`` for whose key ``learn(key)`` holds."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    known = labels.where(F.col(label).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")
    )
    labelled = stored(joined_labels(slim, known.where(learn(F.col("_key")))).select("_text", "_label"))
    return scored(docs.select(F.col(key), F.col(text)), fit(labelled), key, text)
