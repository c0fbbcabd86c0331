"""Language identification: a linear-chain conditional random field labels the words of code-switched text.

Training texts carry one language each. So that the chain learns moves between languages, the words of a
bounded sample are cut into stretches and dealt out anew to texts that switch now and then; word and n-gram
features and transitions are then fitted together. Every text is labelled by forward-backward; its language is
the one with the largest sum of marginals, and the score is that language's share of the words.

Defined results: NULL text and text without a letter is ``und`` with score 0. Rows whose language is NULL teach
nothing, and equal texts of a language teach once; without any known language all texts are ``und``; with one, it is that one. Repeated rows agree. An
empty table gives an empty result. Very long texts are labelled whole (in the sample they may be cut); columns other
than those that are kept are passed over. The model has 1 MB for each language that is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import chain_crf, words
from tablewarden.llm.common import sampled

#: Bounds of the sample the chain is fitted on, for each language: rows, and characters.
SAMPLE_ROWS = 300
SAMPLE_CHARS = 500_000
UNKNOWN = "und"
ASCII_LETTER = words.byte_class(lambda b: b < 0x80 and chr(b).isalpha())


def switched(part: words.Words, labels: np.ndarray, seed: int = 5, mean: int = 40, length: int = 160):
    """The words dealt out anew: texts of about ``length`` words made of stretches of about ``mean`` words."""
    rng = np.random.Generator(np.random.PCG64(seed))
    stretches = []
    for d in range(len(part.first) - 1):
        a, stop = int(part.first[d]), int(part.first[d + 1])
        while a < stop:
            b = min(a + 1 + int(rng.exponential(mean)), stop)
            stretches.append((a, b))
            a = b
    order, first, size = [], [0], 0
    for i in rng.permutation(len(stretches)):
        order.append(np.arange(*stretches[i]))
        size += len(order[-1])
        if size - first[-1] >= length:
            first.append(size)
    if first[-1] < size:
        first.append(size)
    at = np.concatenate(order)
    dealt = words.Words(part.data, part.begin[at], part.end[at], np.array(first), part.rows)
    return dealt, labels[part.document()][at]


def fit(known: DataFrame) -> tuple[list[str], chain_crf.Chain | None]:
    """Languages in order, and the chain. ``known`` has ``_text`` and ``_lang``."""
    languages = sorted(r["_lang"] for r in known.select("_lang").distinct().collect())
    if len(languages) < 2:
        return languages, None
    total = len(languages)
    part = sampled(known.withColumnRenamed("_lang", "_label"), {x: (SAMPLE_ROWS, SAMPLE_CHARS) for x in languages})
    sample = sorted((r["_text"], r["_label"]) for r in part.collect())
    texts = pa.array([t for t, _ in sample], pa.string())
    labels = np.array([languages.index(x) for _, x in sample])
    dealt, y = switched(words.words_of(texts, words.LETTERED, fold=True), labels)
    return languages, chain_crf.fit(dealt, y, total)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Truth per text: it holds a letter."""
    data, rows = words.raw(texts)
    total = np.concatenate([[0], np.cumsum(ASCII_LETTER[data], dtype=np.int64)])
    found = total[rows[1:]] > total[rows[:-1]]
    for d in np.flatnonzero(~found & (rows[1:] > rows[:-1])):
        found[d] = any(c.isalpha() for c in texts[int(d)].as_py())
    return found


def labelled(docs: DataFrame, languages: list[str], chain: chain_crf.Chain | None, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` of every text."""
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_read"))
    held = docs.sparkSession.sparkContext.broadcast((languages, chain))  # 1 MB for each language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, chain = held.value
        for batch in batches:
            for rows, texts, part in chain_crf.by_length(batch, "_read"):
                lettered = has_letter(texts) & bool(names)
                best, score = np.zeros(len(rows), np.int64), np.ones(len(rows))
                if chain is not None:
                    total = np.vstack([np.zeros(len(names)), np.cumsum(chain.marginals(part), axis=0)])
                    sums = total[part.first[1:]] - total[part.first[:-1]]
                    best = sums.argmax(axis=1)
                    score = sums[np.arange(len(rows)), best] / np.maximum(part.counts, 1)
                said = [names[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
                others = batch.take(pa.array(rows)).select(keep).columns
                scores = np.where(lettered, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*others, pa.array(said, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_read")
    return given.mapInArrow(label, f"{fields}, lang_pred string, score double")


def judged(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", into: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with two more columns, named by ``into``. Only the text goes to Python; all columns, whatever their
    names and types, stay where they are.
    """
    known = docs.where(learn & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    pair = F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang")
    languages, chain = fit(known.select(*pair))
    held = docs.sparkSession.sparkContext.broadcast((languages, chain))

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, chain = held.value
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["_read"])
            said, score = np.full(len(texts), len(names)), np.zeros(len(texts))
            for rows, some, part in chain_crf.by_length(batch, "_read", JUDGED_TOGETHER):
                lettered = has_letter(some) & bool(names)
                best, share = decided(part, len(rows), chain, len(names))
                said[rows] = np.where(lettered, best, len(names))
                score[rows] = np.where(lettered, share, 0.0)
            spoken = pa.array([*names, UNKNOWN], pa.string()).take(pa.array(said))
            yield pa.StructArray.from_arrays([spoken, pa.array(score)], ["lang_pred", "score"])

    # once for each row: the optimizer must not repeat it in a filter
    judge = F.arrow_udf(label, "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    named = docs.withColumn("_judged", judge(F.col(f"`{text}`").cast("string")))
    fields = [F.col("_judged.lang_pred").alias(into[0]), F.col("_judged.score").alias(into[1])]
    return named.select(*[F.col(f"`{c}`") for c in docs.columns], *fields)


#: Text bytes whose words are labelled together by :func:`judged`; workers keep the memory that this takes.
JUDGED_TOGETHER = 100_000


def decided(part: words.Words, rows: int, chain: chain_crf.Chain | None, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The language with the largest sum of marginals in each text, and its share of the words."""
    if chain is None:
        return np.zeros(rows, np.int64), np.ones(rows)
    sums = np.vstack([np.zeros(total), np.cumsum(chain.marginals(part), axis=0)])
    sums = sums[part.first[1:]] - sums[part.first[:-1]]
    best = sums.argmax(axis=1)
    return best, np.clip(sums[np.arange(rows), best] / np.maximum(part.counts, 1), 0, 1)


def identify(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep``, lang_pred and score of every row of ``docs``; learns from the rows for which ``learn`` holds."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    languages, chain = fit(known.select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang")))
    return labelled(docs, languages, chain, text, list(keep))
