"""A corpus pipeline: language, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. :func:`run` writes each result as Parquet to the
shared folder and gives the next stage what it reads back. All stages but the last return the columns of their
input. Every stage takes NULLs in any column, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import curve_packing, fm_decontam, heavy_dedup, jaccard_join, language_crf
from tablewarden.llm.common import fold, stored
from tablewarden.llm.queries import default_ranks, default_tokenizer
from tablewarden.sources.tables import read_table


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under plain names, so that helper columns can't clash with them."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get a language: a NULL ``lang`` becomes the one that the chain finds. Texts without a letter go.

    A given language stays as it is, and texts that mix languages stay. Learns from the rows with a language whose
    fold is not held out. Where no row with a text has a language nothing can be told, and ``lang`` stays NULL.
    """
    safe, names = renamed(docs)
    learn = fold(F.col(names["doc_id"]), 3) != 1
    if not safe.where(learn & F.col(names["lang"]).isNotNull() & F.col(names["text"]).isNotNull()).limit(1).count():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    said = language_crf.judged(safe, learn, names["text"], names["lang"], into=("_said", "_share"))
    kept = said.where(F.col("_said") != language_crf.UNKNOWN)
    found = {c: F.col(n) for c, n in names.items()}
    found["lang"] = F.coalesce(found["lang"], F.col("_said").cast(docs.schema["lang"].dataType))
    return kept.select([v.alias(c) for c, v in found.items()])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): the longest, then the smallest doc_id."""
    return heavy_dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the smallest doc_id. Rows without words stay."""
    return jaccard_join.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts, and n_chars follows; a row with no word left goes."""
    safe, names = renamed(docs)
    body = names["text"]
    benchmark = read_table(spark, "benchmark", directory=sf_dir)
    found = fm_decontam.find_contamination(safe, benchmark, keep=tuple(names.values()), text=body)
    hit = F.size("spans") > 0
    hit_words = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    text = F.when(hit, fm_decontam.cut(F.col(body), F.col("spans"))).otherwise(F.col(body))
    left = found.where(~hit | (hit_words < F.col("n_words"))).withColumn("_new", text)
    values = {c: F.col(n) for c, n in names.items()} | {"text": F.col("_new")}
    if "n_chars" in names:
        count = F.length("_new").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(hit, count).otherwise(F.col(names["n_chars"]))
    return left.select([values[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of documents, with their token ids, in order of the curve."""
    return curve_packing.pack(docs, default_tokenizer(), with_ids=True, ranks=default_ranks())


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: The language model, the tokenizer and the curve have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, "documents", directory=sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
