"""The pipeline's stages, each on odd input, and the whole against brute force."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tablewarden.llm.common import stored
from tablewarden.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def sf_dir(spark, tmp_path, corpus):
    passage = dict(corpus)[2][:300]
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.fixture
def docs(spark, corpus):
    rows = [(k, t, None if (k or 0) % 7 == 3 else "aa", None, len(t) if t else None) for k, t in corpus]
    rows += [(400 + i, f"wholly other words in text {i} " * 8, "bb", "s", 1) for i in range(20)]
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    return frame.withColumns({"score": F.lit(1), "_text": F.lit("x"), "items": F.lit(None).cast("string")})


def test_every_stage_takes_odd_rows_and_keeps_the_columns(spark, docs, sf_dir):
    for name, stage in pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns, name
        assert out.count() > 0 and out.join(docs, "doc_id", "left_anti").where("doc_id is not null").count() == 0, name
    packed = stored(pipeline.pack(spark, docs, sf_dir))
    assert packed.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()


def test_every_stage_takes_an_empty_table(spark, docs, sf_dir):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_stages_against_brute_force(spark, docs, sf_dir, corpus):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept = stored(pipeline.language(spark, docs, sf_dir))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted(lettered, key=repr)

    kept = stored(pipeline.exact_dedup(spark, kept, sf_dir))
    flags = [(k, t) for (k, t), x in zip(got, flagged(got), strict=True) if x]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted(flags, key=repr)

    kept = stored(pipeline.near_dedup(spark, kept, sf_dir))
    groups = brute.near(got)
    named = {c for _, n, c in groups if n and c is not None}
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert {k for k, _ in got if k is not None} == named

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = {repr(k): hits for k, _, hits, _ in brute.leaks(got, items)}
    assert any(before.values())
    kept = stored(pipeline.decontaminate(spark, kept, sf_dir))
    after = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert not any(hits for _, _, hits, _ in brute.leaks(after, items))
    clean = [(k, t) for k, t in got if not before[repr(k)]]
    assert [r for r in after if not before[repr(r[0])]] == clean
    changed = kept.where(F.col("n_chars") != F.length("text")).select("doc_id").collect()
    assert all(not before[repr(r.doc_id)] for r in changed)

    total = pipeline.pack(spark, kept, sf_dir).agg(F.sum("length"), F.count_distinct("doc_id")).first()
    assert total[0] > 0 and total[1] == len({k for k, _ in after if k is not None})


def test_language_keeps_every_lettered_row(spark, sf_dir):
    rng = random.Random(4)
    speech = {x: [f"{x}{a}{b}" for a in "raten stolu ming leda".split() for b in "xa wi po".split()] for x in "bdfk"}
    rows = [(i, " ".join(rng.choices(speech["bdfk"[i % 4]], k=60)), "bdfk"[i % 4], None, 1) for i in range(80)]
    for i, mix in enumerate(("bd", "bdf", "bdfk", "fk", "kdb") * 4):
        parts = [" ".join(rng.choices(speech[x], k=20)) for x in mix]
        rows.append((100 + i, " ".join(parts), None, None, 1))
    rows += [(200, None, "b", None, None), (201, "12 345 !", None, None, 8)]
    given = spark.createDataFrame(rows, DOCS)
    out = pipeline.language(spark, given, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == [r[0] for r in rows[:100]]
    # texts of one language get it where it is lacking; what is given stays
    bare = [(k, t, None if k % 3 == 0 else x, s, n) for k, t, x, s, n in rows[:80]]
    bare.append((300, rows[0][1], "zz", None, None))
    found = {r.doc_id: r.lang for r in pipeline.language(spark, spark.createDataFrame(bare, DOCS), sf_dir).collect()}
    assert found == {k: x for k, _, x, _, _ in rows[:80]} | {300: "zz"}
    assert all(r.lang in "bdfk" for r in out)
    # so the stage is no letter filter
    filtered = spark.createDataFrame(rows, DOCS).where(F.col("text").rlike(r"\p{L}"))
    assert filtered.where("lang is null").count() == 20


def test_languages_of_null_texts_teach_nothing(spark, docs, sf_dir):
    bare = docs.withColumn("lang", F.when(F.col("text").isNull(), "aa"))
    out = pipeline.language(spark, bare, sf_dir)
    assert out.count() == bare.where(F.col("text").rlike(r"\p{L}")).count()


def flagged(rows):
    best = {}
    for at, (key, text) in enumerate(rows):
        digest = brute.sha(brute.WHITE.sub("", text or ""))
        best.setdefault(digest, []).append((-len(text or ""), brute.last(key), at))
    stay = {min(v)[2] for v in best.values()}
    return [at in stay for at in range(len(rows))]


def test_documents_without_any_language_stay(spark, docs, sf_dir):
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    out = pipeline.language(spark, nothing, sf_dir)
    assert out.count() == nothing.where(F.col("text").rlike(r"\p{L}")).count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(n.split("_")[0][2:]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(QUERIES) <= set(names) and "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_queries_against_sql(spark, key):
    import compare

    con = compare.connect("/root/testdata/sf0.001")
    assert compare.differences(QUERIES[key](spark, "/root/testdata/sf0.001"), con, ORACLES[key]) is None
