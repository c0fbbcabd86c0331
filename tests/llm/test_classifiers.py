"""Classifiers: parts against brute force, held-out accuracy, and edge cases."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from brute import SCHEMA
from pyspark.sql import functions as F

from tablewarden.llm import chain_crf, language_crf, nb_svm, queries, toxic_spans, url_trees, words
from tablewarden.llm.common import LEAST_ROWS, fold, sampled

SF_DIR = "/root/testdata/sf0.01"


def never(key):
    return F.lit(False)


def always(key):
    return F.lit(True)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    chain = chain_crf.Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    first = np.array([0, 4, 4, 5, 8])
    emissions = rng.normal(size=(8, 3))
    p, moves = chain_crf.forward_backward(chain, emissions, first)
    expected, expected_moves = np.zeros((8, 3)), np.zeros((3, 3))
    for a, b in itertools.pairwise(first):
        paths = list(itertools.product(range(3), repeat=b - a)) if b > a else []
        score = []
        for path in paths:
            s = chain.start[path[0]] + sum(emissions[a + i, y] for i, y in enumerate(path))
            score.append(s + sum(chain.moves[x, y] for x, y in itertools.pairwise(path)))
        weight = np.exp(score) / np.exp(score).sum() if paths else []
        for path, w in zip(paths, weight, strict=True):
            for i, y in enumerate(path):
                expected[a + i, y] += w
            for x, y in itertools.pairwise(path):
                expected_moves[x, y] += w
    assert np.allclose(p, expected) and np.allclose(moves, expected_moves)


def test_features_do_not_depend_on_neighbours():
    texts = pa.array(["alpha beta", "beta", "x alpha y"])
    part = words.words_of(texts, words.LETTERED, fold=True)
    lists = chain_crf.feature_lists(part, 1 << 17)

    def of(word):
        return [sorted(b[o == word].tolist()) for o, b in lists]

    assert of(0) == of(4) and of(1) == of(2) and of(0) != of(1)
    # beta with a mark at either end has 5, 4 and 3 n-grams
    assert [len(x) for x in of(1)] == [1, 5, 4, 3]


def test_samples_are_bounded_and_hold_copies_once(spark):
    rows = [(f"text {i}", 0) for i in range(400)] + [("the same words", 0)] * 300 + [(f"long {i} " * 500, 1) for i in range(50)]
    rows += [("only one", 2), (None, 2)]
    drawn = sampled(spark.createDataFrame(rows, "_text string, _label int"), {0: (60, 10**6), 1: (40, 1000), 2: (10, 100)}).collect()
    by = {c: [r for r in drawn if r["_label"] == c] for c in (0, 1, 2)}
    assert len(by[0]) == 60 and len({r["_text"] for r in by[0]}) == 60
    assert [300 <= r["_weight"] < 400 for r in by[0] if r["_text"] == "the same words"] == [True]
    assert 500 < sum(r["_weight"] for r in by[0]) < 950
    assert LEAST_ROWS <= len(by[1]) <= 40 and sum(len(r["_text"]) for r in by[1]) <= 1000
    assert sorted((str(r["_text"]), r["_weight"]) for r in by[2]) == [("None", 1.0), ("only one", 1.0)]


def test_learned_moves_follow_the_switches():
    rng = np.random.default_rng(0)
    vocabulary = {0: ["der", "und", "nicht"], 1: ["the", "and", "not"]}
    texts, labels = [], []
    for _ in range(60):
        y, line = int(rng.integers(2)), []
        for _ in range(30):
            y = 1 - y if rng.random() < 0.1 else y
            line.append(rng.choice(vocabulary[y]))
            labels.append(y)
        texts.append(" ".join(line))
    part = words.words_of(pa.array(texts), words.LETTERED)
    chain = chain_crf.fit(part, np.array(labels), 2)
    assert chain.moves[0, 0] > chain.moves[0, 1] and chain.moves[1, 1] > chain.moves[1, 0]
    assert (chain.marginals(part).argmax(axis=1) == labels).mean() > 0.99
    # a word no one has seen is told by its neighbours
    unknown = words.words_of(pa.array(["der zzz und", "the zzz and"]), words.LETTERED)
    p = chain.marginals(unknown)
    assert p[1, 0] > 0.5 and p[4, 1] > 0.5


def dual_objective(rows, y, w, bias, c):
    margins = np.array([w[b] @ v + bias for b, v in rows])
    return 0.5 * (w @ w + bias**2) + c * np.maximum(0, 1 - y * margins).sum()


def test_dual_coordinate_descent_reaches_the_least_hinge_loss(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(nb_svm, "BUCKETS", 6)
    rows = [(np.arange(6), rng.normal(size=6)) for _ in range(40)]
    rows = [(b, v / np.linalg.norm(v)) for b, v in rows]
    y = np.array([1.0, -1.0] * 20)
    w, bias = nb_svm.hinge_dual(rows, y, 1.0, 400)
    best = dual_objective(rows, y, w, bias, 1.0)
    for _ in range(300):
        near = dual_objective(rows, y, w + rng.normal(scale=0.02, size=6), bias + rng.normal(scale=0.02), 1.0)
        assert near >= best - 1e-3


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    yes = labels == 1
    return (rank[yes].sum() - yes.sum() * (yes.sum() - 1) / 2) / (yes.sum() * (~yes).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op4_nb_svm_quality", "quality", 0.9), ("op3_crf_toxic_spans", "toxic", 0.75)])
def test_held_out_rows_are_told_apart(spark, name, label, least):
    out = queries.QUERIES[name](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("score", label).toPandas()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least
    assert out.count() == 1000 and out.where("score not between 0 and 1").count() == 0


def test_toxic_spans_hold_the_words(spark):
    out = queries.QUERIES["op3_crf_toxic_spans"](spark, SF_DIR).where("size(spans) > 0")
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    cut = F.expr("transform(spans, s -> substr(text, s.begin + 1, s.end - s.begin))")
    found = [w for r in out.join(texts, "doc_id").select(cut.alias("w")).collect() for x in r.w for w in x.lower().split()]
    assert len(found) > 100
    # the words that the labels speak for make up nearly all of what is marked
    common = {w for w in found if found.count(w) >= 5}
    assert sum(w in common for w in found) / len(found) > 0.8


def test_languages_of_held_out_rows(spark):
    out = queries.QUERIES["op9_crf_language"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    right = out.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98 and out.count() == 1000


def odd_texts(corpus):
    return corpus + [(300, "12 34 ... ??"), (301, "Ж"), (302, "e" * 200_000), (303, "word " * 30_000), (304, "“”")]


def test_language_of_odd_texts(spark, frame, corpus):
    rows = odd_texts(corpus)
    given = frame(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 4 == 1, "bb"))
    out = language_crf.identify(given, F.lit(True), keep=("doc_id", "text", "score")[:2]).collect()
    assert len(out) == len(rows)
    for r in out:
        lettered = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred in ({"aa", "bb"} if lettered else {"und"}) and 0 <= r.score <= 1
    nothing = language_crf.identify(given.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = language_crf.identify(given.withColumn("lang", F.lit("aa")), F.lit(True)).collect()
    assert {r.lang_pred for r in one} == {"aa", "und"}
    assert language_crf.identify(spark.createDataFrame([], f"{SCHEMA}, lang string"), F.lit(True)).collect() == []


@pytest.mark.parametrize("operator", [nb_svm.classify, toxic_spans.detect])
def test_scores_of_odd_texts(spark, frame, corpus, operator):
    rows = odd_texts(corpus)
    given = frame(rows)
    marked = [(k, int("passage" in (t or "") or k % 3 == 0)) for k, t in rows if k is not None and k % 2 == 0]
    labels = spark.createDataFrame([*marked, (None, 1), (2, None), (999, 1)], "doc_id long, good int")
    out = operator(given, labels, "good", always).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    # no label may be learned from, or only one kind of them
    assert len({r.score for r in operator(given, labels, "good", never).collect()}) == 1
    alike = operator(given, labels.withColumn("good", F.lit(1)), "good", always).collect()
    assert len({r.score for r in alike}) == 1 and alike[0].score > 0.5
    empty = spark.createDataFrame([], SCHEMA)
    assert operator(empty, labels, "good", always).collect() == []
    assert operator(given, spark.createDataFrame([], "doc_id long, good int"), "good", always).count() == len(rows)


def test_folds_match_zlib(spark):
    import zlib

    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


URLS = [
    "http://a.com", "http://a.com/", "https://example.com/en/x", "https://EXAMPLE.com/en/x", "http://www.example.com/en/",
    "http://m.www.example.com/en/y?z", "http://notexample.com/en/", "http://x.net/es/1", "net/es/", "http://net/fr/#a",
    "http://net/de/", "ftp://b.org?x=/net/es/", "a://b://c.com/", "://com/", "http://com.net/fr", "", None, "no scheme", "http://com/\nx",
]


def plain_judgement(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for rule in queries.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_rules_of_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in url_trees.judge(pages, queries.RULES).collect():
        assert (r.host, r.path, r.rule) == plain_judgement(URLS[r.page_id]), URLS[r.page_id]
        assert r.verdict == (queries.RULES[r.rule] if r.rule else r.verdict) and r.verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    out = queries.QUERIES["op5_boosted_url_trees"](spark, SF_DIR).toPandas()
    known = out[out["rule"].notna()]
    said = np.where(known["score"] >= 0.5, "block", "allow")
    assert (said == known["verdict"]).mean() > 0.95 and len(out) == 250
    # what no rule says follows what the rules say of its like
    spanish = out[out["rule"].isna() & out["path"].str.startswith("/es/")]
    assert set(out["verdict"]) == {"allow", "block"} and len(spanish) > 0


def test_urls_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, "http://b.org/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_trees.judge(none, queries.RULES).collect()} == {"allow"}
    assert url_trees.judge(none.where("page_id > 5"), queries.RULES).collect() == []
    blocked = spark.createDataFrame([(1, "http://b.org/x"), (2, "http://b.net/es/")], "page_id long, url string")
    assert {r.verdict for r in url_trees.judge(blocked, queries.RULES).collect()} == {"block"}


def test_entropy(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",)], "u string")
    got = [round(r[0], 6) for r in rows.select(url_trees.entropy(F.col("u"))).collect()]
    assert got == [0.0, 0.0, 1.0, 2.0]


def test_a_small_bound_of_training_urls_keeps_both_classes(spark):
    from tablewarden.llm import url_trees

    urls = [("http://a.net/es/%d" % i, 1.0) for i in range(300)] + [("http://b.com/%d" % i, 0.0) for i in range(97)]
    urls += [("http://a.net/es/hot", 1.0)] * 300 + [(None, None), ("http://c.org/es/1", None)]
    rows = url_trees.with_lexical(spark.createDataFrame(urls, "u string, _label double"), F.col("u"))
    for bound in (2, 50, 200):
        scored = url_trees.block_scores(rows, training_rows=bound)
        assert scored.count() == len(urls)
        by = {r._label: r.s for r in scored.groupBy("_label").agg(F.avg("score").alias("s")).collect()}
        assert by[1.0] > 0.7 and by[0.0] < 0.3
    sample = url_trees.training_sample(rows.where("_label is not null").withColumn("_weight", F.lit(1.0)), 50)
    sizes = {r._label: (r.n, round(r.w)) for r in sample.groupBy("_label").agg(F.count("*").alias("n"), F.sum("_weight").alias("w")).collect()}
    assert sizes[0.0][0] == 20 and sizes[1.0][0] <= 50 and (sizes[0.0][1], sizes[1.0][1]) == (97, 600)


def test_the_lexicon_takes_rarer_words_where_fewer_are_tested():
    rng = np.random.Generator(np.random.PCG64(2))
    for tests, seen in ((200, 8), (200_000, 16)):
        no = rng.binomial(9_000, 0.002, tests)
        yes = rng.binomial(1_000, 0.002, tests)
        no[0], yes[0] = 0, seen
        found = toxic_spans.lexicon(no, yes, 9_000, 1_000)
        assert found[0] and found.sum() <= 3
    assert toxic_spans.least_statistic(100) < 13 < 27 < toxic_spans.least_statistic(1 << 18) < 40
