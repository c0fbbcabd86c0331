"""Exact, near, substring and line deduplication against brute force."""

import brute
import numpy as np
import pandas as pd
import pytest
from brute import SCHEMA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewarden.llm import heavy_dedup, jaccard_join, line_runs, phrase_automata, words
from tablewarden.llm.common import stored
from tablewarden.llm.components import components


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("counters", [1, 3, 512])
def test_exact_groups(frame, corpus, counters):
    got = heavy_dedup.exact_groups(frame(corpus), counters=counters)
    # rows that agree in key and text are interchangeable, so only how many of them stay is fixed
    assert tuples(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == ordered(brute.exact(corpus))


def test_exact_dedup_returns_whole_rows(frame, corpus):
    given = frame(corpus)
    out = heavy_dedup.exact_dedup(given)
    assert out.columns == given.columns
    texts = dict(enumerate(corpus))
    kept = [row for row, x in zip(texts.values(), brute_flags(corpus), strict=True) if x]
    assert tuples(out, "doc_id", "text") == ordered(kept)


def brute_flags(rows):
    best = {}
    for at, (key, text) in enumerate(rows):
        digest = brute.sha(brute.WHITE.sub("", text or ""))
        best.setdefault(digest, []).append((-len(text or ""), brute.last(key), at))
    stay = {min(v)[2] for v in best.values()}
    return [at in stay for at in range(len(rows))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=40), max_size=8), st.integers(1, 5))
def test_misra_gries_keeps_every_frequent_value(parts, counters):
    total = pd.Series(dtype="int64")
    for part in parts:
        held = heavy_dedup.reduce_counters(pd.Series(part, dtype="int64").value_counts(), counters)
        total = heavy_dedup.reduce_counters(total.add(held, fill_value=0), counters)
    flat = [x for part in parts for x in part]
    assert len(total) <= counters
    for value in set(flat):
        if flat.count(value) * (counters + 1) > len(flat):
            assert value in total.index


@pytest.mark.parametrize("buckets", [1, 6])
def test_near_components(frame, corpus, small_batches, buckets):
    got = jaccard_join.jaccard_components(frame(corpus), buckets=buckets)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == ordered(brute.near(corpus))


def test_near_components_of_chains(frame):
    # each text is linked with the next one only, so a component's ends share little
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[i * 4 : i * 4 + 60])) for i in range(40)]
    rows += [(100 + i, " ".join(base[i : i + 9])) for i in range(20)]
    got = jaccard_join.jaccard_components(frame(rows))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == ordered(brute.near(rows))


def test_no_link_is_lost_at_any_boundary(spark, frame, corpus, monkeypatch):
    expected = ordered(brute.near(corpus))
    for x in (0, 20, 100_000):
        monkeypatch.setattr(jaccard_join, "boundary", lambda sets, x=x: x)
        got = jaccard_join.jaccard_components(frame(corpus))
        assert tuples(got, "doc_id", "n_shingles", "component_id") == expected


def test_no_link_is_lost_in_small_blocks(spark, frame, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    base = [f"b{i}" for i in range(60)]
    rows = list(corpus)
    for i in range(40):  # near copies on the border of a link: changed words cost five shingles each
        copy = list(base)
        for j in range(i % 4):
            copy[(i * 7 + j * 19) % 60] = f"x{i}-{j}"
        rows.append((700 + i, " ".join(copy)))
    got = jaccard_join.jaccard_components(frame(rows))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == ordered(brute.near(rows))


def test_near_dedup_keeps_one_of_each_component(frame, corpus):
    given = frame(corpus)
    out = jaccard_join.near_dedup(given)
    assert out.columns == given.columns
    groups = brute.near([(i, t) for i, (_, t) in enumerate(corpus)])  # components by their roots: keys come twice
    members = {}
    for row, (_, n, root) in zip(corpus, groups, strict=True):
        if n:
            members.setdefault(root, []).append(row)
    blank = [row for row, (_, n, _) in zip(corpus, groups, strict=True) if not n]
    got = tuples(out, "doc_id", "text")
    worded = [r for r in got if r not in blank]
    assert len([r for r in got if r in blank]) == len(blank)
    component = {text: root for root, m in members.items() for _, text in m}
    assert sorted(component[t] for _, t in worded) == sorted(members)
    for key, text in worded:
        group = members[component[text]]
        assert (key, text) in group and brute.last(key) == min(brute.last(k) for k, _ in group)


def test_near_dedup_keeps_components_that_share_a_key_or_have_none(frame, corpus):
    rows = [(None if i % 3 else k, t) for i, (k, t) in enumerate(corpus)]
    rows += [(None, f"a lone text of its own number {i} without any key") for i in range(6)]
    rows += [(1000, f"another lone text that holds {i} under one key") for i in range(4)]
    roots = brute.near([(i, t) for i, (_, t) in enumerate(rows)])
    members = {}
    for row, (_, n, root) in zip(rows, roots, strict=True):
        if n:
            members.setdefault(root, []).append(row)
    got = tuples(jaccard_join.near_dedup(frame(rows)), "doc_id", "text")
    worded = [r for r in got if brute.spaced(r[1])]
    assert len(got) - len(worded) == sum(not n for _, n, _ in roots)
    component = {text: root for root, m in members.items() for _, text in m}
    assert sorted(component[t] for _, t in worded) == sorted(members)
    for key, text in worded:
        group = members[component[text]]
        assert (key, text) in group and brute.last(key) == min(brute.last(k) for k, _ in group)


@pytest.mark.parametrize("buckets", [1, 5])
def test_repeated_passages(frame, corpus, small_batches, buckets):
    got = phrase_automata.substring_dedup(frame(corpus), buckets=buckets)
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept_text") == ordered(brute.repeats(corpus))


def test_passages_that_overlap_and_repeat_inside_one_text(frame):
    w = [f"p{i}" for i in range(90)]
    rows = [(1, " ".join(w[:60] + ["x"] + w[10:50])), (2, " ".join(w[30:90])), (3, " ".join(w[50:85])), (4, " ".join(w[:34]))]
    rows += [(5, " ".join(["a", "b"] * 40)), (6, "a " * 36)]
    got = phrase_automata.substring_dedup(frame(rows))
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept_text") == ordered(brute.repeats(rows))


def test_wide_symbols_match_only_whole_words():
    symbols = np.array([5, 5 + 7 * phrase_automata.SYMBOLS, 0xD800, 3])
    text = phrase_automata.symbol_text(symbols, True)
    assert len(text) == 8 and len(phrase_automata.symbol_text(symbols[[0, 2]], False)) == 2


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (4, 2), (5, 3)])
def test_lines(frame, corpus, batches, fan):
    got = line_runs.line_dedup(frame(corpus), batches=batches, fan=fan)
    assert tuples(got, "doc_id", "n_lines", "n_dropped", "kept_text") == ordered(brute.lines(corpus))


def test_runs_are_merge_joined_without_a_shuffle_and_without_python(spark, frame, corpus):
    docs = frame(corpus, clash=False).select(
        F.col("doc_id").alias("_key"), F.coalesce("text", F.lit("")).alias("_text"), F.xxhash64("text").alias("_hash")
    )
    lines = stored(line_runs.document_lines(docs, 10))
    runs = line_runs.Runs(lines, 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    firsts = stored(lines.groupBy("h1", "h2").agg(F.min("_key").alias("first")))
    runs.add(runs.dealt(firsts.where("h1 % 3 = 0")))
    runs.add(runs.dealt(firsts.where("h1 % 3 = 1")))
    left = runs.unseen(runs.dealt(firsts))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1
    assert plan.count("Bucketed: true") == 2
    assert "Python" not in plan and "Arrow" not in plan
    assert left.count() == firsts.where("h1 % 3 not in (0, 1)").count()
    runs.forget()


def test_compaction_keeps_levels_small(frame, corpus, monkeypatch):
    seen = []
    add = line_runs.Runs.add

    def watched(self, run):
        out = add(self, run)
        seen.append([len(level) for level in self.levels])
        return out

    monkeypatch.setattr(line_runs.Runs, "add", watched)
    line_runs.line_dedup(frame(corpus), batches=5, fan=2).collect()
    assert seen == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 120)] + [(7, 7), (205, 203), (203, 204)]
    got = dict(tuples(components(spark.createDataFrame(links, "a long, b long")), "node", "label"))
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 120))
    assert got[205] == got[203] == got[204] == 203


@pytest.mark.parametrize("order", ["random", "far", "zigzag"])
def test_components_of_long_paths(spark, order):
    n = 700
    path = {
        "random": np.random.Generator(np.random.PCG64(3)).permutation(n).tolist(),
        "far": [0, *range(n - 1, 0, -1)],
        "zigzag": [i // 2 if i % 2 else n - 1 - i // 2 for i in range(n)],
    }[order]
    links = [*zip(path, path[1:], strict=False), (n, n + 1)]
    got = dict(tuples(components(spark.createDataFrame(links, "a long, b long")), "node", "label"))
    assert got == {i: 0 for i in range(n)} | {n: n, n + 1: n}


@pytest.mark.parametrize(
    "operator",
    [heavy_dedup.exact_groups, heavy_dedup.exact_dedup, jaccard_join.jaccard_components, jaccard_join.near_dedup,
     phrase_automata.substring_dedup, line_runs.line_dedup],
)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_word_hashes_tell_long_words_apart():
    import pyarrow as pa

    texts = pa.array(["a" * 64 + "b" * 64, "b" * 64 + "a" * 64, "a" * 64, None, "", "a" * 64 + " é"])
    part = words.words_of(texts, words.SPACED)
    assert part.counts.tolist() == [1, 1, 1, 0, 0, 2]
    h = part.hashes()
    assert len(set(h.tolist())) == 4 and h[2] == h[3]


def test_a_text_of_very_many_repeated_lines_takes_seconds(spark):
    import time

    from tablewarden.llm import line_runs

    lines = [f"a line that stands twice {i}" for i in range(200_000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join([*lines, "x", "the last line is new"]))]
    given = spark.createDataFrame(rows, brute.SCHEMA)
    begin = time.monotonic()
    got = {r.doc_id: r for r in line_runs.line_dedup(given).collect()}
    assert time.monotonic() - begin < 60
    assert (got[1].n_dropped, got[2].n_dropped, got[2].n_lines) == (0, 100_000, 200_002)
    assert got[1].kept_text == rows[0][1] and got[2].kept_text == "\n".join([*lines[1::2], "x", "the last line is new"])


def test_line_runs_leave_the_catalogue_when_a_job_fails(spark, frame, corpus, monkeypatch):
    from tablewarden.llm import line_runs

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(line_runs.Runs, "unseen", broken)
    with pytest.raises(RuntimeError):
        line_runs.line_dedup(frame(corpus))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]


@pytest.mark.parametrize("files", [False, True])
@pytest.mark.parametrize("dedup", [heavy_dedup.exact_dedup, jaccard_join.near_dedup])
def test_rows_of_one_text_without_a_key_are_spread(spark, apart, tmp_path, dedup, files):
    """A third of the rows is one document under no key; whole rows are dealt by their number."""
    text = "the very same text of more than five words"
    rows = [(None, text) if i % 3 == 0 else (i, f"words of text {i} that no other text has {i * 7}") for i in range(3000)]
    given = spark.createDataFrame(rows, brute.SCHEMA).repartition(6)
    if files:
        given.write.parquet(str(tmp_path / "docs"))
        given = spark.read.parquet(str(tmp_path / "docs"))
    out = dedup(given)
    assert sorted(map(str, out.collect())) == sorted({str(r) for r in given.collect()})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("\n")[1]
    assert "Join LeftSemi" in top and "_row#" in top and "Deduplicate" not in plan
