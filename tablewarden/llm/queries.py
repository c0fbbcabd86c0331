"""The corpus operators as registered queries on the given tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import (
    curve_packing,
    fm_decontam,
    heavy_dedup,
    importance,
    jaccard_join,
    language_crf,
    line_runs,
    nb_svm,
    phrase_automata,
    toxic_spans,
    turn_repair,
    two_fit_packing,
    url_trees,
)
from tablewarden.llm.common import fold
from tablewarden.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_heavy_split_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    return heavy_dedup.exact_groups(docs).drop("n_chars_original")


ORACLES["op2_heavy_split_dedup"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
d AS (SELECT doc_id, length(body) AS n, sha256(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS place,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""


#: Fixed values of the query.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


@query
def op5_boosted_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(read_table(spark, "pages", directory=sf_dir).select("page_id", "url"), RULES)


@query
def op10_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    out = line_runs.line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op10_levelled_line_runs"] = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS pos FROM t),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
j AS (SELECT k.doc_id, pos, line, length(k.key) < 10 OR k.doc_id = first AS stays FROM k JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@query
def op4_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    labels = read_table(spark, "labels", directory=sf_dir).select("doc_id", "quality")
    out = nb_svm.classify(docs, labels, "quality", lambda key: fold(key, 5) != 0)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", decided())


def decided():
    return (F.col("score") >= 0.3).cast("int").alias("predicted")


@query
def op3_crf_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    labels = read_table(spark, "labels", directory=sf_dir).select("doc_id", "toxic")
    out = toxic_spans.detect(docs, labels, "toxic", lambda key: fold(key, 4) != 2)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", decided(), "spans")


@query
def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    out = language_crf.identify(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    return curve_packing.pack(docs, default_tokenizer(), ranks=default_ranks())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> tuple[str, str]:
    """The same vocabulary as a tiktoken file, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    found = fm_decontam.find_contamination(docs, read_table(spark, "benchmark", directory=sf_dir))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLES["op6_fm_index_decontamination"] = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM low, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, i, n, win FROM dw WHERE win IN (SELECT win FROM bw)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m)
    GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m JOIN bw USING (win, n)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    out = phrase_automata.substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op8_phrase_automata"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM t WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM s WHERE win IN (SELECT win FROM s GROUP BY win HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS pos FROM r),
p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM t),
k AS (SELECT p.doc_id, p.pos, p.word, g.pos IS NOT NULL AS gone FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
    FROM k GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN a ON t.doc_id = a.doc_id
"""


@query
def op7_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    return jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


ORACLES["op7_heavy_light_jaccard"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
    GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""


@query
def op11_automaton_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    out = importance.resample(docs, read_table(spark, "benchmark", directory=sf_dir))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op11_automaton_resampling"] = r"""
WITH RECURSIVE table_of AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
    FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 255)) AS i)),
texts AS (SELECT row_number() OVER () AS r, doc_id, FALSE AS target, text FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, TRUE, text FROM benchmark),
w AS MATERIALIZED (SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT r, target, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1),
        lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM w),
d AS (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM f),
b AS MATERIALIZED (SELECT feature, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
        list_transform(generate_series(1, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
        lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d, table_of),
n AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f JOIN b USING (feature)
    GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM n) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM n) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n),
m AS (SELECT r, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
    FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE NOT target GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')),
        1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
    FROM w LEFT JOIN m USING (r) WHERE NOT target),
k AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place
    FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM c WHERE n_words >= 20) // 100
    THEN place END AS rank FROM k
"""


@query
def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, "documents", directory=sf_dir).select("doc_id", "text")
    return two_fit_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_grammar_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, "conversations", directory=sf_dir).select("conv_id", "turn", "role", "text")
    return turn_repair.repair(turn_repair.damaged(rows), present="present")


ORACLES["op13_grammar_turn_repair"] = r"""
WITH RECURSIVE table_of AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
    FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 255)) AS i)),
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
marked AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    list_transform(generate_series(1, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS m FROM base, table_of),
hurt AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(generate_series(1, CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy FROM marked WHERE m <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
q AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    right(body, 1) NOT IN ('.', '!', '?') AS cut, substr(role, 1, 1) AS i,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
s AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND cut THEN 1 ELSE 0 END AS e FROM q),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, CAST(sum(e) AS BIGINT) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id),
x AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {'c': CAST(0 AS BIGINT), 'a': ''} AS x0,
        {'c': CAST(1000000000 AS BIGINT), 'a': 'Z'} AS x1, {'c': CAST(1000000000 AS BIGINT), 'a': 'Z'} AS x2,
        {'c': CAST(1000000000 AS BIGINT), 'a': 'Z'} AS x3 FROM counts
    UNION ALL
    SELECT conv_id, n, {'c': x0.c + 3, 'a': x0.a || 'D'},
        least({'c': x1.c + 3, 'a': x1.a || 'D'}, {'c': x0.c + e + CASE WHEN gone OR i <> 's' THEN 1000000000 ELSE 0 END, 'a': x0.a || 'K'}),
        least({'c': p2.c + 3, 'a': p2.a || 'D'},
            {'c': o2.c + e + CASE WHEN gone OR i <> 'u' THEN 1000000000 ELSE 0 END, 'a': o2.a || 'K'},
            {'c': o2.c + e + 2 + CASE WHEN gone THEN 1000000000 ELSE 0 END, 'a': o2.a || 'R'}),
        least({'c': p3.c + 3, 'a': p3.a || 'D'},
            {'c': p2.c + e + CASE WHEN gone OR i <> 'a' THEN 1000000000 ELSE 0 END, 'a': p2.a || 'K'},
            {'c': p2.c + e + 2 + CASE WHEN gone THEN 1000000000 ELSE 0 END, 'a': p2.a || 'R'})
    FROM (SELECT s.conv_id, s.n, s.gone, s.e, s.i, x0, x1,
            least(x2, {'c': x0.c + 2, 'a': x0.a || 'I'}, {'c': x1.c + 2, 'a': x1.a || 'I'}, {'c': x3.c + 2, 'a': x3.a || 'I'}) AS p2,
            least(x3, {'c': x2.c + 2, 'a': x2.a || 'I'}, {'c': x0.c + 4, 'a': x0.a || 'II'}, {'c': x1.c + 4, 'a': x1.a || 'II'}) AS p3,
            least(x0, x1, x3, {'c': x2.c + 2, 'a': x2.a || 'I'}) AS o2
        FROM x JOIN s ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.n = x.n + 1)),
best AS (SELECT conv_id, arg_max(least(x0, x3, {'c': x2.c + 2, 'a': x2.a || 'I'}, {'c': x1.c + 4, 'a': x1.a || 'II'}), n) AS b
    FROM x GROUP BY conv_id),
edits AS (SELECT conv_id, unnest(generate_series(1, len(b.a))) AS pos, b.a AS a FROM best),
steps AS (SELECT conv_id, pos, substr(a, pos, 1) AS edit, len(replace(substr(a, 1, pos), 'I', '')) AS n FROM edits),
lines AS (SELECT t.conv_id, pos, edit, role, text, i, row_number() OVER (PARTITION BY t.conv_id ORDER BY pos) AS m
    FROM steps t LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.n = t.n WHERE edit <> 'D'),
led AS (SELECT *, max(CASE WHEN m = 1 AND edit = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM lines),
fixed AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS fixed FROM led GROUP BY conv_id),
k AS (SELECT DISTINCT conv_id FROM conversations)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
    sha256(coalesce(fixed, '')) AS repaired_sha256
FROM k LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id
    LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM k.conv_id
"""
