"""URL filter: rules first, gradient-boosted trees on lexical features for what no rule fits.

The trees are trained from labelled URLs; :func:`judge` labels them by the rules. All features are built-in
expressions, so URLs are scored in the plan of the scan.

Defined results: NULL, empty text and text without ``://`` have an empty host and path and fit no rule; the
trees judge them by what is left of their features. Without any labelled URL every other URL is allowed; if
all labels agree, that verdict holds. Repeated rows are judged alike. An empty table gives an empty result. Very long
URLs are read whole; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import LEAST_ROWS, stored

#: Bound of the distinct URLs the trees are fitted on; beyond it, of each class those with the smallest hash.
TRAINING_ROWS = 500_000
#: Statistics of host suffixes are kept for so many hash buckets: the bound of what is broadcast.
SUFFIX_BUCKETS = 8192

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_host_dots", "f_digits", "f_hyphens", "f_upper",
    "f_entropy", "f_parameters", "f_query_length", "f_fragment", "f_secure", "f_segment", "f_tld_rate",
    "f_tld_seen", "f_domain_rate", "f_domain_seen", "f_pair_rate", "f_pair_seen",
]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``; path: from there up to ``?``, ``#``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else NULL. A rule ``net/es/`` is host ``net`` and path ``/es/``."""
    fitting = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        of_host = (host == name) | F.endswith(host, F.lit(f".{name}"))
        fitting.append(F.when(of_host & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fitting, F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits per character of the text's characters."""
    n = F.char_length(text).cast("double")
    shares = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    )
    bits = F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def share_of(text: Column, pattern: str) -> Column:
    n = F.char_length(text)
    left = F.char_length(F.regexp_replace(text, pattern, ""))
    return F.when(n > 0, (n - left) / n).otherwise(F.lit(0.0))


def count_of(text: Column, mark: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))


def bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(SUFFIX_BUCKETS)).cast("int")


def with_lexical(pages: DataFrame, url: Column) -> DataFrame:
    """Adds host, path and the features that need no labels."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_and_path(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    parsed = pages.withColumns({"_url": text, "host": host, "path": path, "_query": query})
    labels = F.split("host", r"\.")
    first = F.regexp_extract("path", "^/([^/]*)", 1)
    numbers = {
        "f_length": F.char_length("_url"),
        "f_host_length": F.char_length("host"),
        "f_path_length": F.char_length("path"),
        "f_depth": count_of(F.col("path"), "/"),
        "f_host_dots": count_of(F.col("host"), "."),
        "f_digits": share_of(F.col("_url"), "[0-9]"),
        "f_hyphens": share_of(F.col("_url"), "[-_]"),
        "f_upper": share_of(F.col("_url"), "[A-Z]"),
        "f_entropy": entropy(F.col("_url")),
        "f_parameters": F.when(F.col("_query") == "", 0).otherwise(count_of(F.col("_query"), "&") + 1),
        "f_query_length": F.char_length("_query"),
        "f_fragment": F.contains("_url", F.lit("#")),
        "f_secure": F.startswith("_url", F.lit("https:")),
        "f_segment": F.char_length(first),
    }
    suffixes = {
        "_tld": bucket(F.lit("tld"), F.element_at(labels, -1)),
        "_domain": bucket(F.lit("domain"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")),
        "_pair": bucket(F.lit("pair"), F.element_at(labels, -1), first),
    }
    return parsed.withColumns({k: v.cast("double") for k, v in numbers.items()} | suffixes)


def suffix_statistics(labelled: DataFrame, prior: float) -> DataFrame:
    """Block rate (smoothed to the prior) and log count of each suffix bucket: at most SUFFIX_BUCKETS rows."""
    each = labelled.select("_label", F.explode(F.array("_tld", "_domain", "_pair")).alias("_bucket"))
    return each.groupBy("_bucket").agg(
        ((F.sum("_label") + 10 * prior) / (F.count("*") + 10)).alias("rate"), F.log1p(F.count("*")).alias("seen")
    )


def with_suffixes(pages: DataFrame, statistics: DataFrame, prior: float) -> DataFrame:
    for name in ("tld", "domain", "pair"):
        side = statistics.select(
            F.col("_bucket").alias(f"_{name}"), F.col("rate").alias(f"f_{name}_rate"), F.col("seen").alias(f"f_{name}_seen")
        )
        pages = pages.join(F.broadcast(side), f"_{name}", "left")
    return pages.fillna({f"f_{n}_rate": prior for n in ("tld", "domain", "pair")}).fillna(
        {f"f_{n}_seen": 0.0 for n in ("tld", "domain", "pair")}
    )


def training_sample(known: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` labelled URLs, at least :data:`LEAST_ROWS` of each class if there are as many.

    Copies of a URL are one row with their number as weight; those with the smallest hash are taken, of each class
    its share of the distinct URLs. What a row is taken for is spread over the weights of its class.
    """
    columns = [c for c in known.columns if c not in ("_url", "_label", "_weight")]
    once = known.groupBy("_url", "_label").agg(
        F.count("*").cast("double").alias("_weight"), F.first(F.struct(*columns)).alias("_rest")
    )
    once = stored(once.withColumn("_order", F.xxhash64(F.lit("training"), "_url")))
    sizes = {r["_label"]: (r["n"], r["w"]) for r in once.groupBy("_label").agg(F.count("*").alias("n"), F.sum("_weight").alias("w")).collect()}
    total, parts = sum(n for n, _ in sizes.values()), []
    for label, (n, weight) in sorted(sizes.items()):
        taken = min(n, max(LEAST_ROWS, rows * n // total))
        some = stored(once.where(F.col("_label") == label).orderBy("_order", "_url").limit(taken))
        share = some.agg(F.sum("_weight")).first()[0] / weight
        parts.append(some.withColumn("_weight", F.col("_weight") / share))
    return parts[0].unionByName(parts[1]).select("_url", "_label", "_weight", "_rest.*")


def block_scores(pages: DataFrame, rounds: int = 10, depth: int = 4, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Adds ``score`` (1: block) to URLs with features; ``_label`` is 1.0 (block), 0.0 (allow) or NULL."""
    known = pages.where(F.col("_label").isNotNull())
    n, blocked = known.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    if n == 0 or blocked in (0, n):
        return pages.withColumn("score", F.lit(1.0 if n and blocked == n else 0.0))
    prior = blocked / n
    statistics = stored(suffix_statistics(known, prior))
    full = with_suffixes(pages, statistics, prior)
    known = known.withColumn("_weight", F.lit(1.0))
    if n > training_rows:
        known = training_sample(known, training_rows)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    sample = stored(assemble.transform(with_suffixes(known, statistics, prior)).select("_features", "_label", "_weight"))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7,
    ).fit(sample)
    scored = trees.transform(assemble.transform(full))
    return scored.withColumn("score", vector_to_array("probability")[1])


def judge(
    pages: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", threshold: float = 0.5
) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, score (of the trees)."""
    rows = with_lexical(pages.select(F.col(key), F.col(url).cast("string").alias("_given")), F.col("_given"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()])
    rows = rows.withColumn("_said", said).withColumn("_label", (F.col("_said") == "block").cast("double"))
    judged = block_scores(rows)
    by_trees = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select(F.col(key), "host", "path", "rule", F.coalesce("_said", by_trees).alias("verdict"), "score")
