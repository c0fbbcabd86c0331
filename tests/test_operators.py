"""Each check has to find planted defects, and count NULL and repeated keys rightly."""

import datetime as dt
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewarden.operators import consistency, key_checks, policy, row_checks, statistics
from tablewarden.operators.fused import (
    MAX_PER_SCAN,
    count_bad_rows,
    count_by_partition,
    count_violations,
    empty_table,
)
from tablewarden.sources.tables import list_files

FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
KEYS = st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from(["a", "b", None])), max_size=30)


def bad(df, predicate):
    return count_bad_rows(df, predicate).first().violations


def only(df):
    return df.first().violations


def test_row_checks_find_bad_values_and_pass_null(values):
    text = values(["ABC", "abc", "12", "1.5", " Unknown ", None])
    assert bad(text, row_checks.missing("v")) == 1
    assert bad(text, row_checks.wrong_case("v", "upper")) == 2
    assert bad(text, row_checks.wrong_case("v", "lower")) == 2
    assert bad(text, row_checks.wrong_length("v", 3, 3)) == 2
    assert bad(text, row_checks.wrong_type("v", "int")) == 4
    assert bad(text, row_checks.wrong_type("v", "double")) == 3
    assert bad(text, row_checks.is_unknown("v", ["UNKNOWN", "n/a"])) == 1
    assert bad(text, row_checks.not_in_set("v", ["ABC", "abc"])) == 3
    assert bad(text, row_checks.bad_format("v", "^[0-9.]+$")) == 3
    assert bad(text, row_checks.not_numeric("v")) == 4
    assert bad(text, row_checks.not_iso8601("v")) == 5


def test_range_bounds(values):
    numbers = values([1, 5, 10, None], "int")
    assert bad(numbers, row_checks.out_of_range("v", 1, 10)) == 0
    assert bad(numbers, row_checks.out_of_range("v", 2)) == 1
    assert bad(numbers, row_checks.out_of_range("v", high=4)) == 2
    with pytest.raises(ValueError):
        row_checks.out_of_range("v")


def test_ordered_pair(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (None, 2)], "a int, b int")
    assert bad(df, row_checks.out_of_order("a", "b")) == 2
    assert bad(df, row_checks.out_of_order("a", "b", strict=False)) == 1


def test_retention(spark):
    df = spark.sql(
        "SELECT explode(array(timestamp_ntz'2024-01-01', timestamp_ntz'2023-12-31 23:59:59', "
        "timestamp_ntz'2024-01-31')) AS ts"
    )
    assert bad(df, row_checks.too_old("ts", dt.date(2024, 1, 31), 30)) == 1


def test_fused_counts_equal_single_counts(values):
    df = values(list(range(20)), "int")
    checks = {f"below {i}; x": F.col("v") < i for i in range(MAX_PER_SCAN + 30)}
    got = {
        r.check_alias: r.violations
        for r in count_violations(df, checks, {"empty": empty_table()}).collect()
    }
    assert got == {f"below {i}; x": min(i, 20) for i in range(MAX_PER_SCAN + 30)} | {"empty": 0}
    nothing = count_violations(df.where("v < 0"), {"a": F.col("v") > 0}, {"empty": empty_table()})
    assert {r.check_alias: r.violations for r in nothing.collect()} == {"a": 0, "empty": 1}


def test_counts_by_partition(spark):
    df = spark.createDataFrame([("p", 1), ("p", 9), ("q", 1), (None, 9)], "part string, v int")
    got = count_by_partition(df, "part", {"high": F.col("v") > 5, "any": F.lit(True)})
    assert {(r.partition_value, r.check_alias, r.violations) for r in got.collect()} == {
        ("p", "high", 1),
        ("p", "any", 2),
        ("q", "high", 0),
        ("q", "any", 1),
        (None, "high", 1),
        (None, "any", 1),
    }


@FEW
@given(KEYS)
def test_uniqueness_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k int, l string")
    counts = Counter(r for r in rows if None not in r)
    assert only(key_checks.uniqueness_violations(df, ["k", "l"])) == sum(
        n - 1 for n in counts.values()
    )
    assert {
        (r.k, r.l): r.n for r in key_checks.duplicate_keys(df, ["k", "l"]).collect()
    } == {k: n for k, n in counts.items() if n > 1}


@FEW
@given(KEYS, KEYS)
def test_foreign_key_against_brute_force(spark, child, parent):
    children = spark.createDataFrame(child, "k int, l string")
    parents = spark.createDataFrame(parent, "pk int, pl string")
    lost = [r for r in child if None not in r and r not in parent]
    got = key_checks.foreign_key_violations(children, parents, ["k", "l"], ["pk", "pl"])
    assert only(got) == len(lost)
    assert {
        (r.k, r.l): r.n
        for r in key_checks.orphan_keys(children, parents, ["k", "l"], ["pk", "pl"]).collect()
    } == Counter(lost)


def test_a_table_loaded_twice_scores_its_rows(spark):
    df = spark.range(50).selectExpr("id AS k")
    assert only(key_checks.uniqueness_violations(df.unionByName(df), ["k"])) == 50


def test_key_held_by_a_third_of_the_rows(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, id) AS k")
    parent = spark.range(3000).selectExpr("id AS k").where("k <> 7")
    assert only(key_checks.uniqueness_violations(df, ["k"])) == 999
    assert only(key_checks.foreign_key_violations(df, parent, ["k"])) == 1001


def test_self_reference(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id int, boss int")
    assert only(key_checks.foreign_key_violations(df, df, ["boss"], ["id"])) == 1


def test_ordered_pair_across_tables(spark):
    starts = spark.createDataFrame([(1, 10), (1, 12), (2, 5), (3, None)], "k int, a int")
    stops = spark.createDataFrame(
        [(1, 11), (1, 13), (2, 5), (2, None), (3, 1), (4, 1)], "k int, b int"
    )
    got = key_checks.ordered_pair_violations(starts, stops, ("k", "k"), "a", "b")
    assert only(got) == 2
    got = key_checks.ordered_pair_violations(starts, stops, ("k", "k"), "a", "b", strict=False)
    assert only(got) == 1


@pytest.fixture
def joins_without_broadcast(spark):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_frequent_key_of_an_ordered_pair_is_split(spark, joins_without_broadcast):
    starts = spark.range(0, 2000, 1, 4).selectExpr("id AS k", "10 AS a")
    stops = spark.range(0, 600000, 1, 8).selectExpr(
        "IF(id % 3 = 0, 7, id % 2000) AS k", "IF(id < 11, id, xxhash64(id) & 4095 | 4096) AS b"
    )
    got = key_checks.ordered_pair_violations(starts, stops, ("k", "k"), "a", "b")
    assert got.collect()[0].violations == 11
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()


def test_frequent_check_of_a_score_join_is_split(spark, joins_without_broadcast):
    from tablewarden.plans.scores import score_results

    results = spark.range(0, 600000, 1, 8).selectExpr(
        "'i' AS instance_name",
        "'d' AS database_name",
        "'t' AS table_name",
        "IF(id % 3 = 0, 'hot', concat('c', id % 500)) AS check_name",
        "xxhash64(id) AS check_violation_cnt",
    )
    tables = spark.sql(
        "SELECT 'i' AS instance_name, 'd' AS database_name, 't' AS table_name, 5D AS avg_rows, "
        "'' AS partition_key, 'full' AS table_mode"
    )
    checks = spark.range(501).selectExpr(
        "'i' AS instance_name",
        "'d' AS database_name",
        "'t' AS table_name",
        "IF(id = 500, 'hot', concat('c', id)) AS check_name",
        "'rows' AS violation_unit",
        "'low' AS severity",
        "'quality' AS policy_type",
        "'full' AS config_mode",
    )
    got = score_results(results, tables, checks).agg(F.count("check_scope").alias("n"))
    assert got.collect()[0].n == 600000
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()


def test_unfolded_dimensions_of_a_score_join_are_no_broadcast(spark):
    """Their size is guessed from the rows before they are unfolded: 200 stand for 10,000 tables."""
    from tablewarden.plans.scores import score_results

    place = ["'i' AS instance_name", "'d' AS database_name", "concat('t', t) AS table_name"]
    unfolded = spark.range(0, 200, 1, 2).selectExpr("explode(sequence(id * 50, id * 50 + 49)) AS t")
    results = spark.range(0, 20000, 1, 4).selectExpr("id % 10001 AS t", "1L AS v").selectExpr(
        *place, "'c' AS check_name", "v AS check_violation_cnt"
    )
    tables = unfolded.selectExpr(
        *place, "5D AS avg_rows", "CAST(NULL AS STRING) AS partition_key", "'full' AS table_mode"
    )
    checks = unfolded.selectExpr(
        *place, "'c' AS check_name", "'rows' AS violation_unit", "'high' AS severity",
        "'quality' AS policy_type", "'full' AS config_mode",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        got = score_results(results, tables, checks).groupBy("check_scope", "check_severity_score").count()
        assert {tuple(r) for r in got.collect()} == {(20.0, 20, 19999), (None, None, 1)}
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reference_check_counts_before_it_shuffles(spark):
    child = spark.range(9).selectExpr("id % 2 AS k")
    plan = key_checks.foreign_key_violations(child, child, ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1


def test_not_empty(spark):
    assert only(key_checks.not_empty_violations(spark.range(3))) == 0
    assert only(key_checks.not_empty_violations(spark.range(0))) == 1


def test_base_vs_summary(spark):
    base = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 1.0), (None, 1.0)], "k string, v double")
    summary = spark.createDataFrame(
        [("a", 3.0), ("b", 5.2), ("d", 0.0), ("e", 1.0), ("e", 1.0), (None, 1.0)],
        "g string, t double",
    )

    def found(tolerance=None):
        rows = consistency.base_vs_summary(base, summary, ["k"], ["g"], F.col("v"), "t", tolerance)
        return {r.g: r.problem for r in rows.collect()}

    others = {"c": "missing in summary", "d": "missing in base", "e": "missing in base"}
    assert found() == others | {"b": "different"}
    assert found(0.5) == others


def test_repeated_summary_group(spark):
    base = spark.createDataFrame([("a", 2)], "k string, v int")
    summary = spark.createDataFrame([("a", 2), ("a", 2)], "k string, t int")
    rows = consistency.base_vs_summary(base, summary, ["k"], ["k"], F.col("v"), "t").collect()
    assert [r.problem for r in rows] == ["repeated in summary"]


def test_peer_row_count(spark):
    row = consistency.peer_row_count(spark.range(5), spark.range(8)).first()
    assert (row.n_table, row.n_peer, row.violations) == (5, 8, 3)
    assert consistency.peer_row_count(spark.range(0), spark.range(0)).first().violations == 0


def test_sample_share(spark):
    df = spark.range(20000)
    for share in (0.05, 0.5):
        n = df.where(consistency.in_sample(["id"], share)).count()
        assert abs(n / 20000 - share) < 0.02
    assert df.where(consistency.in_sample(["id"], 1)).count() == 20000
    with pytest.raises(ValueError):
        consistency.in_sample(["id"], 0)


def test_spot_check_fields(spark):
    a = spark.createDataFrame(
        [(1, "x", 1), (2, "x", 1), (3, None, 1), (4, "x", 1), (5, "x", None)], "k int, f string, g int"
    )
    b = spark.createDataFrame(
        [(1, "x", 1), (2, "y", 1), (3, None, 1), (5, "x", 3), (6, "x", 1)], "k int, f string, g int"
    )
    rows = consistency.peer_spot_check(a, b, ["k"], ["f", "g"], 1).collect()
    assert {r.k: (r.n_table, r.n_peer, r.fields_differing) for r in rows} == {
        2: (1, 1, "f"),
        4: (1, 0, "f,g"),
        5: (1, 1, "g"),
        6: (0, 1, "f,g"),
    }


@FEW
@given(KEYS, KEYS)
def test_target_vs_source_is_except_all(spark, left, right):
    a = spark.createDataFrame(left, "k int, l string")
    b = spark.createDataFrame(right, "k int, l string")
    missing = Counter(left) - Counter(right)
    extra = Counter(right) - Counter(left)
    rows = consistency.target_vs_source(a, b).collect()
    assert {(r.k, r.l): r.n_missing for r in rows if r.n_missing} == missing
    assert {(r.k, r.l): r.n_extra for r in rows if r.n_extra} == extra
    total = consistency.count_differences(consistency.target_vs_source(a, b)).first()
    assert total.violations == sum(missing.values()) + sum(extra.values())


def test_rows_with_maps_compare(spark):
    a = spark.sql("SELECT 1 AS k, map('x', 1, 'y', 2) AS m")
    b = spark.sql("SELECT 1 AS k, map('y', 2, 'x', 1) AS m")
    assert consistency.target_vs_source(a, b).count() == 0
    assert consistency.target_vs_source(a, spark.sql("SELECT 1 AS k, map('x', 1) AS m")).count() == 2


def test_outliers(values):
    df = values([1.0] * 50 + [2.0] * 50 + [100.0, None], "double")
    assert bad(df, statistics.outliers(df, "v", 3)) == 1


def test_profiles_agree(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.5), (2, "b", None), (2, None, 2.5)], "i int, s string, d double"
    )
    exact = {r.column_name: r for r in statistics.profile_exact(df).collect()}
    quick = {r.column_name: r for r in statistics.profile(df).collect()}
    assert (exact["d"].n_rows, exact["d"].n_null, exact["d"].n_distinct, exact["d"].avg_value) == (
        3,
        1,
        2,
        2.0,
    )
    assert (exact["s"].min_value, exact["s"].max_value, exact["s"].avg_value) == ("a", "b", None)
    for name in df.columns:
        assert quick[name].asDict() == exact[name].asDict()


def test_profile_of_a_wide_table(spark):
    df = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(40)])
    assert statistics.profile(df).count() == 40


def test_profile_of_an_empty_table(spark):
    row = statistics.profile_exact(spark.range(0)).first()
    assert (row.n_rows, row.n_null, row.n_distinct, row.min_value) == (0, 0, 0, None)


def test_statistics_exist_and_are_fresh(spark):
    profiles = spark.sql(
        "SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01'), ('a', timestamp_ntz'2024-01-20'), "
        "('b', timestamp_ntz'2024-01-01') AS t(table_name, run_start_timestamp)"
    )
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "table_name string")
    assert [r.table_name for r in statistics.stats_missing(expected, profiles).collect()] == ["c"]
    stale = statistics.stats_stale(profiles, dt.datetime(2024, 1, 31), 14).collect()
    assert [r.table_name for r in stale] == ["b"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.parquet").write_bytes(b"x" * 100)
    (tmp_path / "sub" / "b.PARQUET").write_bytes(b"x" * 10)
    (tmp_path / "c.csv").write_bytes(b"x" * 5)
    (tmp_path / "noext").write_bytes(b"x" * 200)
    files = list_files(spark, str(tmp_path))
    got = policy.audit_files(
        files, small=policy.too_small(50), format=policy.wrong_extension("parquet")
    )
    assert {(r.check_alias, r.n_files, r.violations) for r in got.collect()} == {
        ("small", 4, 2),
        ("format", 4, 2),
    }
