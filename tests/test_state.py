"""What runs keep beside their history: days, keys, partitions, snapshots; and how results are stored."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import consistency, key_index, statistics
from tablewarden.operators.catalogue import BUILT_IN
from tablewarden.plans import runner
from tablewarden.plans.history import daily, monthly, rollup_levels
from tablewarden.plans.rollups import Rollups
from tablewarden.plans.runner import Run, RunPlan, run_and_store, run_checks
from tablewarden.schema import CHECK_CUSTOM_PREFIX
from tablewarden.sources import results
from tablewarden.sources.partitions import PartitionResults, totals
from tablewarden.sources.registry import parse_registry
from tablewarden.sources.results import compact_results, read_results
from tablewarden.streaming import latest


def entry(name, mode="incremental", **custom):
    return {"check_name": name, "check_mode": mode} | {CHECK_CUSTOM_PREFIX + k: str(v) for k, v in custom.items()}


def setup(name="incremental_window", **custom):
    return {"check_type": "setup", "check_name": name} | {CHECK_CUSTOM_PREFIX + k: str(v) for k, v in custom.items()}


@pytest.fixture
def go(spark, tmp_path):
    """Run checks of table ``t`` in run ``n``; gives the counts by check."""

    def do(n, checks, df, day=None, **options):
        doc = spark.range(1).select(F.lit(json.dumps({"t": checks})).alias("value"))
        at = dt.datetime(2024, 3, 1, 2) + dt.timedelta(days=n if day is None else day)
        rows = run_and_store(spark, parse_registry(doc), {"t": df}, Run("prod", "db", n, at), str(tmp_path / "h"), **options)
        return {r.check_name: (r.check_violation_cnt if r.check_rc == 0 else -r.check_rc) for r in rows.collect()}

    return do


def days(spark, rows):
    """Rows of (day number, key, value)."""
    return spark.createDataFrame(rows, "date_id int, k long, v long")


CHECKS = {
    "w": setup(col="date_id"),
    "low": entry("range", col="v", max=5),
    "null": entry("not_null", cols="k"),
    "uk": entry("rule_uniqueness", cols="k"),
}


def test_late_rows_of_a_day_count_once(spark, go):
    first = [(2024001, 1, 9), (2024001, 2, 1), (2024002, 3, 9), (2024002, 4, 9)]
    late = [(2024002, 5, 9), (2024002, 6, 9), (2024002, 7, 1), (2024001, None, 1)]
    newer = [(2024003, 8, 9)]
    assert go(1, CHECKS, days(spark, first)) == {"w": None, "low": 3, "null": 0, "uk": 0}
    assert go(2, CHECKS, days(spark, first)) == {"w": None, "low": 0, "null": 0, "uk": 0}
    assert go(3, CHECKS, days(spark, first + late)) == {"w": None, "low": 2, "null": 1, "uk": 0}
    assert go(4, CHECKS, days(spark, first + late + newer)) == {"w": None, "low": 1, "null": 0, "uk": 0}
    assert go(5, CHECKS, days(spark, first + late + newer)) == {"w": None, "low": 0, "null": 0, "uk": 0}


def test_late_rows_of_timestamps(spark, go):
    def at(hour, v):
        return (dt.datetime(2024, 1, 2, hour), v)

    def frame(rows):
        return spark.createDataFrame(rows, "ts timestamp_ntz, v long")

    checks = {"w": setup(col="ts"), "low": entry("range", col="v", max=5)}
    assert go(1, checks, frame([at(1, 9), at(6, 9)])) == {"w": None, "low": 2}
    assert go(2, checks, frame([at(1, 9), at(6, 9), at(8, 9)])) == {"w": None, "low": 1}
    assert go(3, checks, frame([at(1, 9), at(6, 9), at(8, 9), at(3, 9), at(9, 1), at(10, 9)])) == {"w": None, "low": 2}


def test_a_check_that_broke_sees_late_rows_in_the_next_run(spark, go):
    catalogue = BUILT_IN.copy()
    broken = []

    @catalogue.add("moody", "row")
    def _moody(ctx):
        if broken:
            raise ValueError("not today")
        return F.col("v") > 5

    checks = {"w": setup(col="date_id"), "low": entry("moody")}
    rows = [(2024001, 1, 9), (2024002, 2, 9)]
    assert go(1, checks, days(spark, rows), catalogue=catalogue) == {"w": None, "low": 2}
    broken.append(1)
    rows.append((2024001, 3, 9))
    assert go(2, checks, days(spark, rows), catalogue=catalogue) == {"w": None, "low": -202}
    broken.clear()
    assert go(3, checks, days(spark, rows), catalogue=catalogue) == {"w": None, "low": 1}


def test_look_back_leaves_old_days_alone(spark, go):
    checks = {"w": setup(col="date_id", look_back_days=3), "low": entry("range", col="v", max=5)}
    rows = [(2024000 + d, d, 9) for d in range(1, 11)]
    assert go(1, checks, days(spark, rows)) == {"w": None, "low": 10}
    rows += [(2024002, 50, 9), (2024009, 51, 9)]
    assert go(2, checks, days(spark, rows)) == {"w": None, "low": 1}


def test_keys_loaded_again_on_a_later_day(spark, go, monkeypatch):
    monkeypatch.setattr(key_index, "MOST_SETS", 2)
    checks = {"w": setup(col="date_id"), "uk": entry("rule_uniqueness", cols="k")}
    rows = [(2024001, k, 0) for k in (1, 2, 3, None)]
    assert go(1, checks, days(spark, rows)) == {"w": None, "uk": 0}
    rows += [(2024002, k, 0) for k in (1, 2, 4, None)]
    assert go(2, checks, days(spark, rows)) == {"w": None, "uk": 2}
    rows += [(2024003, k, 0) for k in (5, 5, 5, 1)]
    assert go(3, checks, days(spark, rows)) == {"w": None, "uk": 3}
    rows += [(2024002, k, 0) for k in (4, 6, 6)]  # late
    assert go(4, checks, days(spark, rows)) == {"w": None, "uk": 2}
    assert go(5, checks, days(spark, rows)) == {"w": None, "uk": 0}
    for n in range(6, 9):  # file sets are merged on the way
        rows += [(2024000 + n, k, 0) for k in (1, 100 + n)]
        assert go(n, checks, days(spark, rows)) == {"w": None, "uk": 1}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("key_index")]


def test_uniqueness_learns_of_rows_before_the_check(spark, go):
    rows = [(2024001, k, 0) for k in (1, 1, 2)]
    window = {"w": setup(col="date_id")}
    go(1, window, days(spark, rows))
    rows += [(2024002, k, 0) for k in (2, 3)]
    assert go(2, window | {"uk": entry("rule_uniqueness", cols="k")}, days(spark, rows)) == {"w": None, "uk": 1}


def test_uniqueness_without_a_history_is_counted_in_the_whole_table(spark):
    checks = {"w": setup(col="date_id"), "uk": entry("rule_uniqueness", cols="k")}
    doc = spark.range(1).select(F.lit(json.dumps({"t": checks})).alias("value"))
    df = days(spark, [(2024001, 1, 0), (2024002, 1, 0)])
    got = run_checks(spark, parse_registry(doc), {"t": df}, Run("prod", "db", 1)).where("check_name = 'uk'").first()
    assert (got.check_violation_cnt, got.check_mode) == (1, "full")


def test_the_old_side_of_the_index_is_not_shuffled(spark, tmp_path):
    day = F.to_date(F.lit("2024-01-01"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with key_index.KeyIndex(spark, str(tmp_path / "keys"), "1", lambda runs: set(runs), buckets=4) as index:
            old = key_index.digested(spark.range(1000).withColumnRenamed("id", "k"), ["k"], day)
            index.write(index.found(old), "0")
            new = key_index.digested(spark.range(990, 1010).withColumnRenamed("id", "k"), ["k"], day)
            plan = index.found(new)._jdf.queryExecution().executedPlan().toString()
            # the window's keys are dealt once they are one row each; the file set is read as it lies
            window, old_side = plan[: plan.index("Range (")], plan[plan.index("Range (") :]
            assert "SortMergeJoin" in window and window.count("Exchange hashpartitioning") == 2
            assert "Bucketed: true" in old_side and "Exchange" not in old_side
            name = index.write(index.found(new))
            assert key_index.excess(index.table(name)).first()[0] == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_many_partitions_leave_a_bounded_row(spark, tmp_path, go):
    df = spark.range(30_000).selectExpr("cast(2024001 as int) as date_id", "id as k", "case when id < 7 then 1 else 9 end as v")
    more = df.unionByName(df.where("k = 3")).unionByName(df.where("k = 20000").withColumn("k", F.lit(None).cast("long")))
    checks = {"parts": entry("range_by_partition", "full", col="v", max=5, partition="k")}
    assert go(1, checks, more) == {"parts": 30_000 - 7 + 1}
    path = str(tmp_path / "h")
    row = read_results(spark, path).first()
    saved = {k: v for k, v in row.env_vars.items() if k.startswith("hapinsp_partition_")}
    assert len(saved) == runner.WORST_PARTITIONS and row.env_vars["hapinsp_partitions"] == str(30_000 - 7)
    kept = PartitionResults(spark, path).committed(read_results(spark, path))
    assert kept.count() == 30_000 - 7 + 1
    assert totals(kept).agg(F.sum("violations")).first()[0] == 30_000 - 7 + 1


def test_partition_rows_of_a_run_that_broke_do_not_count(spark, tmp_path, go, monkeypatch):
    checks = {"w": setup(col="date_id"), "low": entry("range", col="v", max=5)}
    rows = [(2024001, 1, 9), (2024002, 2, 9)]
    assert go(1, checks, days(spark, rows))["low"] == 2
    rows += [(2024001, 3, 9), (2024003, 4, 9)]

    def lost(*args, **kwargs):
        raise OSError("java.io.IOException: no storage")

    with monkeypatch.context() as m:
        m.setattr(runner, "commit_results", lost)
        with pytest.raises(OSError):
            go(2, checks, days(spark, rows))
    assert go(3, checks, days(spark, rows))["low"] == 2
    path = str(tmp_path / "h")
    by_day = totals(PartitionResults(spark, path).committed(read_results(spark, path)), ["partition_value"])
    assert {r.partition_value: r.violations for r in by_day.collect()} == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 1}


def test_a_run_that_is_ended_keeps_what_was_finished(spark, tmp_path, go, monkeypatch):
    checks = {"w": setup(col="date_id")} | {f"low{i}": entry("range", col="v", max=i) for i in range(3)}
    checks |= {f"uk{i}": entry("rule_uniqueness", cols="k,v") for i in range(5)}
    rows = [(2024001, 1, 9), (2024001, 1, 9)]
    go(1, checks, days(spark, rows))
    rows += [(2024002, 1, 9), (2024002, 1, 9)]
    commit, stored = runner.commit_results, []

    def until_third(*args, **kwargs):
        if len(stored) == 2:
            raise KeyboardInterrupt
        stored.append(args[3])
        return commit(*args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(runner, "commit_results", until_third)
        with pytest.raises(KeyboardInterrupt):
            go(2, checks, days(spark, rows))
    kept = {r.check_name: r.check_violation_cnt for r in read_results(spark, str(tmp_path / "h")).where("run_id = 2").collect()}
    assert kept and "w" not in kept
    got = go(3, checks, days(spark, rows))
    for name in checks:
        if name != "w":  # counted by the run that was ended, or by the next one
            assert kept.get(name, 0) + got[name] == 2


def test_many_checks_run_in_overlapping_jobs(spark, monkeypatch):
    tables = {f"t{i}": days(spark, [(2024001, 1, 9)]) for i in range(40)}
    doc = spark.range(1).select(F.lit(json.dumps({t: {f"c{j}": entry("range", "full", col="v", max=j) for j in range(13)} for t in tables})).alias("value"))
    together, most, lock, rows = [0], [0], threading.Lock(), RunPlan._rows

    def watched(self, planned):
        with lock:
            together[0] += 1
            most[0] = max(most[0], together[0])
        try:
            return rows(self, planned)
        finally:
            with lock:
                together[0] -= 1

    monkeypatch.setattr(RunPlan, "_rows", watched)
    got = run_checks(spark, parse_registry(doc), tables, Run("prod", "db", 1))
    assert got.count() == 520 and got.agg(F.sum("check_violation_cnt")).first()[0] == 40 * 9
    assert most[0] > 1


def test_what_settled_is_stored_before_an_outage_is_raised(spark, tmp_path, go, monkeypatch):
    checks = {f"c{j}": entry("sql", "full", sql=f"SELECT {j} AS violations FROM {{table}} LIMIT 1") for j in range(9)}
    rows = RunPlan._rows

    def one_lost(self, planned):
        if any(p.entry.check_alias == "c0" for p in planned):
            raise OSError("java.io.IOException: no storage")
        return rows(self, planned)

    monkeypatch.setattr(RunPlan, "_rows", one_lost)
    with pytest.raises(OSError):
        go(1, checks, days(spark, [(2024001, 1, 9)]))
    assert read_results(spark, str(tmp_path / "h")).count() >= 5


def test_two_writers_of_a_batch_leave_one_copy(spark, tmp_path, go, monkeypatch):
    checks = {"low": entry("range", "full", col="v", max=5)}
    df = days(spark, [(2024001, 1, 9)])
    with monkeypatch.context() as m:  # neither sees what the other has stored
        m.setattr(results, "new_results", lambda stored, rows: rows)
        go(1, checks, df)
        go(1, checks, df)
    assert read_results(spark, str(tmp_path / "h")).count() == 1


def files_read(df):
    return [f.rsplit("/", 1)[1] for f in df.inputFiles()]


def test_compaction(spark, tmp_path, go):
    path, checks = str(tmp_path / "h"), {"low": entry("range", "full", col="v", max=5)}
    for n in range(9):
        go(n, checks, days(spark, [(2024001, n, 9)] * (n + 1)), day=n)
    before = sorted(read_results(spark, path).drop("env_vars").collect())
    assert not compact_results(spark, path, dt.date(2024, 3, 5), least=100)
    assert compact_results(spark, path, dt.date(2024, 3, 5))
    after = read_results(spark, path)
    assert len(files_read(after)) == 1 and sorted(after.drop("env_vars").collect()) == before
    go(9, checks, days(spark, [(2024001, 1, 9)]), day=9)
    assert read_results(spark, path).count() == 10


def test_a_compaction_that_was_ended_is_seen_once_and_finished(spark, tmp_path, go, monkeypatch):
    path, checks = str(tmp_path / "h"), {"low": entry("range", "full", col="v", max=5)}
    for n in range(4):
        go(n, checks, days(spark, [(2024001, n, 9)]), day=n)
    finish, calls = results._finish_compaction, []

    def first_only(folder, part):
        calls.append(part)
        if len(calls) == 2:
            raise KeyboardInterrupt
        finish(folder, part)

    with monkeypatch.context() as m:
        m.setattr(results, "_finish_compaction", first_only)
        with pytest.raises(KeyboardInterrupt):
            compact_results(spark, path, dt.date(2024, 3, 1), least=2)
    assert read_results(spark, path).count() == 4  # the new file lies beside those it replaces
    assert not compact_results(spark, path, dt.date(2024, 3, 1), least=2)
    assert len(files_read(read_results(spark, path))) == 1 and read_results(spark, path).count() == 4


def test_a_run_reads_the_snapshot_and_new_folders(spark, tmp_path, go):
    path, checks = str(tmp_path / "h"), {"w": setup(col="date_id"), "low": entry("range", col="v", max=5)}
    rows = []
    for n, day in enumerate((0, 40, 80, 120)):
        rows.append((2024001 + day, n, 9))
        assert go(n, checks, days(spark, rows), day=day)["low"] == 1
    snapshots = latest.Snapshots(spark, path, "prod", "db")
    facts = snapshots.facts(read_results(spark, path), runner.STOP_VAR)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert any("_latest" in f for f in facts.inputFiles())
    assert "run_month" in plan[plan.index("PartitionFilters: [") :].split("]")[0]
    _, since = snapshots.newest()
    assert since == dt.date(2024, 5, 1)  # two months of four
    whole = latest.merged(latest.facts_of(read_results(spark, path), runner.STOP_VAR))
    assert sorted(map(str, facts.collect())) == sorted(map(str, whole.collect()))
    assert len(snapshots._finished()) <= latest.KEPT


def test_outliers_are_told_by_all_rows_so_far(spark, go):
    checks = {"w": setup(col="date_id"), "far": entry("outlier", col="v", deviations=2)}
    rows = [(2024001, k, 10 + k % 3) for k in range(20)]
    assert go(1, checks, days(spark, rows))["far"] == 0
    # against its own window the third value would be none: there is no other
    rows += [(2024002, 50, 100)]
    assert go(2, checks, days(spark, rows))["far"] == 1
    rows += [(2024003, 60 + k, 11) for k in range(5)]
    assert go(3, checks, days(spark, rows))["far"] == 0
    whole = days(spark, rows)
    mean, sd = whole.agg(F.avg("v"), F.stddev_samp("v")).first()
    parts = statistics.moments(whole, "v", F.col("date_id"))
    got = statistics.merged_moments(parts).first()
    assert got.n == 26 and abs(got["mean"] - mean) < 1e-9 and abs(got.sd - sd) < 1e-9


def test_moments_merge_far_from_zero(spark):
    df = spark.range(1000).selectExpr("id % 7 AS g", "1e9 + id % 10 AS v")
    got = statistics.merged_moments(statistics.moments(df, "v", F.col("g"))).first()
    assert abs(got.sd - df.agg(F.stddev_samp("v")).first()[0]) < 1e-6
    assert statistics.merged_moments(statistics.moments(df.limit(0), "v", F.col("g"))).first().sd is None


def test_profiles_of_windows_merge(spark, go, tmp_path):
    checks = {"w": setup(col="date_id"), "facts": entry("profile", cols="k,v,date_id") | {"check_type": "profile", "check_scope": "row"}}
    df = spark.range(3000).selectExpr("cast(2024001 + id div 1000 as int) AS date_id", "id AS k", "id % 50 - 10 AS v")
    nulls = df.withColumn("v", F.when(F.col("k") % 10 != 0, F.col("v")))
    for n, end in enumerate((2024001, 2024002, 2024003)):
        go(n, checks, nulls.where(F.col("date_id") <= end), day=n)
    row = read_results(spark, str(tmp_path / "h")).where("check_name = 'facts' and run_id = 2").first()
    got = {k.removeprefix("hapinsp_profile_"): v for k, v in row.env_vars.items() if k.startswith("hapinsp_profile_")}
    assert got["k_n_rows"] == "3000" and got["v_n_null"] == "300"
    assert (got["v_min_value"], got["v_max_value"], got["k_max_value"]) == ("-9", "39", "2999")
    assert abs(int(got["k_n_distinct"]) - 3000) <= 150 and got["v_n_distinct"] == "45"
    assert abs(float(got["k_median"]) - 1500) <= 100 and abs(float(got["k_q75"]) - 2250) <= 100
    assert abs(float(got["k_avg_value"]) - 1499.5) < 1e-6
    whole = {r.column_name: r for r in statistics.merged_profile(statistics.sketches(nulls)).collect()}
    assert whole["k"].n_distinct == int(got["k_n_distinct"])


def test_a_day_opened_again_replaces_its_facts(spark, go, tmp_path):
    checks = {"w": setup(col="date_id"), "facts": entry("profile", cols="v") | {"check_type": "profile", "check_scope": "row"}}
    rows = [(2024001, 1, 4), (2024002, 2, 6)]
    go(1, checks, days(spark, rows))
    rows += [(2024001, 3, 8), (2024003, 4, 10)]
    go(2, checks, days(spark, rows))
    row = read_results(spark, str(tmp_path / "h")).where("check_name = 'facts' and run_id = 2").first()
    assert row.env_vars["hapinsp_profile_v_n_rows"] == "4" and float(row.env_vars["hapinsp_profile_v_avg_value"]) == 7.0


def test_one_scan_for_all_columns(spark, tmp_path):
    spark.range(10).selectExpr(*[f"id + {i} AS c{i}" for i in range(40)]).write.parquet(str(tmp_path / "t"))
    plan = statistics.sketches(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_rollups_are_made_again_only_where_files_changed(spark, tmp_path, go):
    path, checks = str(tmp_path / "h"), {"low": entry("range", "full", col="v", max=5)}
    for n, day in enumerate((0, 1, 40)):
        go(n, checks, days(spark, [(2024001, n, 9)] * (n + 1)), day=day)
    rollups = Rollups(spark, path)
    assert rollups.daily().count() == 0
    assert rollups.refresh() == ["run_month=2024-03-01", "run_month=2024-04-01"]
    assert rollups.refresh() == []
    go(3, checks, days(spark, [(2024001, 3, 9)] * 4), day=41)
    assert rollups.refresh() == ["run_month=2024-04-01"]
    history = read_results(spark, path)
    for made, from_rows in (
        (rollups.series("table_name"), daily(history, "table_name")),
        (rollups.series("check_name", "month"), monthly(history, "check_name")),
        (rollups.levels(), rollup_levels(history)),
    ):
        assert sorted(map(str, made.select(from_rows.columns).collect())) == sorted(map(str, from_rows.collect()))
    compact_results(spark, path, dt.date(2024, 3, 1), least=2)
    assert rollups.refresh() == ["run_month=2024-03-01"]
    assert rollups.levels().count() == rollup_levels(read_results(spark, path)).count()


def test_nulls_inside_values_are_differences(spark):
    def count(left, right, kind):
        frames = [spark.createDataFrame([(v,) for v in rows], f"v {kind}") for rows in (left, right)]
        return consistency.count_row_differences(*frames).first().violations

    assert count([[1, None]], [[None, 1]], "array<int>") == 2
    assert count([(1, None)], [(None, 1)], "struct<a:int,b:int>") == 2
    assert count([[1, None], None], [None, [1, None]], "array<int>") == 0
    assert count([{"a": None}], [{}], "map<string,int>") == 2
    assert count([{"a": 1, "b": 2}], [{"b": 2, "a": 1}], "map<string,int>") == 0
    assert count([[(None, 1)]], [[(1, None)]], "array<struct<a:int,b:int>>") == 2


def test_only_rows_of_differing_buckets_are_sent(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id % 20 AS part", "id AS k", "if(id % 3 = 0, null, id) AS v")
    other = df.withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v"))).where("k <> 500")
    more = other.unionByName(df.where("k = 900"))
    for partition in ((), ("part",)):
        assert consistency.count_row_differences(df, df, partition).first().asDict() == {"n_missing": 0, "n_extra": 0, "violations": 0}
        got = consistency.count_row_differences(df, more, partition).first()
        assert (got.n_missing, got.n_extra, got.violations) == (2, 2, 4)
    left, right = (consistency.row_digests(x, ["part", "k", "v"], "part") for x in (df, more))
    places = consistency.differing_places(left, right, "_p0", "bucket").collect()
    assert len(places) <= 4  # of 20 x 1024: of the row that is lost, the one that is twice, and the one that changed
    plan = consistency.count_row_differences(df, df, ("part",))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate [d1") :]  # rows are dropped before they are sent
