import datetime as dt

import pytest

from tablewarden.plans import history as plan
from tablewarden.plans.report import report_lines, result_problems, run_report
from tablewarden.plans.scores import score_results
from tablewarden.schema import RESULT_SCHEMA
from tablewarden.sources import results as store
from tablewarden.streaming import incremental

DAY = dt.datetime(2015, 1, 30, 2)


def result(check="ck", count=0, day=0, kind="rule", **values):
    start = DAY + dt.timedelta(days=day)
    row = dict.fromkeys(RESULT_SCHEMA.fieldNames()) | {
        "instance_name": "prod",
        "database_name": "db",
        "table_name": "asset",
        "check_name": check,
        "check_type": kind,
        "check_policy_type": "quality",
        "check_mode": "full",
        "check_unit": "rows",
        "check_status": "active",
        "run_id": day,
        "run_start_timestamp": start,
        "run_stop_timestamp": start + dt.timedelta(hours=1),
        "check_rc": 0,
        "check_scope": -1.0,
        "check_severity_score": -1,
        "check_violation_cnt": count,
        "env_vars": {},
    }
    row.update(values)
    return tuple(row[n] for n in RESULT_SCHEMA.fieldNames())


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), RESULT_SCHEMA)


def test_sums_skip_unknown_counts_and_setups(frame):
    df = frame(
        result(count=3),
        result("other", count=4),
        result("broken", count=-1),
        result("off", count=None),
        result("setup_x", count=100, kind="setup"),
        result("setup", count=100, kind="setup"),
        result(count=5, day=3),
    )
    months = {str(r.period): r.violations for r in plan.monthly(df, "database_name").collect()}
    assert months == {"2015-01-01": 7, "2015-02-01": 5}
    days = {str(r.period): r.violations for r in plan.daily(df, "instance_name").collect()}
    assert days == {"2015-01-30": 7, "2015-02-02": 5}
    checks = {r.check_name: r.violations for r in plan.monthly(df, "check_name").collect()}
    assert checks["broken"] == checks["off"] == 0 and "setup_x" not in checks


def test_last_points_are_points_not_days(frame):
    df = frame(*[result(count=i, day=i * 10) for i in range(12)])
    last = plan.last_points(plan.daily(df, "check_name"), "check_name", 8)
    assert sorted(r.violations for r in last.collect()) == list(range(4, 12))


def test_series_lengths(frame):
    df = frame(*[result(day=i) for i in range(40)], result("setup_x", None, kind="setup", table_name="new"))
    got = {
        r.table_name: (r.year_points, r.month_points, r.week_points)
        for r in plan.series_lengths(df, "table_name").collect()
    }
    assert got == {"asset": (3, 32, 8), "new": (0, 0, 0)}


def test_current_status(frame):
    df = frame(
        result(count=5),
        result(count=0, day=1),
        result("a_later_name", count=2, day=1),
        result("setup_x", count=None, day=2, kind="setup"),
        result("setup_y", None, kind="setup", table_name="new"),
        result("gone", count=None, table_name="lost"),
    )
    checks = {r.check_name: r.status for r in plan.current_status(df, "check_name").collect()}
    assert checks["ck"] == "Passing" and checks["a_later_name"] == "Failing"
    tables = {
        r.table_name: (r.violations, r.status) for r in plan.current_status(df, "table_name").collect()
    }
    assert tables == {"asset": (0, "Passing"), "new": (0, "Passing"), "lost": (None, "Failing")}


def test_search(frame):
    df = frame(result("cust_uk"), result("Cust_FK"), result("other"), result("setup_cust", kind="setup"))

    def found(text):
        return sorted(r.check_name for r in plan.search(df, "check_name", text).collect())

    assert found("cust") == ["Cust_FK", "cust_uk"]
    assert found("c%k") == ["Cust_FK", "cust_uk"]
    assert found("") == ["Cust_FK", "cust_uk", "other"]
    assert [r.clean_name for r in plan.entities(frame(result(instance_name="a-b-c")), "instance_name").collect()] == ["a_b_c"]


def test_rollup_equals_each_level(frame):
    df = frame(
        *[
            result(check, count=n, day=day, table_name=table, database_name=db)
            for n, (check, day, table, db) in enumerate(
                (c, d, t, b) for c in ("x", "y") for d in (0, 1, 5) for t in ("p", "q") for b in ("m", "n")
            )
        ]
    )
    rolled = plan.rollup_levels(df).collect()
    for level in plan.LEVELS:
        keys = plan.path_to(level) + ["period", "violations"]
        want = {tuple(r[k] for k in keys) for r in plan.monthly(df, level).collect()}
        assert {tuple(r[k] for k in keys) for r in rolled if r.level == level} == want


def test_max_rc(frame):
    assert plan.max_rc(frame(result(), result(check_rc=4))).first().max_rc == 4
    assert plan.max_rc(frame(result(check_rc=-1))).first().max_rc == 0
    assert plan.max_rc(frame()).first().max_rc == 0


def test_report(frame):
    df = frame(
        result("b", 3, table_name="z"),
        result("teardown_z", None, kind="teardown"),
        result("zz_setup", None, kind="setup", env_vars={"a": "x|y"}),
        result("a", None, check_mode="", check_rc=202),
        result("c", 1),
    )
    assert [r.line for r in report_lines(run_report(df)).collect()] == [
        "asset|zz_setup|full|0|0",
        "asset|a|unk|202|0",
        "asset|c|full|0|1",
        "z|b|full|0|3",
    ]
    detail = run_report(df, detail=True)
    assert len(detail.columns) == 8 and detail.first().vars == '{"a":"x|y"}'


def test_result_rules(frame):
    df = frame(
        result("good"),
        result("null_mode", check_mode=None, check_status=None, count=None),
        result("type", kind="warning"),
        result("policy", check_policy_type="rule"),
        result("unit", check_unit="table"),
        result("mode", check_mode=""),
        result("status", check_status="paused"),
        result("count", count=-2),
        result("rc", check_rc=None, run_stop_timestamp=None),
    )
    got = {r.check_name: list(r.problems) for r in result_problems(df).collect()}
    assert got == {
        "type": ["check_type"],
        "policy": ["check_policy_type"],
        "unit": ["check_unit"],
        "mode": ["check_mode"],
        "status": ["check_status"],
        "count": ["check_violation_cnt"],
        "rc": ["check_rc", "run_stop_timestamp"],
    }


def test_missing_history_is_empty(spark, tmp_path):
    df = store.read_results(spark, str(tmp_path / "none"))
    assert df.count() == 0 and df.columns[:19] == RESULT_SCHEMA.fieldNames()


def test_store_and_read_back(spark, frame, tmp_path):
    path = str(tmp_path / "history")
    rows = frame(
        result(count=3),
        result("x", count=-1),
        result("setup", None, day=3, kind="setup", env_vars={"hapinsp_tablecustom_a": "1"}),
    )
    begin = dt.datetime(2020, 1, 1)
    store.append_results(spark, rows, path, begin)
    store.append_results(spark, rows.unionByName(frame(result(count=8, day=4))), path, begin)
    got = {(r.check_name, r.run_id): r for r in store.read_results(spark, path).collect()}
    assert len(got) == 4
    assert got["ck", 0].check_violation_cnt == 3
    assert got["ck", 0].data_start_timestamp == DAY
    assert got["x", 0].check_violation_cnt is None
    assert got["setup", 3].env_vars == {"hapinsp_tablecustom_a": "1"}
    february = store.read_results(spark, path).where("run_month = DATE'2015-02-01'")
    assert february.count() == 2
    plan_text = february._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_month" in plan_text


def test_csv_round_trip(spark, frame, tmp_path):
    path = str(tmp_path / "csv")
    store.append_csv(frame(result(count=3, env_vars={"a": 'b,"c"'})), path)
    store.append_csv(frame(result(count=None, env_vars=None)), path)
    got = sorted(store.read_csv(spark, path).collect(), key=lambda r: r.check_violation_cnt or 0)
    assert [r.check_violation_cnt for r in got] == [None, 3]
    assert got[1].env_vars == '{"a":"b,\\"c\\""}'
    assert got[1].run_start_timestamp == DAY


def test_prior_vars_of_the_latest_run(frame):
    df = frame(
        result("s", None, 0, "setup", env_vars={"hapinsp_tablecustom_foo": "inactive"}),
        result("s", None, 1, "setup", env_vars={"hapinsp_tablecustom_foo": "active"}),
        result("ck", 0, 2, env_vars={"hapinsp_tablecustom_foo": "later"}),
    )
    rows = incremental.prior_vars(df).collect()
    assert [r.prior_vars for r in rows] == [{"hapinsp_tablecustom_foo_prior": "active"}]


def test_windows(spark):
    df = spark.sql(
        "SELECT explode(array(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-02', "
        "timestamp_ntz'2024-01-03')) AS ts"
    )

    def n(start, stop):
        return df.where(incremental.in_window("ts", start, stop)).count()

    one, two = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    assert (n(one, two), n(None, two), n(two, None), n(None, None)) == (1, 2, 1, 3)
    scan = df.sparkSession.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = scan.where(incremental.in_window("o_orderdate", one, two))._jdf
    assert "GreaterThan(o_orderdate" in text.queryExecution().executedPlan().toString()


def test_nothing_depends_on_the_time_zone(spark, frame):
    from tablewarden.functions.moments import moment
    from tablewarden.functions.validators import iso_timestamp
    from pyspark.sql import functions as F

    gap = dt.datetime(2024, 3, 10, 2, 30)  # does not exist in New York
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(
            moment(gap).alias("a"), iso_timestamp(F.lit("20240310T023000"), "basic").alias("b")
        ).first()
        assert row.a == row.b == gap
        df = frame(result(count=1, run_start_timestamp=dt.datetime(2024, 3, 1, 0, 0)))
        assert str(plan.monthly(df, "check_name").first().period) == "2024-03-01"
        assert str(plan.daily(df, "check_name").first().period) == "2024-03-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_score_join(spark):
    place = "instance_name string, database_name string, table_name string"
    results = spark.createDataFrame(
        [
            ("east", "db", "t", "uk", 5, "tables"),
            ("east", "db", "t", "stats", 1, None),
            ("east", "db", "t", "uk", None, None),
            ("east", "db", "t", "unknown", 1, "rows"),
            ("west", "db", "t", "uk", 5, None),
            ("south", "db", "t", "uk", 5, "rows"),
        ],
        f"{place}, check_name string, check_violation_cnt long, check_unit string",
    )
    tables = spark.createDataFrame(
        [("east", "db", "t", 10.0, None, "incremental"), ("west", "db", "t", 100.0, None, "full")],
        f"{place}, avg_rows double, partition_key string, table_mode string",
    )
    checks = spark.createDataFrame(
        [
            ("east", "db", "t", "uk", "rows", "high", "quality", "incremental"),
            ("east", "db", "t", "stats", "tables", "low", "data-management", "full"),
            ("west", "db", "t", "uk", "rows", "high", "quality", "incremental"),
        ],
        f"{place}, check_name string, violation_unit string, severity string, "
        "policy_type string, config_mode string",
    )
    got = {
        (r.instance_name, r.check_name, r.check_violation_cnt): (
            r.check_unit, r.check_mode, r.check_scope, r.check_severity_score
        )
        for r in score_results(results, tables, checks).collect()
    }
    assert got == {
        ("east", "uk", 5): ("rows", "incremental", 50.0, 50),
        ("east", "uk", None): ("rows", "incremental", None, None),
        ("east", "stats", 1): ("tables", "full", 100.0, 10),
        ("east", "unknown", 1): ("rows", None, None, None),
        ("west", "uk", 5): ("rows", "full", 5.0, 5),
        ("south", "uk", 5): ("rows", None, None, None),
    }
    with pytest.raises(Exception, match="configured twice: (east|west).db.t"):
        score_results(results, tables.union(tables), checks).collect()


def test_setups_are_told_by_type_at_every_level(frame):
    rows = [
        result("setup_time_ck", count=679),
        result("w", count=None, kind="setup"),
        result("setup", count=2, day=1),
        result("done", count=9, kind="teardown", day=2),
    ]
    df = frame(*rows)
    by_check = {(r.check_name, str(r.period)): r.violations for r in plan.daily(df, "check_name").collect()}
    rolled = plan.rollup_levels(df, "day").where("level = 'check_name'")
    assert by_check == {(r.check_name, str(r.period)): r.violations for r in rolled.collect()}
    assert by_check == {("setup_time_ck", "2015-01-30"): 679, ("setup", "2015-01-31"): 2}
    status = {r.check_name: r.status for r in plan.current_status(df, "check_name").collect()}
    assert status == {"setup_time_ck": "Failing", "setup": "Failing"}
    assert sorted(r.check_name for r in plan.entities(df, "check_name").collect()) == ["setup", "setup_time_ck"]
    assert {r.month_points for r in plan.series_lengths(df, "table_name").collect()} == {2}


def test_current_status_reads_the_history_once_and_hashes(spark, tmp_path, frame):
    store.append_results(spark, frame(result(), result("b", count=1, day=1)), str(tmp_path / "h"))
    status = plan.current_status(store.read_results(spark, str(tmp_path / "h")))
    tree = status._jdf.queryExecution().executedPlan().toString()
    assert tree.count("FileScan parquet") == 1 and "SortAggregate" not in tree
    got = {(r.level, r.violations) for r in status.collect()}
    assert got == {("instance_name", 1), ("database_name", 1), ("table_name", 1), ("check_name", 0), ("check_name", 1)}


def test_append_searches_the_months_it_has(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    store.append_results(spark, frame(result(), result(day=3)), path)
    seen = []
    new = store.new_results
    monkeypatch.setattr(store, "new_results", lambda stored, rows: seen.append(stored) or new(stored, rows))
    store.append_results(spark, frame(result(day=3), result("b", day=4)), path)
    assert store.read_results(spark, path).count() == 3
    assert {str(r.run_month) for r in seen[0].select("run_month").distinct().collect()} == {"2015-02-01"}
    assert "PartitionFilters: [(" in seen[0]._jdf.queryExecution().executedPlan().toString()
