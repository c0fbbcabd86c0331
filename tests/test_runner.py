import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tablewarden.operators.catalogue import BUILT_IN, CheckContext
from tablewarden.plans.registry import RegistryError
from tablewarden.plans import runner
from tablewarden.plans.runner import Run, RunPlan, run_and_store, run_checks
from tablewarden.sources.registry import parse_registry
from tablewarden.sources.results import read_results

CUSTOM = "hapinsp_checkcustom_"


def entry(name, **values):
    custom = {k if k.startswith("check_") else CUSTOM + k: v for k, v in values.items()}
    return {"check_name": name} | custom


def setup(name, **values):
    return entry(name, check_type="setup", **values)


@pytest.fixture
def registry(spark):
    return lambda doc: parse_registry(spark.createDataFrame([(json.dumps(doc),)], "value string"))


@pytest.fixture
def table(spark):
    return spark.sql(
        "SELECT id AS k, id % 3 AS g, CAST(timestamp_ntz'2024-01-01' + make_dt_interval(id) "
        "AS timestamp_ntz) AS ts FROM range(10)"
    )


def by_name(df):
    return {r.check_name: r for r in df.collect()}


def run(n=1):
    return Run("prod", "db", n, dt.datetime(2024, 2, n, 2))


def test_rows_of_a_run(spark, registry, table):
    doc = {
        "t": {
            "a": entry("range", col="k", max=6),
            "b": entry("rule_uniqueness", cols="g"),
            "c": entry("not_empty"),
            "d": entry("range", col="k", max=1, check_status="inactive"),
            "e": entry("range", col="nothing", max=1),
            "f": entry("range", max=1),
        }
    }
    got = by_name(run_checks(spark, registry(doc), {"t": table}, run()))
    counts = {k: (r.check_violation_cnt, r.check_rc, r.check_mode) for k, r in got.items()}
    assert counts == {
        "a": (3, 0, "full"),
        "b": (7, 0, "full"),
        "c": (0, 0, "full"),
        "d": (-1, -1, "full"),
        "e": (-1, 202, ""),
        "f": (-1, 202, ""),
    }
    assert got["c"].check_unit == "tables"
    assert got["a"].env_vars["hapinsp_table"] == "t"
    assert got["a"].env_vars[CUSTOM + "max"] == "6"
    assert got["a"].data_start_timestamp is None


def test_row_checks_share_scans(spark, registry):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    doc = {
        "t": {
            "a": entry("range", col="l_tax", max=0.07),
            "b": entry("range", col="l_quantity", max=45),
            "c": entry("enum", col="l_returnflag", values="A,R"),
            "d": entry("format", col="l_linestatus", pattern="O"),
            "e": entry("case", col="l_returnflag"),
        }
    }
    out = RunPlan(spark, registry(doc), {"t": df}, run()).results()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in plan
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan
    assert (
        "PushedFilters: [Or(Or(GreaterThan(l_tax,0.07),GreaterThan(l_quantity,45.0)),"
        "Not(In(l_returnflag, [A,R])))]" in plan
    )


def test_clean_row_groups_are_not_read(spark, registry, tmp_path):
    path = str(tmp_path / "clean")
    spark.range(0, 100000, 1, 4).selectExpr("id AS k", "id % 7 AS g").write.parquet(path)
    doc = {
        "t": {
            "low": entry("range", col="k", min=0, max=99998),
            "set": entry("range", col="g", max=6),
            "null": entry("not_null", cols="k,g"),
        }
    }
    out = RunPlan(spark, registry(doc), {"t": spark.read.parquet(path)}, run()).results()
    assert {r.check_name: r.check_violation_cnt for r in out.collect()} == {
        "low": 1,
        "set": 0,
        "null": 0,
    }
    tree = out._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [Or(" in tree.toString() and "IsNull(k)" in tree.toString()
    assert 0 < rows_read(tree) <= 25000


def rows_read(plan):
    """Rows the file scans of an executed plan gave out: those of the files not skipped."""
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_missing_table_and_unknown_check(spark, registry, table):
    got = by_name(run_checks(spark, registry({"lost": {"a": entry("not_empty")}}), {"t": table}, run()))
    assert got["a"].check_rc == 202
    with pytest.raises(RegistryError, match="no check nonsense"):
        run_checks(spark, registry({"t": {"a": entry("nonsense")}}), {"t": table}, run())
    with pytest.raises(RegistryError):
        run_checks(spark, registry({}), {"t": table}, run())


def test_check_named_twice(spark, table):
    text = '{"t": {"a": {"check_name": "not_empty"}, "a": {"check_name": "not_empty"}}}'
    twice = parse_registry(spark.createDataFrame([(text,)], "value string"))
    with pytest.raises(RegistryError, match="twice"):
        run_checks(spark, twice, {"t": table}, run())


OWN = BUILT_IN.copy()


@OWN.add("setup_foo", "setup")
def _setup_foo(ctx):
    """Leaves its custom variable behind, and reports what it was given of the last run."""
    prior = ctx.vars.get("hapinsp_tablecustom_foo_prior", "")
    return {
        "rc": "0",
        "hapinsp_tablecustom_foo": ctx.custom("foo"),
        "hapinsp_tablecustom_seen": prior,
    }


@OWN.add("foo_is", "table")
def _foo_is(ctx):
    same = ctx.vars.get("hapinsp_tablecustom_" + ctx.custom("name", "foo")) == ctx.custom("value")
    return ctx.spark.range(1).select(F.lit("0" if same else "1").alias("violations"))


@OWN.add("setup_off", "setup")
def _setup_off(ctx):
    return {"rc": 3, "table_status": "inactive"}


@OWN.add("setup_bad", "setup")
def _setup_bad(ctx):
    return {"rc": 0, "name": "x"}


@OWN.add("setup_raises", "setup")
def _setup_raises(ctx):
    raise ValueError("no")


@OWN.add("setup_explodes", "setup")
def _setup_explodes(ctx):
    return ctx.df.limit(1).select(F.raise_error(F.lit("boom")).cast("string").alias("raw_output"))


@OWN.add("explode", "row")
def _explode(ctx):
    return F.when(F.col("k") == 5, F.raise_error(F.lit("boom")).cast("boolean")).otherwise(False)


@OWN.add("two_rows", "table")
def _two_rows(ctx):
    return ctx.spark.range(2).select(F.col("id").alias("violations"))


@OWN.add("with_rc", "table")
def _with_rc(ctx):
    return ctx.spark.range(1).select(
        F.lit(2).alias("violations"), F.lit("5").alias("rc"), F.lit("incremental").alias("mode")
    )


def test_setup_then_check_over_three_runs(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")

    def go(n, foo, expected):
        doc = {"t": {"s": setup("setup_foo", foo=foo), "c": entry("foo_is", value=expected)}}
        return by_name(run_and_store(spark, registry(doc), {"t": table}, run(n), path, catalogue=OWN))

    first = go(1, "inactive", "inactive")
    assert first["c"].check_violation_cnt == 0
    assert (first["s"].check_type, first["s"].check_violation_cnt) == ("setup", None)
    assert go(2, "active", "inactive")["c"].check_violation_cnt == 1
    third = go(3, "x", "y")
    assert third["s"].env_vars["hapinsp_tablecustom_seen"] == "active"
    assert third["c"].check_violation_cnt == 1
    assert read_results(spark, path).count() == 6


def test_user_variables_override_setup(spark, registry, table):
    doc = {"t": {"s": setup("setup_foo", foo="bar"), "c": entry("foo_is", value="mine")}}
    got = run_checks(
        spark,
        registry(doc),
        {"t": table},
        run(),
        user_vars={"hapinsp_tablecustom_foo": "mine", "other": "ignored"},
        catalogue=OWN,
    )
    row = by_name(got)["c"]
    assert row.check_violation_cnt == 0 and "other" not in row.env_vars


def test_setup_can_bypass_its_table(spark, registry, table):
    doc = {
        "t": {"s": setup("setup_off"), "c": entry("not_empty")},
        "u": {"c2": entry("not_empty")},
    }
    got = by_name(run_checks(spark, registry(doc), {"t": table, "u": table}, run(), catalogue=OWN))
    assert sorted(got) == ["c2", "s"] and got["s"].check_rc == 3


def test_bad_setups_are_rows(spark, registry, table):
    doc = {
        "t": {
            "s1": setup("setup_bad"),
            "s2": setup("setup_raises"),
            "s4": setup("setup_explodes"),
            "s5": setup("setup_foo", foo="bar"),
            "c": entry("not_empty"),
        },
        "u": {"s3": setup("setup_bad", check_status="inactive")},
    }
    got = by_name(run_checks(spark, registry(doc), {"t": table}, run(), catalogue=OWN))
    assert [got[s].check_rc for s in ("s1", "s2", "s4", "s5", "c")] == [201, 201, 201, 0, 0]
    assert got["c"].env_vars["hapinsp_tablecustom_foo"] == "bar"
    assert "s3" not in got


def test_output_of_table_checks(spark, registry, table):
    doc = {"t": {"two": entry("two_rows"), "rc": entry("with_rc")}}
    got = by_name(run_checks(spark, registry(doc), {"t": table}, run(), catalogue=OWN))
    assert (got["two"].check_rc, got["two"].check_violation_cnt) == (202, -1)
    assert (got["rc"].check_rc, got["rc"].check_violation_cnt, got["rc"].check_mode) == (
        5,
        2,
        "incremental",
    )


def test_incremental_window(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")
    doc = {
        "t": {
            "w": setup("incremental_window", col="ts"),
            "inc": entry("range", check_mode="incremental", col="k", max=-1),
            "full": entry("range", col="k", max=-1),
            "empty": entry("not_empty", check_mode="incremental"),
        }
    }

    def go(n, rows):
        seen = table.where(F.col("k") < rows)
        return by_name(run_and_store(spark, registry(doc), {"t": seen}, run(n), path))

    first, second, third = go(1, 4), go(2, 9), go(3, 9)
    assert [r["inc"].check_violation_cnt for r in (first, second, third)] == [4, 5, 0]
    assert [r["full"].check_violation_cnt for r in (first, second, third)] == [4, 9, 9]
    assert [r["empty"].check_violation_cnt for r in (first, second, third)] == [0, 0, 1]
    assert second["inc"].data_start_timestamp == dt.datetime(2024, 1, 4)
    assert second["inc"].data_stop_timestamp == dt.datetime(2024, 1, 9)
    assert second["full"].data_start_timestamp == second["full"].run_start_timestamp


def test_a_check_that_breaks_loses_only_itself(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")
    doc = {
        "t": {
            "a": entry("range", col="k", max=6),
            "b": entry("explode"),
            "c": entry("rule_uniqueness", cols="g"),
            "d": entry("range", col="k", max=1, check_status="inactive"),
        }
    }
    got = by_name(run_and_store(spark, registry(doc), {"t": table}, run(), path, catalogue=OWN))
    assert {k: (r.check_violation_cnt, r.check_rc) for k, r in got.items()} == {
        "a": (3, 0),
        "b": (None, 202),
        "c": (7, 0),
        "d": (None, -1),
    }


def test_a_large_run_is_stored_job_by_job(spark, registry, table, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    commits = []
    commit = runner.commit_results
    monkeypatch.setattr(runner, "commit_results", lambda *a, **k: commits.append(a[3]) or commit(*a, **k))
    monkeypatch.setattr(runner, "BRANCHES", 7)
    doc = {
        f"t{i}": {
            "w": setup("incremental_window", col="ts"),
            "a": entry("range", col="k", max=6),
            "b": entry("rule_uniqueness", cols="g"),
        }
        for i in range(12)
    }
    got = run_and_store(spark, registry(doc), dict.fromkeys(doc, table), run(), path).collect()
    counts = {(r.table_name, r.check_name): r.check_violation_cnt for r in got}
    expected = {"w": None, "a": 3, "b": 7}
    assert counts == {(t, c): n for t in doc for c, n in expected.items()}
    assert len(got) == 36
    # 24 branches in jobs of six; what closes the windows comes last
    assert len(commits) == len(set(commits)) == 5 and commits[-1].endswith("-known")


def test_runs_without_an_id_are_all_stored(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")
    doc = {"t": {"a": entry("range", col="k", max=6)}}
    for minute, rows in ((0, 10), (1, 5)):
        one = Run("prod", "db", started=dt.datetime(2024, 3, 1, 2, minute))
        got = run_and_store(spark, registry(doc), {"t": table.where(F.col("k") < rows)}, one, path).collect()
        assert [r.run_start_timestamp for r in got] == [one.started]
        assert [r.check_violation_cnt for r in got] == [3 if rows == 10 else 0]
    assert read_results(spark, path).count() == 2


@OWN.add("broken_body", "row")
def _broken_body(ctx):
    return ctx.no_such_attribute


def test_nothing_wrong_with_one_check_reaches_another(spark, registry, table):
    texts = table.withColumn("s", F.when(F.col("k") == 3, "x").otherwise(F.col("k").cast("string")))
    doc = {
        "t": {
            "good": entry("range", col="k", max=6),
            "attribute": entry("broken_body"),
            "explodes": entry("explode"),
            "text": entry("range", col="s", max=6),
            "numbers": entry("range", col="n", max=6),
            "braces": entry("sql", sql="SELECT count(*) AS violations FROM {table} WHERE s RLIKE '^[0-9]{1}$'"),
            "index": entry("sql", sql="SELECT {0} AS violations FROM {table}"),
        }
    }
    tables = {"t": texts.withColumn("n", F.col("k").cast("string"))}
    got = by_name(run_checks(spark, registry(doc), tables, run(), catalogue=OWN))
    assert {k: (r.check_violation_cnt, r.check_rc) for k, r in got.items()} == {
        "good": (3, 0),
        "attribute": (-1, 202),
        "explodes": (-1, 202),
        "text": (-1, 202),
        "numbers": (3, 0),
        "braces": (9, 0),
        "index": (-1, 202),
    }
    assert "no_such_attribute" in got["attribute"].env_vars["hapinsp_error"]
    assert "boom" in got["explodes"].env_vars["hapinsp_error"]


def test_outages_are_raised(spark, registry, table, monkeypatch):
    def lost(self, planned):
        raise OSError("java.io.IOException: no storage")

    monkeypatch.setattr(RunPlan, "executed", lost)
    with pytest.raises(OSError):
        run_checks(spark, registry({"t": {"a": entry("not_empty")}}), {"t": table}, run())


def test_a_setup_of_many_rows_is_no_output(spark, registry, table):
    catalogue = BUILT_IN.copy()

    @catalogue.add("many", "setup")
    def _many(ctx):
        return ctx.df.select(F.format_string('{"rc": 0, "hapinsp_tablecustom_k": "%d"}', "k").alias("raw_output"))

    got = by_name(run_checks(spark, registry({"t": {"s": setup("many")}}), {"t": table}, run(), catalogue=catalogue))
    assert got["s"].check_rc == 201


def test_a_failed_setup_keeps_the_mark(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")

    def go(n, rows, window="incremental_window", ck="range"):
        doc = {
            "t": {
                "w": setup(window, col="ts"),
                "inc": entry(ck, check_mode="incremental", col="k", max=-1),
                "steady": entry("range", check_mode="incremental", col="k", max=-1),
            }
        }
        seen = table.where(F.col("k") < rows)
        got = by_name(run_and_store(spark, registry(doc), {"t": seen}, run(n), path, catalogue=OWN))
        return [(got[c].check_violation_cnt, got[c].check_rc) for c in ("inc", "steady")]

    assert go(1, 3) == [(3, 0), (3, 0)]
    assert go(2, 5, window="setup_bad") == [(None, 202), (None, 202)]
    assert go(3, 6) == [(3, 0), (3, 0)]  # from where the first run ended
    assert go(4, 8, ck="broken_body") == [(None, 202), (2, 0)]
    assert go(5, 9) == [(3, 0), (1, 0)]  # the check that broke goes back to its own last count
    assert go(6, 9) == [(0, 0), (0, 0)]


@pytest.mark.parametrize("kind", ["date", "yyyyDDD", "yyyyMMdd"])
def test_windows_on_days(spark, registry, table, tmp_path, kind):
    path = str(tmp_path / "h")
    day = F.to_date("ts") if kind == "date" else F.date_format("ts", kind).cast("int")
    days = table.withColumn("date_id", day)
    doc = {
        "t": {
            "w": setup("incremental_window", col="date_id", **({} if kind == "date" else {"form": kind})),
            "inc": entry("range", check_mode="incremental", col="k", max=-1),
        }
    }
    counts = []
    for n, rows in ((1, 4), (2, 9), (3, 9)):
        seen = days.where(F.col("k") < rows)
        got = by_name(run_and_store(spark, registry(doc), {"t": seen}, run(n), path))
        assert (got["w"].check_rc, got["inc"].check_mode) == (0, "incremental")
        counts.append(got["inc"].check_violation_cnt)
    assert counts == [4, 5, 0]
    assert got["inc"].data_stop_timestamp == dt.datetime(2024, 1, 9)


def test_the_window_opens_without_reading_what_was_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20).selectExpr("id AS k", "CAST(2024001 + id AS INT) AS date_id").write.partitionBy("date_id").parquet(path)
    df = spark.read.parquet(path)
    known = {"hapinsp_checkcustom_col": "date_id", "hapinsp_table_data_stop_ts_prior": "20240115T000000000000"}
    ctx = CheckContext(spark, "t", df, {"t": df}, known)
    out = BUILT_IN.checks["incremental_window"].body(ctx)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "(date_id" in plan and "> 2024015)" in plan.split("PartitionFilters")[1]
    assert '"data_stop_ts":"20240120T000000000000"' in out.first().raw_output
    stamps = df.selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(int(k)) AS ts")
    stamps.write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    ctx = CheckContext(spark, "t", df, {}, known | {"hapinsp_checkcustom_col": "ts"})
    plan = BUILT_IN.checks["incremental_window"].body(ctx)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,2024-01-15" in plan


def test_history_is_read_once(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")
    doc = {
        t: {
            "w": setup("incremental_window", col="ts"),
            "exist": entry("stats_exist"),
            "stale": entry("stats_not_stale", days=2),
            "inc": entry("range", check_mode="incremental", col="k", max=6),
        }
        for t in ("t", "u")
    }
    tables = {"t": table, "u": table}
    run_and_store(spark, registry(doc), tables, run(1), path)
    out = RunPlan(spark, registry(doc), tables, run(2), read_results(spark, path))
    plan = out.results()._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan


def test_consistency_checks_window_both_sides(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")

    def go(n, rows, spoilt=False):
        seen = table.where(F.col("k") < rows)
        peer = seen.withColumn("g", F.when(F.col("k") == 7, 9).otherwise(F.col("g"))) if spoilt else seen
        peer = peer.withColumnRenamed("ts", "at") if n == 9 else peer
        doc = {
            "t": {
                "w": setup("incremental_window", col="ts"),
                "rows": entry("peer_row_count", check_mode="incremental", peer="p"),
                "spots": entry(
                    "peer_field_spot_check", check_mode="incremental", peer="p", cols="k", fields="g", share=1
                ),
                "source": entry("target_vs_source", check_mode="incremental", source="p"),
                "sums": entry("base_vs_summary", check_mode="incremental", cols="k", base="p", total="one"),
            }
        }
        tables = {"t": seen.withColumn("one", F.lit(1)), "p": peer.withColumn("one", F.lit(1))}
        got = by_name(run_and_store(spark, registry(doc), tables, run(n), path))
        return [got[c].check_violation_cnt for c in ("rows", "spots", "source", "sums")]

    assert go(1, 4) == [0, 0, 0, 0]
    assert go(2, 6) == [0, 0, 0, 0]
    assert go(3, 9, spoilt=True) == [0, 1, 2, 0]
    assert go(9, 10) == [None, None, None, None]  # the peer has no column to tell the window by


def test_more_checks_by_name(spark, registry, table):
    starts = table.select("k", (F.col("ts") + F.expr("make_dt_interval(1)")).alias("begun")).where("k < 6")
    doc = {
        "t": {
            "days": entry("range", col="ts", min="2024-01-03", max="2024-01-08T12:00:00"),
            "pair": entry("ordered_pair_across", starts="s", starts_key="k", key="k", start="begun", stop="ts"),
            "parts": entry("range_by_partition", col="k", max=4, partition="g"),
        }
    }
    got = by_name(run_checks(spark, registry(doc), {"t": table, "s": starts}, run()))
    assert {k: (r.check_violation_cnt, r.check_rc) for k, r in got.items()} == {
        "days": (4, 0),
        "pair": (6, 0),
        "parts": (5, 0),
    }
    saved = {k: v for k, v in got["parts"].env_vars.items() if "_partition_" in k}
    assert saved == {"hapinsp_partition_0": "2", "hapinsp_partition_1": "1", "hapinsp_partition_2": "2"}


def test_repeating_a_run_adds_nothing(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")
    doc = {"t": {"a": entry("not_empty"), "b": entry("rule_uniqueness", cols="k")}}
    for _ in range(2):
        run_and_store(spark, registry(doc), {"t": table}, run(), path)
    assert read_results(spark, path).count() == 2


def test_profiles_and_their_age(spark, registry, table, tmp_path):
    path = str(tmp_path / "h")
    stale = entry("stats_not_stale", days=2)
    doc = {
        "t": {
            "profile": entry(
                "profile", check_type="profile", check_mode="full", check_scope="table", cols="k,g"
            ),
            "exist": entry("stats_exist"),
            "stale": stale,
        }
    }
    first = by_name(run_and_store(spark, registry(doc), {"t": table}, run(1), path))
    assert (first["exist"].check_violation_cnt, first["stale"].check_violation_cnt) == (1, 0)
    saved = first["profile"].env_vars
    assert first["profile"].check_type == "profile" and first["profile"].check_violation_cnt == 0
    assert (saved["hapinsp_profile_k_n_rows"], saved["hapinsp_profile_g_n_distinct"]) == ("10", "3")
    later = {"t": {"exist": entry("stats_exist"), "stale": stale}}
    for n, expected in [(2, 0), (5, 1)]:
        got = by_name(run_and_store(spark, registry(later), {"t": table}, run(n), path))
        assert (got["exist"].check_violation_cnt, got["stale"].check_violation_cnt) == (0, expected)
        assert got["exist"].check_unit == "tables"


def test_file_checks(spark, registry, table, tmp_path):
    path = tmp_path / "files"
    table.coalesce(1).write.parquet(str(path))
    (path / "notes.txt").write_text("x")
    doc = {
        "t": {
            "size": entry("block_size", path=str(path), min_bytes=100),
            "format": entry("file_format", path=str(path)),
        }
    }
    got = by_name(run_checks(spark, registry(doc), {"t": table}, run()))
    assert {k: r.check_violation_cnt for k, r in got.items()} == {"size": 1, "format": 1}
    assert got["size"].check_policy_type == "data-management"


def test_consistency_checks_by_name(spark, registry, table):
    peer = table.where(F.col("k") != 4).withColumn("g", F.when(F.col("k") == 5, 9).otherwise(F.col("g")))
    summary = spark.createDataFrame([(0, 4), (1, 3), (2, 4), (7, 1)], "g long, n long")
    doc = {
        "t": {
            "rows": entry("peer_row_count", peer="peer"),
            "spots": entry("peer_field_spot_check", peer="peer", cols="k", fields="g,ts", share=1),
            "source": entry("target_vs_source", source="peer"),
        },
        "s": {"sums": entry("base_vs_summary", cols="g", base="t", total="n")},
    }
    got = by_name(run_checks(spark, registry(doc), {"t": table, "peer": peer, "s": summary}, run()))
    counts = {k: (r.check_violation_cnt, r.check_policy_type) for k, r in got.items()}
    assert counts == {
        "rows": (1, "consistency"),
        "spots": (2, "consistency"),
        "source": (3, "consistency"),
        "sums": (2, "consistency"),
    }


def test_sql_check(spark, registry, table):
    doc = {
        "t": {
            "ok": entry(
                "sql",
                sql=f"SELECT count(*) AS violations FROM {{table}} JOIN {{u}} USING (k) "
                f"WHERE k > CAST(:{CUSTOM}above AS INT)",
                above=7,
            ),
            "injected": entry(
                "sql",
                sql=f"SELECT count(*) AS violations FROM {{table}} WHERE CAST(g AS STRING) = :{CUSTOM}v",
                v="1 OR 1 = 1",
            ),
            "broken": entry("sql", sql="SELEC 1"),
        }
    }
    got = by_name(run_checks(spark, registry(doc), {"t": table, "u": table}, run()))
    assert (got["ok"].check_violation_cnt, got["injected"].check_violation_cnt) == (2, 0)
    assert got["broken"].check_rc == 202
