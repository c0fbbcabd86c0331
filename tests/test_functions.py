import json

import pytest
from pyspark.sql import functions as F

from tablewarden.functions import scoring
from tablewarden.functions.outputs import parse_check_outputs, parse_setup_outputs
from tablewarden.functions.validators import is_iso8601, is_numeric
from tablewarden.functions.variables import (
    as_prior,
    clean_vars,
    merge_vars,
    sorted_vars_text,
    vars_json,
)


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_numeric_text(values):
    texts = ["3", " 3 ", "+3", "-3", "9" * 30, "3.7", "", "x", "3 4", "1e3", None]
    assert column(values(texts), is_numeric("v")) == [True] * 5 + [False] * 6


def test_numeric_numbers(values):
    assert column(values([3.7, float("nan"), None], "double"), is_numeric("v")) == [
        True,
        False,
        False,
    ]


BASIC = ["20150430T000000", "20150430T235959123456", "20150430t000000"]
EXT = ["2015-04-30T00:00:00", "2015-04-30T00:00:00.123456"]
NEITHER = [
    "20151330T000000",
    "20150229T000000",
    "20150430T240000",
    "20150430T000060",
    "00000430T000000",
    "2015-04-30",
    "20150430T00000",
    "",
    None,
]


@pytest.mark.parametrize(
    "kind, good", [("basic", BASIC), ("ext", EXT), ("any", BASIC + EXT)]
)
def test_iso8601(values, kind, good):
    texts = BASIC + EXT + NEITHER
    assert column(values(texts), is_iso8601("v", kind)) == [t in good for t in texts]


def test_iso8601_unknown_kind(spark):
    with pytest.raises(ValueError):
        is_iso8601("v", "week")


def maps(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a map<string,string>, b map<string,string>")


def test_merge_right_wins(spark):
    df = maps(
        spark, ({"x": "1", "y": "2"}, {"y": "3", "z": "4"}), (None, {"x": "1"}), ({"x": "1"}, None)
    )
    got = column(df, merge_vars(F.col("a"), F.col("b")))
    assert got == [{"x": "1", "y": "3", "z": "4"}, {"x": "1"}, {"x": "1"}]


def test_none_becomes_blank(spark):
    df = maps(spark, ({"x": None, "y": " None ", "z": "none at all"}, None))
    assert column(df, clean_vars(F.col("a"))) == [{"x": "", "y": "", "z": "none at all"}]


def test_prior_names(spark):
    df = maps(
        spark, ({"x": "1", "x_prior": "0", "y_prior": "5", "data_stop_ts": "t"}, None), (None, None)
    )
    assert column(df, as_prior(F.col("a"))) == [
        {"x_prior": "1", "y_prior": "5", "hapinsp_table_data_stop_ts_prior": "t"},
        {},
    ]


def test_map_texts(spark):
    df = maps(spark, ({"b": "2", "a": "1"}, None))
    assert column(df, sorted_vars_text(F.col("a"))) == ["a=1,b=2"]
    assert json.loads(column(df, vars_json(F.col("a")))[0]) == {"a": "1", "b": "2"}
    assert column(df, vars_json(F.col("b"))) == [""]


CHECKS = [
    ('{"rc":"0","violations":"9"}', 0, (True, 0, 9, "full")),
    ('{"rc":"0","violations":"0"}', 4, (True, 4, 0, "full")),
    ('{"rc":7,"violations":0}', 4, (True, 7, 0, "full")),
    ('{"rc":0,"violations":1,"mode":"incremental"}', 0, (True, 0, 1, "incremental")),
    ('{"rc":0,"violations":1,"hapinsp_x":"y"}\n', 0, (True, 0, 1, "full")),
    ('{"rc":0,"rc":2,"violations":1}', 0, (True, 2, 1, "full")),
    ("violation_cnt: 0", 0, (False, 202, -1, None)),
    ("{", 0, (False, 202, -1, None)),
    ("{}", 0, (False, 202, -1, None)),
    ('{"violations":1}', 0, (False, 202, -1, None)),
    ('{"rc":0}', 0, (False, 202, -1, None)),
    ('{"rc":null,"violations":1}', 0, (False, 202, -1, None)),
    ('{"rc":0,"violations":"many"}', 0, (False, 202, -1, None)),
    ('{"rc":"bad","violations":1}', 0, (False, 202, -1, None)),
    ('{"rc":0,"violations":1,"foo":2}', 0, (False, 202, -1, None)),
    ('{"rc":0,"violations":1} {"rc":0}', 0, (False, 202, -1, None)),
    ('{"rc":0,"violations":1} trailing', 0, (False, 202, -1, None)),
    ("{'rc':0,'violations':1}", 0, (False, 202, -1, None)),
    ('[{"rc":0,"violations":1}]', 0, (False, 202, -1, None)),
    ('{"name":"t","violations":9000,"Output":"x"}', 0, (False, 202, -1, None)),
    ("", 0, (False, 202, -1, None)),
    (None, 0, (False, 202, -1, None)),
]


def test_check_outputs(spark):
    df = spark.createDataFrame(
        [(i, raw, rc) for i, (raw, rc, _) in enumerate(CHECKS)],
        "i int, raw_output string, check_rc int",
    )
    got = parse_check_outputs(df).orderBy("i").collect()
    for row, (raw, _, expected) in zip(got, CHECKS):
        assert (row.valid, row.check_rc, row.violations, row["mode"]) == expected, raw


def test_outputs_from_files(spark, tmp_path):
    from tablewarden.sources.outputs import read_outputs

    records = [
        {"table_name": "t", "check_alias": str(i), "raw_output": raw, "check_rc": rc}
        for i, (raw, rc, _) in enumerate(CHECKS)
    ]
    (tmp_path / "batch.json").write_text("\n".join(json.dumps(r) for r in records))
    got = parse_check_outputs(read_outputs(spark, str(tmp_path))).collect()
    assert {int(r.check_alias): r.check_rc for r in got} == {
        i: expected[1] for i, (_, _, expected) in enumerate(CHECKS)
    }


def setups(spark, *raw):
    df = spark.createDataFrame(
        [(i, r, 0) for i, r in enumerate(raw)], "i int, raw_output string, check_rc int"
    )
    return parse_setup_outputs(df).orderBy("i").collect()


def test_good_setup_outputs(spark):
    custom, window, old, off, blank = setups(
        spark,
        '{"rc":"0","hapinsp_tablecustom_year":2015,"hapinsp_tablecustom_month":4}',
        '{"rc":"0","data_start_ts":"20150430T000000","data_stop_ts":"20150501T000000"}',
        '{"rc":"2","data_start_timestamp":"20150430T000000","mode":"incremental"}',
        '{"rc":0,"table_status":"inactive","log":"closed"}',
        '{"rc":0,"table_status":"","mode":"","data_start_ts":""}',
    )
    assert custom.custom_vars == {
        "hapinsp_tablecustom_year": "2015",
        "hapinsp_tablecustom_month": "4",
    }
    assert (custom.check_rc, custom["mode"], custom.table_status) == (0, "auto", "active")
    assert str(window.data_start_ts) == "2015-04-30 00:00:00"
    assert str(window.data_stop_ts) == "2015-05-01 00:00:00"
    assert (old.check_rc, old["mode"], str(old.data_start_ts)) == (
        2,
        "incremental",
        "2015-04-30 00:00:00",
    )
    assert off.table_status == "inactive"
    assert (blank.valid, blank["mode"], blank.table_status) == (True, "auto", "active")


def test_bad_setup_outputs(spark):
    rows = setups(
        spark,
        '{"rc":"0","data_start_ts":"2015-04-30"}',
        '{"rc":"0","data_start_ts":"20150430T000000","data_stop_timestamp":null}',
        None,
        "   ",
        "{",
        "{}",
        '{"rc":0,"hapinsp_tableblah_foo":1}',
        '{"hapinsp_tablecustom_foo":1}',
    )
    for row in rows:
        assert (row.valid, row.check_rc, row["mode"], row.custom_vars) == (False, 201, "auto", {})
        assert row.data_start_ts is None and row.data_stop_ts is None


# Golden values: unit, partition key, violations -> scope for an estimate of 5 rows.
SCOPES = [
    ("tables", None, 5, 100.0),
    ("tables", None, 0, 0.0),
    ("tables", None, 1, 100.0),
    ("rows", None, 5, 100.0),
    ("rows", None, 0, 0.0),
    ("rows", None, 1, 20.0),
    ("rows", "date_id", 5, 1.0),
    ("rows", "date_id", 0, 0.0),
    ("rows", "date_id", 1, 0.2),
]


def test_scopes(spark):
    df = spark.createDataFrame(
        [s[:3] for s in SCOPES], "unit string, partition_key string, violations long"
    )
    scope = scoring.violation_scope(
        F.col("violations"), F.col("unit"), F.col("partition_key"), F.lit(5)
    )
    assert column(df, scope) == [s[3] for s in SCOPES]


def test_scope_without_estimate_or_count(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (None, 5)], "v int, rows int")
    scope = scoring.violation_scope(F.col("v"), F.lit("rows"), F.lit(None), F.col("rows"))
    assert column(df, scope) == [None, None, None]


def test_severity(spark, values):
    df = values(["low", "medium", "high", None])
    assert column(df, scoring.severity_weight(F.col("v"))) == [10, 50, 100, 0]
    with pytest.raises(Exception, match="unknown severity: urgent"):
        column(values(["urgent"]), scoring.severity_weight(F.col("v")))


def test_severity_score(spark):
    df = spark.createDataFrame(
        [(100, 0.0), (100, 0.2), (10, 99.0), (50, 75.0), (100, 400.0), (0, 100.0), (10, None)],
        "w int, s double",
    )
    score = scoring.severity_score(F.col("w"), F.col("s"))
    assert column(df, score) == [0, 1, 9, 37, 100, 0, None]


def test_small_formulas(spark):
    df = spark.sql("SELECT timestamp_ntz'2015-03-02 02:03:04' AS ts, 'a-b-c' AS name")
    assert column(df, scoring.partition_value(F.lit("full"), F.col("ts"))) == ["2015061"]
    assert column(df, scoring.partition_value(F.lit(None), F.col("ts"))) == [None]
    assert column(df, scoring.timestamp_text(F.col("ts"))) == ["2015-03-02 02:03:04"]
    assert column(df, scoring.clean_name(F.col("name"))) == ["a_b_c"]
    assert column(df, scoring.reformat_time(F.lit("2015-03"), "yyyy-MM")) == ["2015-03-01"]
    for table, check, mode in [
        ("incremental", "incremental", "incremental"),
        ("incremental", "full", "full"),
        ("auto", "incremental", "full"),
        (None, "incremental", "full"),
    ]:
        assert column(df, scoring.effective_mode(F.lit(table), F.lit(check))) == [mode]
    for key, text, flag in [(None, "", "0"), ("", "", "0"), ("date_id", "date_id", "1")]:
        assert column(df, scoring.partition_key_text(F.lit(key))) == [text]
        assert column(df, scoring.partitioned_flag(F.lit(key))) == [flag]
    for count, label in [(0, "Passing"), (1, "Failing"), (None, "Failing")]:
        assert column(df, scoring.pass_label(F.lit(count))) == [label]
