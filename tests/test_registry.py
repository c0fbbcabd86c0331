import json

import pytest

from tablewarden.plans import registry as plan
from tablewarden.sources.config import read_config
from tablewarden.sources.registry import read_registry

WEIGHT = {
    "check_status": "active",
    "check_scope": "row",
    "check_mode": "incremental",
    "check_name": "range",
    "check_type": "rule",
    "hapinsp_checkcustom_max": 40.5,
}
SOUND = {"parcels": {"heavy": WEIGHT}, "routes": {"heavy": WEIGHT, "long": WEIGHT}}


@pytest.fixture
def load(spark, tmp_path):
    def read(text):
        path = tmp_path / "registry.json"
        path.write_text(text if isinstance(text, str) else json.dumps(text, indent=2))
        return read_registry(spark, str(path))

    return read


def one(load, **changes):
    entry = {k: v for k, v in (WEIGHT | changes).items() if v != "absent"}
    return plan.default_registry(load({"parcels": {"c": entry}}))


def problems(df):
    return [list(r.problems) for r in plan.registry_problems(df).collect()]


def names(df):
    return sorted((r.table_name, r.check_alias) for r in df.collect())


def test_good_registry(load):
    df = load(SOUND)
    assert names(df) == [("parcels", "heavy"), ("routes", "heavy"), ("routes", "long")]
    assert {tuple(r.custom.items()) for r in df.collect()} == {(("hapinsp_checkcustom_max", "40.5"),)}
    assert problems(plan.default_registry(df)) == []
    assert len(plan.valid_entries(df, ["range", "length"])) == 3


@pytest.mark.parametrize(
    "text",
    [
        '{"routes": {"long": {"check_name": "range"},}}',
        "{'routes': {'long': {'check_name': 'range'}}}",
        '{"routes": {"long": {"check_name": "range"}}',
        '{"routes": {"long": {}}} [1]',
        '[{"routes": {"long": {"check_name": "range"}}}]',
        '{"routes": {"long": ["range"]}}',
        '{"routes": 7}',
        "routes.long = range",
    ],
)
def test_malformed_registry_fails(load, text):
    with pytest.raises(Exception, match="invalid registry"):
        load(text).collect()


def test_defaults(load):
    row = one(load, check_type="absent", check_mode="absent", check_scope="absent", check_status="absent").first()
    assert (row.check_type, row.check_mode, row.check_scope, row.check_status) == (
        "rule",
        "full",
        "row",
        "active",
    )
    setup = one(load, check_type="setup", check_mode="absent", check_scope="absent").first()
    assert (setup.check_mode, setup.check_scope) == (None, None)
    profile = one(load, check_type="profile", check_mode="absent", check_scope="absent").first()
    assert (profile.check_mode, profile.check_scope) == (None, None)


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({"check_mode": "fullish"}, ["check_mode"]),
        ({"check_mode": None}, ["check_mode"]),
        ({"check_scope": "column"}, ["check_scope"]),
        ({"check_status": "paused"}, ["check_status"]),
        ({"check_type": "warning"}, ["check_type"]),
        ({"check_name": None}, ["check_name"]),
        ({"check_name": "absent"}, ["check_name"]),
        ({"check_type": "setup", "check_mode": "full"}, ["check_scope"]),
        ({"check_type": "teardown", "check_mode": "absent", "check_scope": None}, ["check_mode"]),
        ({"check_type": "profile", "check_mode": "absent"}, ["check_mode"]),
        ({"color": "red"}, ["custom"]),
    ],
)
def test_bad_entries(load, changes, expected):
    df = one(load, **changes)
    assert problems(df) == [expected]
    with pytest.raises(plan.RegistryError):
        plan.valid_entries(df, ["range"])


@pytest.mark.parametrize(
    "changes",
    [
        {"check_type": "setup", "check_mode": None, "check_scope": None},
        {"check_type": "setup", "check_mode": "absent", "check_scope": "absent"},
        {"check_type": "setup", "check_mode": "anything", "check_scope": None},
        {"check_type": "teardown", "check_mode": None, "check_scope": None},
        {"check_type": "profile"},
    ],
)
def test_good_entries(load, changes):
    assert problems(one(load, **changes)) == []


@pytest.mark.parametrize(
    "table, check, expected",
    [
        (None, None, [("parcels", "heavy"), ("routes", "heavy"), ("routes", "long")]),
        ("routes", None, [("routes", "heavy"), ("routes", "long")]),
        (None, "heavy", [("parcels", "heavy"), ("routes", "heavy")]),
        ("routes", "long", [("routes", "long")]),
        ("parcels", "long", []),
    ],
)
def test_filter(load, table, check, expected):
    assert names(plan.filter_registry(load(SOUND), table, check)) == expected


@pytest.mark.parametrize("text", ["{}", ""])
def test_empty_registry_is_an_error(load, text):
    with pytest.raises(plan.RegistryError):
        plan.filter_registry(load(text))


def test_repeated_property(load):
    df = load('{"parcels": {"c": {"check_name": "x", "check_status": "active", "check_name": "y"}}}')
    assert problems(plan.default_registry(df)) == [["repeated"]]


def test_unknown_check(load):
    with pytest.raises(plan.RegistryError, match="no check range"):
        plan.valid_entries(load(SOUND), ["case"])


def test_inactive_placeholders(load):
    df = one(load, check_status="inactive")
    row = plan.inactive_rows(df).first()
    assert (row.violations, row.check_rc) == (-1, -1)
    setup = one(load, check_type="setup", check_status="inactive", check_scope=None)
    assert plan.inactive_rows(setup).count() == 0


def test_config(spark, tmp_path):
    check = {
        "severity": "low",
        "violation_unit": "tables",
        "failure_rate": 0.1,
        "mode": "full",
        "policy_type": "data-management",
        "check_type": "rule",
    }
    config = {
        "customers": {
            "partition_row_cnt_avg": 10000,
            "partition_key": None,
            "cols": ["cust_id", "cust_name"],
            "checks": {"stats_exist": check, "stats_not_stale": check},
            "mode": "full",
        }
    }
    path = tmp_path / "instance-east_db-shop_config.json"
    path.write_text(json.dumps(config, indent=1))
    tables, checks = read_config(spark, str(path))
    row = tables.first()
    assert (row.instance_name, row.database_name) == ("east", "shop")
    assert (row.avg_rows, row.partition_key, row.cols) == (10000.0, None, ["cust_id", "cust_name"])
    assert sorted(r.check_name for r in checks.collect()) == ["stats_exist", "stats_not_stale"]
    path.write_text("{")
    with pytest.raises(Exception, match="invalid instance configuration"):
        read_config(spark, str(path))[0].collect()
