"""Whole runs: a registry of checks over the test tables."""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspections import query
from tablewarden.functions.moments import moment
from tablewarden.operators.catalogue import BUILT_IN
from tablewarden.operators.fused import count_bad_rows
from tablewarden.plans.runner import Run, run_and_store, run_checks
from tablewarden.schema import CHECK_CUSTOM_PREFIX
from tablewarden.session import shared_folder
from tablewarden.sources.partitions import PartitionResults
from tablewarden.sources.registry import parse_registry
from tablewarden.sources.results import read_results
from tablewarden.sources.tables import read_table

TABLES = ["customer", "orders", "lineitem", "part", "documents", "labels", "events"]


def check(name: str, mode: str | None = None, status: str | None = None, **custom) -> dict:
    """A registry entry; defaults are left to the registry."""
    entry = {"check_name": name, "check_mode": mode, "check_status": status}
    entry = {k: v for k, v in entry.items() if v is not None}
    return entry | {CHECK_CUSTOM_PREFIX + k: str(v) for k, v in custom.items()}


def setup(name: str, **custom) -> dict:
    return {"check_type": "setup"} | check(name, **custom)


REGISTRY = {
    "customer": {
        "balance_ck": check("range", col="c_acctbal", min=0),
        "name_uk": check("rule_uniqueness", cols="c_name"),
        "not_empty": check("not_empty"),
    },
    "orders": {
        "customer_fk": check("foreign_key", cols="o_custkey", parent="customer", parent_cols="c_custkey"),
        "date_ck": check("range", col="o_orderdate", min="1993-01-01", max="2001-06-30T12:00:00"),
        "price_ck": check("range", col="o_totalprice", min=5000, max=450000),
        "priority_ck": check("format", col="o_orderpriority", pattern="^[1-5]-[A-Z]+$"),
        "retention_ck": check("retention", col="o_orderdate", reference="2001-08-01", days=365),
        "status_ck": check("enum", col="o_orderstatus", values="O,F"),
        "unknown_ck": check("unknown", status="inactive", col="o_orderpriority", values="-"),
    },
    "lineitem": {
        "line_uk": check("rule_uniqueness", cols="l_orderkey,l_linenumber"),
        "missing_column": check("not_null", cols="l_nothing"),
        "order_fk": check("foreign_key", cols="l_orderkey", parent="orders", parent_cols="o_orderkey"),
        "quantity_ck": check("range", col="l_quantity", max=45),
        "quantity_by_status": check("range_by_partition", col="l_quantity", max=45, partition="l_linestatus"),
        "shipped_ck": check(
            "ordered_pair_across", starts="orders", starts_key="o_orderkey", start="o_orderdate",
            key="l_orderkey", stop="l_shipdate",
        ),
        "tax_ck": check("range", col="l_tax", max=0.07),
    },
    "documents": {
        "label_fk": check("foreign_key", cols="doc_id", parent="labels"),
        "length_ck": check("length", col="text", min=20, max=5000),
        "source_case": check("case", col="source", case="upper"),
    },
    "events": {"value_warning": check("outlier", col="value", deviations=2)},
}


def registry_frame(spark: SparkSession, registry: dict) -> DataFrame:
    docs = spark.range(1).select(F.lit(json.dumps(registry)).alias("value"))
    return parse_registry(docs)


def inspect(spark: SparkSession, sf_dir: str, registry: dict = REGISTRY, **options) -> DataFrame:
    tables = {t: read_table(spark, t, directory=sf_dir) for t in TABLES}
    return run_checks(
        spark,
        registry_frame(spark, registry),
        tables,
        Run("test", "main", 1, dt.datetime(2024, 3, 1, 2)),
        **options,
    )


STABLE = [
    "table_name",
    "check_name",
    "check_type",
    "check_policy_type",
    "check_mode",
    "check_unit",
    "check_status",
    "check_rc",
    "check_violation_cnt",
]


def _row(table, check_name, count, policy="quality", unit="rows", **values) -> str:
    v = {"mode": "full", "status": "active", "rc": 0} | values
    return (
        f"SELECT '{table}' AS table_name, '{check_name}' AS check_name, 'rule' AS check_type, "
        f"'{policy}' AS check_policy_type, '{v['mode']}' AS check_mode, '{unit}' AS check_unit, "
        f"'{v['status']}' AS check_status, {v['rc']} AS check_rc, "
        f"CAST(({count}) AS BIGINT) AS check_violation_cnt"
    )


def _count(table: str, bad: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {bad}"


def _union(*rows: str) -> str:
    return "\nUNION ALL\n".join(rows)


@query(
    "run_checks",
    _union(
        _row("customer", "balance_ck", _count("customer", "c_acctbal < 0")),
        _row("customer", "name_uk", "SELECT count(*) - count(DISTINCT c_name) FROM customer"),
        _row("customer", "not_empty", "0", unit="tables"),
        _row(
            "orders",
            "customer_fk",
            _count("orders", "o_custkey NOT IN (SELECT c_custkey FROM customer)"),
        ),
        _row("orders", "price_ck", _count("orders", "NOT o_totalprice BETWEEN 5000 AND 450000")),
        _row(
            "orders",
            "date_ck",
            _count(
                "orders",
                "NOT o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '2001-06-30 12:00:00'",
            ),
        ),
        _row(
            "orders",
            "priority_ck",
            _count("orders", "NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+$')"),
        ),
        _row(
            "orders",
            "retention_ck",
            _count("orders", "o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 365 DAY"),
            policy="data-management",
        ),
        _row("orders", "status_ck", _count("orders", "o_orderstatus NOT IN ('O', 'F')")),
        _row("orders", "unknown_ck", "-1", status="inactive", rc=-1),
        _row(
            "lineitem",
            "line_uk",
            "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem",
        ),
        _row("lineitem", "missing_column", "-1", mode="", rc=202),
        _row(
            "lineitem",
            "order_fk",
            _count("lineitem", "l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
        ),
        _row("lineitem", "quantity_ck", _count("lineitem", "l_quantity > 45")),
        _row("lineitem", "quantity_by_status", _count("lineitem", "l_quantity > 45")),
        _row(
            "lineitem",
            "shipped_ck",
            _count("lineitem JOIN orders ON l_orderkey = o_orderkey", "NOT o_orderdate < l_shipdate"),
        ),
        _row("lineitem", "tax_ck", _count("lineitem", "l_tax > 0.07")),
        _row(
            "documents",
            "label_fk",
            _count("documents", "doc_id NOT IN (SELECT doc_id FROM labels)"),
        ),
        _row("documents", "length_ck", _count("documents", "NOT length(text) BETWEEN 20 AND 5000")),
        _row("documents", "source_case", _count("documents", "source <> upper(source)")),
        _row(
            "events",
            "value_warning",
            _count(
                "events",
                "abs(value - (SELECT avg(value) FROM events)) "
                "> 2 * (SELECT stddev_samp(value) FROM events)",
            ),
        ),
    ),
)
def checks_of_registry(spark, sf_dir):
    return inspect(spark, sf_dir).select(*STABLE)


@query(
    "sql_check",
    _union(
        _row("orders", "late_lines", _count(
            "lineitem JOIN orders ON l_orderkey = o_orderkey", "l_shipdate < o_orderdate")),
        _row("orders", "price_limit", _count("orders", "o_totalprice > 400000")),
        _row("orders", "no_count", "-1", mode="", rc=202),
        _row("orders", "digit_first", _count("orders", "regexp_matches(o_orderpriority, '^[0-9]{1}-')")),
        _row("orders", "no_such_place", "-1", mode="", rc=202),
    ),
)
def sql_check(spark, sf_dir):
    registry = {
        "orders": {
            "price_limit": check(
                "sql",
                sql="SELECT count(*) AS violations FROM {table} "
                f"WHERE o_totalprice > CAST(:{CHECK_CUSTOM_PREFIX}limit AS DOUBLE)",
                limit=400000,
            ),
            "late_lines": check(
                "sql",
                sql="SELECT count(*) AS violations, 0 AS rc FROM {table} "
                "JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate",
            ),
            "no_count": check("sql", sql="SELECT o_orderstatus AS violations FROM {table}"),
            "digit_first": check(
                "sql", sql="SELECT count(*) AS violations FROM {table} WHERE o_orderpriority RLIKE '^[0-9]{1}-'"
            ),
            "no_such_place": check("sql", sql="SELECT {0} AS violations FROM {table}"),
        }
    }
    return inspect(spark, sf_dir, registry).select(*STABLE)


OWN = BUILT_IN.copy()


@OWN.add("urgent_and_cheap", "row")
def _urgent_and_cheap(ctx):
    """Narrows down the built-in range check."""
    cheap = BUILT_IN.checks["range"].body(ctx)
    return cheap & (F.col("o_orderpriority") == "1-URGENT")


@OWN.add("busy_days", "table", unit="rows", policy="consistency")
def _busy_days(ctx):
    """Days with more orders than allowed, reported with a return code."""
    per_day = ctx.df.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    return count_bad_rows(per_day, F.col("n") > int(ctx.custom("most"))).withColumn("rc", F.lit(3))


@OWN.add("broken", "row")
def _broken(ctx):
    """Raises while it is planned."""
    return ctx.no_such_attribute


@OWN.add("breaks", "row")
def _breaks(ctx):
    """Raises while it runs."""
    return F.when(F.col("o_orderkey") > 5, F.raise_error(F.lit("breaks")).cast("boolean")).otherwise(False)


@query(
    "custom_check",
    _union(
        _row("orders", "cheap_urgent", _count(
            "orders", "o_totalprice < 50000 AND o_orderpriority = '1-URGENT'")),
        _row("orders", "days", "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderdate "
             "HAVING count(*) > 9)", policy="consistency", rc=3),
        _row("orders", "broken", "-1", mode="", rc=202),
        _row("orders", "breaks", "-1", mode="", rc=202),
        _row("orders", "priority_number", "-1", mode="", rc=202),
    ),
)
def custom_check(spark, sf_dir):
    registry = {
        "orders": {
            "cheap_urgent": check("urgent_and_cheap", col="o_totalprice", min=50000),
            "days": check("busy_days", most=9),
            "broken": check("broken"),
            "breaks": check("breaks"),
            "priority_number": check("range", col="o_orderpriority", max=3),
        }
    }
    return inspect(spark, sf_dir, registry, catalogue=OWN).select(*STABLE)


# The second run's setup names a column that does not exist.
_RUN_ENDS = ["1998-01-01", "1999-01-01", "2000-01-01", "2002-01-01"]
_FAILING = 1


def _runs_sql() -> str:
    rows = []
    for table, at in [("orders", "o_orderdate"), ("days", "date_trunc('day', o_orderdate)")]:
        start = None
        for i, end in enumerate(_RUN_ENDS):
            seen = f"o_orderdate <= TIMESTAMP '{end}'"
            stop = f"(SELECT max({at}) FROM orders WHERE {seen})"
            since = f"{seen} AND {at} > {start}" if start else seen
            run_start = f"TIMESTAMP '2024-03-0{i + 1} 02:00:00'"
            broken = i == _FAILING
            for name, mode, rc, bad in [
                ("price_ck", "" if broken else "incremental", 202 if broken else 0, f"{since} AND o_totalprice > 450000"),
                ("status_ck", "full", 0, f"{seen} AND o_orderstatus = 'P'"),
                ("window", "auto" if broken else "incremental", 201 if broken else 0, None),
            ]:
                windowed = mode == "incremental"
                count = "NULL" if bad is None or rc else _count("orders", bad)
                begin = f"coalesce({start or 'NULL'}, {run_start})" if windowed else run_start
                rows.append(
                    f"SELECT CAST({i + 1} AS BIGINT) AS run_id, '{table}' AS table_name, '{name}' AS check_name, "
                    f"'{mode}' AS check_mode, {rc} AS check_rc, CAST(({count}) AS BIGINT) AS check_violation_cnt, "
                    f"CAST({begin} AS TIMESTAMP) AS data_start_timestamp, "
                    f"CAST({stop if windowed else 'NULL'} AS TIMESTAMP) AS data_stop"
                )
            start = start if broken else stop
    return _union(*rows)


@query("run_incremental", _runs_sql())
def run_incremental(spark, sf_dir):
    """Four runs over growing tables; each carries on where the last good one ended.

    One table has timestamps, the other whole numbers that write a day, as partition keys do.
    """

    def registry(failing: bool) -> dict:
        def of(column: str) -> dict:
            return {
                "window": setup("incremental_window", col="nothing" if failing else column),
                "price_ck": check("range", mode="incremental", col="o_totalprice", max=450000),
                "status_ck": check("enum", col="o_orderstatus", values="O,F"),
            }

        return {"orders": of("o_orderdate"), "days": of("date_id")}

    orders = read_table(spark, "orders", directory=sf_dir)
    days = orders.withColumn("date_id", F.date_format("o_orderdate", "yyyyDDD").cast("int"))
    path = shared_folder(spark)
    runs = []
    for i, end in enumerate(_RUN_ENDS):
        arrived = F.col("o_orderdate") <= moment(dt.datetime.fromisoformat(end))
        run = Run("test", "main", i + 1, dt.datetime(2024, 3, i + 1, 2))
        tables = {"orders": orders.where(arrived), "days": days.where(arrived)}
        rules = registry_frame(spark, registry(i == _FAILING))
        runs.append(run_and_store(spark, rules, tables, run, path))
    every = reduce(DataFrame.unionByName, runs)
    windowed = F.col("check_mode") == "incremental"
    return every.select(
        "run_id",
        "table_name",
        "check_name",
        "check_mode",
        "check_rc",
        "check_violation_cnt",
        "data_start_timestamp",
        F.when(windowed, F.col("data_stop_timestamp")).alias("data_stop"),
    )


_THREE_ENDS = ["1998-01-01", "2000-01-01", "2002-01-01"]


def _consistency_sql() -> str:
    rows, before = [], None
    for i, end in enumerate(_THREE_ENDS):
        seen = f"o_orderdate <= TIMESTAMP '{end}'"
        inside = f"{seen} AND o_orderdate > {before}" if before else seen
        lost, changed = f"{inside} AND o_orderkey % 50 = 0", f"{inside} AND o_orderkey % 40 = 7"
        busy = f"SELECT count(*) FROM (SELECT 1 FROM orders WHERE {inside} GROUP BY o_orderdate HAVING count(*) > 1)"
        for name, count in [
            *[(f"{kind}_same", "0") for kind in ("rows", "spots", "source", "sums")],
            ("rows_bad", _count("orders", lost)),
            ("spots_bad", f"({_count('orders', lost)}) + ({_count('orders', changed)})"),
            ("source_bad", f"({_count('orders', lost)}) + 2 * ({_count('orders', changed)})"),
            ("sums_bad", busy),
        ]:
            rows.append(
                f"SELECT CAST({i + 1} AS BIGINT) AS run_id, '{name}' AS check_name, 'incremental' AS check_mode, "
                f"0 AS check_rc, CAST(({count}) AS BIGINT) AS check_violation_cnt"
            )
        before = f"(SELECT max(o_orderdate) FROM orders WHERE {seen})"
    return _union(*rows)


@query("run_incremental_consistency", _consistency_sql())
def run_incremental_consistency(spark, sf_dir):
    """Three runs against an equal and a spoilt peer, and an equal and a spoilt summary per day."""
    window = setup("incremental_window", col="o_orderdate")

    def peers(which: str) -> dict:
        inc = {"mode": "incremental"}
        return {
            f"rows_{which}": check("peer_row_count", **inc, peer=which),
            f"spots_{which}": check(
                "peer_field_spot_check", **inc, peer=which, cols="o_orderkey", fields="o_totalprice,o_orderdate", share=1
            ),
            f"source_{which}": check("target_vs_source", **inc, source=which),
        }

    def sums(which: str) -> dict:
        rule = check("base_vs_summary", mode="incremental", cols="o_orderdate", base="orders", total="n")
        return {"window": window, f"sums_{which}": rule}

    registry = {
        "orders": {"window": window} | peers("same") | peers("bad"),
        "sums_same": sums("same"),
        "sums_bad": sums("bad"),
    }
    orders = read_table(spark, "orders", directory=sf_dir)
    changed = F.when(F.col("o_orderkey") % 40 == 7, 1).otherwise(0)
    path = shared_folder(spark)
    runs = []
    for i, end in enumerate(_THREE_ENDS):
        seen = orders.where(F.col("o_orderdate") <= moment(dt.datetime.fromisoformat(end)))
        spoilt = seen.where(F.col("o_orderkey") % 50 != 0).withColumn("o_totalprice", F.col("o_totalprice") + changed)
        per_day = seen.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))
        more = F.when(F.col("n") > 1, F.col("n") + 1).otherwise(F.col("n"))
        tables = {
            "orders": seen, "same": seen, "bad": spoilt,
            "sums_same": per_day, "sums_bad": per_day.withColumn("n", more),
        }
        run = Run("test", "main", i + 1, dt.datetime(2024, 3, i + 1, 2))
        runs.append(run_and_store(spark, registry_frame(spark, registry), tables, run, path))
    every = reduce(DataFrame.unionByName, runs).where("check_type <> 'setup'")
    return every.select("run_id", "check_name", "check_mode", "check_rc", "check_violation_cnt")


# Rows of orders come in three runs. A tenth of those of the first years comes with the second run, for days that
# the first run has inspected.
_ARRIVAL = (
    "CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderkey % 10 <> 3 THEN 1 "
    "WHEN o_orderdate <= TIMESTAMP '2000-01-01' THEN 2 ELSE 3 END"
)


def _late_sql() -> str:
    rows = []
    for table in ("moments", "days"):
        for i in (1, 2, 3):
            price = f"SELECT count(*) FROM came WHERE run = {i} AND o_totalprice > 450000"
            keys = f"SELECT count(*) FILTER (run = {i}) - count(DISTINCT CASE WHEN first = {i} THEN o_custkey END) FROM came"
            for name, count in (("price_ck", price), ("customer_uk", keys)):
                rows.append(
                    f"SELECT CAST({i} AS BIGINT) AS run_id, '{table}' AS table_name, '{name}' AS check_name, "
                    f"'incremental' AS check_mode, CAST(({count}) AS BIGINT) AS check_violation_cnt"
                )
    return (
        f"WITH runs AS (SELECT *, {_ARRIVAL} AS run FROM orders), "
        "came AS (SELECT *, min(run) OVER (PARTITION BY o_custkey) AS first FROM runs)\n" + _union(*rows)
    )


@query("run_incremental_late", _late_sql())
def run_incremental_late(spark, sf_dir):
    """Three runs; rows that come late for inspected days, and keys that older rows have, each count once."""

    def of(column: str) -> dict:
        return {
            "window": setup("incremental_window", col=column),
            "price_ck": check("range", mode="incremental", col="o_totalprice", max=450000),
            "customer_uk": check("rule_uniqueness", mode="incremental", cols="o_custkey"),
        }

    orders = read_table(spark, "orders", directory=sf_dir).withColumn("run", F.expr(_ARRIVAL))
    days = orders.withColumn("date_id", F.date_format("o_orderdate", "yyyyDDD").cast("int"))
    path, rules = shared_folder(spark), registry_frame(spark, {"moments": of("o_orderdate"), "days": of("date_id")})
    runs = []
    for i in (1, 2, 3):
        tables = {"moments": orders.where(F.col("run") <= i), "days": days.where(F.col("run") <= i)}
        runs.append(run_and_store(spark, rules, tables, Run("test", "main", i, dt.datetime(2024, 3, i, 2)), path))
    every = reduce(DataFrame.unionByName, runs).where("check_type <> 'setup'")
    return every.select("run_id", "table_name", "check_name", "check_mode", "check_violation_cnt")


_FIRST_STOP = "(SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01')"


@query(
    "run_incremental_statistics",
    f"""
    WITH first AS (SELECT * FROM orders WHERE o_orderdate <= {_FIRST_STOP}),
    facts AS (
        SELECT count(*) AS n_rows, min(o_totalprice) AS low, max(o_totalprice) AS high, avg(o_totalprice) AS mean,
               count(DISTINCT o_totalprice) AS n_distinct FROM orders)
    SELECT CAST(1 AS BIGINT) AS run_id, 'far' AS check_name, CAST(count(*) AS BIGINT) AS check_violation_cnt,
           CAST(NULL AS VARCHAR) AS n_rows, CAST(NULL AS VARCHAR) AS min_value, CAST(NULL AS VARCHAR) AS max_value,
           CAST(NULL AS BOOLEAN) AS avg_is_close, CAST(NULL AS BOOLEAN) AS distinct_is_close,
           CAST(NULL AS BOOLEAN) AS median_is_close
    FROM first WHERE abs(o_totalprice - (SELECT avg(o_totalprice) FROM first))
        > 1.6 * (SELECT stddev_samp(o_totalprice) FROM first)
    UNION ALL
    SELECT 2, 'far', count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM orders
    WHERE o_orderdate > {_FIRST_STOP} AND abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders))
        > 1.6 * (SELECT stddev_samp(o_totalprice) FROM orders)
    UNION ALL
    SELECT 2, 'facts', 0, CAST(n_rows AS VARCHAR), CAST(low AS VARCHAR), CAST(high AS VARCHAR), true, true, true FROM facts
    """,
)
def run_incremental_statistics(spark, sf_dir):
    """Two windows: outliers are told by all rows so far, and the merged profile is that of the whole table.

    Sketches are compared with the exact figures: distinct values within 6 %, the rank of the median within 3 %.
    """
    orders = read_table(spark, "orders", directory=sf_dir)
    checks = {
        "window": setup("incremental_window", col="o_orderdate"),
        "far": check("outlier", mode="incremental", col="o_totalprice", deviations=1.6),
        "facts": check("profile", mode="incremental", cols="o_totalprice") | {"check_type": "profile", "check_scope": "row"},
    }
    path, rules, runs = shared_folder(spark), registry_frame(spark, {"orders": checks}), []
    for i, end in enumerate(["1999-01-01", "2100-01-01"]):
        seen = orders.where(F.col("o_orderdate") <= moment(dt.datetime.fromisoformat(end)))
        run = Run("test", "main", i + 1, dt.datetime(2024, 3, i + 1, 2))
        runs.append(run_and_store(spark, rules, {"orders": seen}, run, path))
    every = reduce(DataFrame.unionByName, runs).where("check_name = 'far' or (check_name = 'facts' and run_id = 2)")
    # what the sketches are held against: a row
    price = F.col("o_totalprice")
    exact = orders.agg(F.avg(price).alias("_mean"), F.count_distinct(price).alias("_distinct"), F.percentile(price, F.array(F.lit(0.47), F.lit(0.53))).alias("_near"))
    facts = F.col("check_name") == "facts"
    saved = lambda name: F.col("env_vars")[f"hapinsp_profile_o_totalprice_{name}"]
    held = every.join(F.broadcast(exact), F.lit(True))
    return held.select(
        "run_id",
        "check_name",
        "check_violation_cnt",
        saved("n_rows").alias("n_rows"),
        saved("min_value").alias("min_value"),
        saved("max_value").alias("max_value"),
        F.when(facts, F.abs(saved("avg_value").cast("double") - F.col("_mean")) < 0.01).alias("avg_is_close"),
        F.when(facts, F.abs(saved("n_distinct").cast("double") / F.col("_distinct") - 1) < 0.06).alias("distinct_is_close"),
        F.when(facts, saved("median").cast("double").between(F.col("_near")[0], F.col("_near")[1])).alias("median_is_close"),
    )


@query(
    "run_by_partition",
    """
    SELECT 'quantity_by_day' AS check_name, 'day' AS partition_name, strftime(l_shipdate, '%Y%j') AS partition_value,
           count(*) AS violations FROM lineitem WHERE l_quantity > 45 GROUP BY ALL
    """,
)
def run_by_partition(spark, sf_dir):
    """What a check found in each partition, read back from beside the history."""
    lineitem = read_table(spark, "lineitem", directory=sf_dir).withColumn("day", F.date_format("l_shipdate", "yyyyDDD"))
    rules = {"lineitem": {"quantity_by_day": check("range_by_partition", col="l_quantity", max=45, partition="day")}}
    path = shared_folder(spark)
    run_and_store(spark, registry_frame(spark, rules), {"lineitem": lineitem}, Run("test", "main", 1, dt.datetime(2024, 3, 1, 2)), path)
    kept = PartitionResults(spark, path).committed(read_results(spark, path))
    return kept.select("check_name", "partition_name", "partition_value", "violations")
