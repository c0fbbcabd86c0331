"""Uniqueness, references and empty tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspections import query
from tablewarden.operators.key_checks import (
    duplicate_keys,
    foreign_key_violations,
    not_empty_violations,
    orphan_keys,
    uniqueness_violations,
)
from tablewarden.sources.tables import read_table


def _named(alias: str, violations: DataFrame) -> DataFrame:
    return violations.select(F.lit(alias).alias("check_alias"), "violations")


def _all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _excess_sql(*cases: tuple[str, str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{alias}' AS check_alias, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations "
        f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys} HAVING count(*) > 1)"
        for alias, table, keys in cases
    )


@query(
    "ck_unique",
    _excess_sql(
        ("part_name", "part", "p_name"),
        ("part_key", "part", "p_partkey"),
        ("customer_name", "customer", "c_name"),
        ("document_text", "documents", "text"),
        ("event_user", "events", "user_id"),
    ),
)
def ck_unique(spark, sf_dir):
    cases = [
        ("part_name", "part", "p_name"),
        ("part_key", "part", "p_partkey"),
        ("customer_name", "customer", "c_name"),
        ("document_text", "documents", "text"),
        ("event_user", "events", "user_id"),
    ]
    return _all(
        _named(a, uniqueness_violations(read_table(spark, t, directory=sf_dir), [c]))
        for a, t, c in cases
    )


@query(
    "ck_unique_composite",
    _excess_sql(
        ("order_line", "lineitem", "l_orderkey, l_linenumber"),
        ("part_supplier", "lineitem", "l_partkey, l_suppkey"),
        ("conversation_turn", "conversations", "conv_id, turn"),
    ),
)
def ck_unique_composite(spark, sf_dir):
    cases = [
        ("order_line", "lineitem", ["l_orderkey", "l_linenumber"]),
        ("part_supplier", "lineitem", ["l_partkey", "l_suppkey"]),
        ("conversation_turn", "conversations", ["conv_id", "turn"]),
    ]
    return _all(
        _named(a, uniqueness_violations(read_table(spark, t, directory=sf_dir), keys))
        for a, t, keys in cases
    )


@query(
    "dup_keys",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """,
)
def dup_keys(spark, sf_dir):
    return duplicate_keys(
        read_table(spark, "lineitem", directory=sf_dir), ["l_orderkey", "l_linenumber"]
    )


@query(
    "ck_foreign_key",
    """
    SELECT 'lineitem_open_or_filled_order' AS check_alias, count(*) AS violations FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
    UNION ALL
    SELECT 'document_label', count(*) FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL
    SELECT 'customer_order', count(*) FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL
    SELECT 'event_customer', count(*) FROM events
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)
    UNION ALL
    SELECT 'null_key_passes', 0 FROM lineitem HAVING count(*) >= 0
    """,
)
def ck_foreign_key(spark, sf_dir):
    def table(name):
        return read_table(spark, name, directory=sf_dir)

    orders = table("orders")
    no_key = table("lineitem").select(F.lit(None).cast("bigint").alias("l_orderkey"))
    cases = [
        (
            "lineitem_open_or_filled_order",
            table("lineitem"),
            orders.where(F.col("o_orderstatus") != "P"),
            "l_orderkey",
            "o_orderkey",
        ),
        ("document_label", table("documents"), table("labels"), "doc_id", "doc_id"),
        ("customer_order", table("customer"), orders, "c_custkey", "o_custkey"),
        ("event_customer", table("events"), table("customer"), "user_id", "c_custkey"),
        ("null_key_passes", no_key, orders, "l_orderkey", "o_orderkey"),
    ]
    return _all(
        _named(a, foreign_key_violations(child, parent, [key], [parent_key]))
        for a, child, parent, key, parent_key in cases
    )


@query(
    "ck_fk_composite",
    """
    SELECT 'line_before' AS check_alias, count(*) AS violations FROM lineitem a
    WHERE l_linenumber > 1 AND NOT EXISTS (
        SELECT 1 FROM lineitem b
        WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1)
    UNION ALL
    SELECT 'turn_after', count(*) FROM conversations a
    WHERE NOT EXISTS (
        SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)
    """,
)
def ck_fk_composite(spark, sf_dir):
    lineitem = read_table(spark, "lineitem", directory=sf_dir)
    turns = read_table(spark, "conversations", directory=sf_dir)
    before = F.nullif(F.col("l_linenumber") - 1, F.lit(0))
    return _all(
        [
            _named(
                "line_before",
                foreign_key_violations(
                    lineitem.select("l_orderkey", before.alias("line_before")),
                    lineitem,
                    ["l_orderkey", "line_before"],
                    ["l_orderkey", "l_linenumber"],
                ),
            ),
            _named(
                "turn_after",
                foreign_key_violations(
                    turns.select("conv_id", (F.col("turn") + 1).alias("turn_after")),
                    turns,
                    ["conv_id", "turn_after"],
                    ["conv_id", "turn"],
                ),
            ),
        ]
    )


@query(
    "orphan_keys",
    """
    SELECT l_orderkey, count(*) AS n FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
    GROUP BY l_orderkey
    """,
)
def list_orphan_keys(spark, sf_dir):
    orders = read_table(spark, "orders", directory=sf_dir)
    return orphan_keys(
        read_table(spark, "lineitem", directory=sf_dir),
        orders.where(F.col("o_orderstatus") != "P"),
        ["l_orderkey"],
        ["o_orderkey"],
    )


@query(
    "ck_not_empty",
    """
    SELECT 'orders' AS check_alias, CAST(count(*) = 0 AS BIGINT) AS violations
    FROM orders
    UNION ALL SELECT 'orders_lost', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END
    FROM orders WHERE o_orderstatus = 'X'
    UNION ALL SELECT 'labels', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM labels
    """,
)
def ck_not_empty(spark, sf_dir):
    orders = read_table(spark, "orders", directory=sf_dir)
    return _all(
        [
            _named("orders", not_empty_violations(orders)),
            _named("orders_lost", not_empty_violations(orders.where(F.col("o_orderstatus") == "X"))),
            _named("labels", not_empty_violations(read_table(spark, "labels", directory=sf_dir))),
        ]
    )
