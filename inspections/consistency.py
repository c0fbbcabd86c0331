"""Base against summary, table against replica, target against source.

The replica of ``orders`` is derived: it has not yet received the orders of the
last month and still shows urgent pending ones as open.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from inspections import query
from tablewarden.functions.moments import moment
from tablewarden.operators.consistency import (
    base_vs_summary,
    count_row_differences,
    peer_row_count,
    peer_spot_check,
    target_vs_source,
)
from tablewarden.sources.tables import read_table

REPLICA_SQL = """
    replica AS (
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'O'
                    ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01')"""


_SAMPLED = (
    "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) < " + str(int(0.1 * 2**60))
)


def replica_of(orders):
    late = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return orders.where(
        F.col("o_orderdate") < moment(dt.datetime(2001, 7, 1))
    ).withColumn("o_orderstatus", F.when(late, F.lit("O")).otherwise(F.col("o_orderstatus")))


@query(
    "ck_base_vs_summary",
    """
    WITH base AS (
        SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS v
        FROM lineitem GROUP BY l_orderkey),
    prices AS (
        SELECT CASE WHEN l_orderkey IS NULL THEN 'missing in base'
                    WHEN o_orderkey IS NULL THEN 'missing in summary'
                    WHEN abs(v - o_totalprice) <= 100000 THEN NULL
                    ELSE 'different' END AS problem
        FROM base FULL OUTER JOIN orders ON l_orderkey = o_orderkey),
    lines AS (
        SELECT CASE WHEN a.n = b.n THEN NULL ELSE 'different' END AS problem
        FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a
        FULL OUTER JOIN
             (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) b
        ON a.l_orderkey = b.l_orderkey)
    SELECT 'order_price' AS check_alias, problem, count(*) AS violations
    FROM prices WHERE problem IS NOT NULL GROUP BY problem
    UNION ALL
    SELECT 'order_lines', problem, count(*) FROM lines WHERE problem IS NOT NULL GROUP BY problem
    """,
)
def ck_base_vs_summary(spark, sf_dir):
    lineitem = read_table(spark, "lineitem", directory=sf_dir)
    orders = read_table(spark, "orders", directory=sf_dir)
    prices = base_vs_summary(
        lineitem,
        orders,
        ["l_orderkey"],
        ["o_orderkey"],
        F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "o_totalprice",
        tolerance=100000,
    )
    summary = lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("n_lines"))
    lines = base_vs_summary(
        lineitem, summary, ["l_orderkey"], ["l_orderkey"], F.lit(1).cast("bigint"), "n_lines"
    )
    return prices.select(F.lit("order_price").alias("check_alias"), "problem").unionByName(
        lines.select(F.lit("order_lines").alias("check_alias"), "problem")
    ).groupBy("check_alias", "problem").agg(F.count(F.lit(1)).alias("violations"))


@query(
    "ck_peer_row_count",
    f"""
    WITH {REPLICA_SQL}
    SELECT (SELECT count(*) FROM orders) AS n_table, (SELECT count(*) FROM replica) AS n_peer,
           abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM replica)) AS violations
    """,
)
def ck_peer_row_count(spark, sf_dir):
    orders = read_table(spark, "orders", directory=sf_dir)
    return peer_row_count(orders, replica_of(orders))


@query(
    "ck_peer_spot_check",
    f"""
    WITH {REPLICA_SQL},
    a AS (SELECT * FROM orders WHERE {_SAMPLED}),
    b AS (SELECT * FROM replica WHERE {_SAMPLED})
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
           CAST(a.o_orderkey IS NOT NULL AS BIGINT) AS n_table,
           CAST(b.o_orderkey IS NOT NULL AS BIGINT) AS n_peer,
           concat_ws(',',
               CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
               CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END,
               CASE WHEN a.o_orderdate IS DISTINCT FROM b.o_orderdate THEN 'o_orderdate' END
           ) AS fields_differing
    FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
       OR a.o_totalprice IS DISTINCT FROM b.o_totalprice
       OR a.o_orderdate IS DISTINCT FROM b.o_orderdate
    """,
)
def ck_peer_spot_check(spark, sf_dir):
    orders = read_table(spark, "orders", directory=sf_dir)
    return peer_spot_check(
        orders,
        replica_of(orders),
        ["o_orderkey"],
        ["o_orderstatus", "o_totalprice", "o_orderdate"],
        share=0.1,
    )


_DIFF_SQL = f"""
    WITH {REPLICA_SQL},
    missing AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM replica),
    extra AS (SELECT * FROM replica EXCEPT ALL SELECT * FROM orders)"""


@query(
    "ck_target_vs_source",
    f"""{_DIFF_SQL}
    SELECT (SELECT count(*) FROM missing) AS n_missing, (SELECT count(*) FROM extra) AS n_extra,
           (SELECT count(*) FROM missing) + (SELECT count(*) FROM extra) AS violations
    """,
)
def ck_target_vs_source(spark, sf_dir):
    orders = read_table(spark, "orders", directory=sf_dir)
    return count_row_differences(orders, replica_of(orders))


@query(
    "target_vs_source_rows",
    f"""{_DIFF_SQL}
    SELECT *, CAST(1 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra FROM missing
    UNION ALL SELECT *, 0, 1 FROM extra
    """,
)
def target_vs_source_rows(spark, sf_dir):
    orders = read_table(spark, "orders", directory=sf_dir)
    return target_vs_source(orders, replica_of(orders))


@query(
    "ck_target_vs_source_nested",
    """
    SELECT count(*) AS n_missing, count(*) AS n_extra, 2 * count(*) AS violations FROM orders WHERE o_orderstatus = 'P'
    """,
)
def ck_target_vs_source_nested(spark, sf_dir):
    """Rows that differ in nothing but the place of a NULL inside a value."""
    orders = read_table(spark, "orders", directory=sf_dir)
    gone = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    kept = F.col("o_custkey")

    def shown(a, b):
        return orders.select(
            "o_orderkey",
            F.year("o_orderdate").alias("part"),
            F.array(a, b).alias("pair"),
            F.struct(a.alias("x"), F.array(F.struct(b.alias("y"))).alias("z")).alias("deep"),
        )

    return count_row_differences(shown(gone, kept), shown(kept, gone), ["part"])
