"""Row checks: required, case, range, length, type, unknown, enumeration, order, format."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspections import query, violations_sql
from tablewarden.operators import row_checks as rc
from tablewarden.operators.fused import count_by_partition, count_violations
from tablewarden.operators.key_checks import ordered_pair_violations
from tablewarden.sources.tables import read_table
from tablewarden.streaming.incremental import in_window

TODAY = dt.datetime(2001, 8, 1)
WINDOW = (dt.datetime(2001, 1, 1), dt.datetime(2001, 7, 1))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query(
    "ck_not_null",
    violations_sql(
        ("returnflag", "lineitem", "nullif(l_returnflag, 'N') IS NULL"),
        (
            "both_flags",
            "lineitem",
            "nullif(l_returnflag, 'N') IS NULL OR nullif(l_linestatus, 'O') IS NULL",
        ),
        ("shipdate", "lineitem", "l_shipdate IS NULL"),
        ("status", "orders", "nullif(o_orderstatus, 'P') IS NULL"),
    ),
)
def ck_not_null(spark, sf_dir):
    lineitem = read_table(spark, "lineitem", directory=sf_dir)
    orders = read_table(spark, "orders", directory=sf_dir)
    flag = F.nullif(F.col("l_returnflag"), F.lit("N"))
    status = F.nullif(F.col("l_linestatus"), F.lit("O"))
    return _all(
        count_violations(
            lineitem,
            {
                "returnflag": rc.missing(flag),
                "both_flags": rc.missing(flag, status),
                "shipdate": rc.missing("l_shipdate"),
            },
        ),
        count_violations(
            orders, {"status": rc.missing(F.nullif(F.col("o_orderstatus"), F.lit("P")))}
        ),
    )


@query(
    "ck_case",
    violations_sql(
        ("source_upper", "documents", "source <> upper(source)"),
        ("lang_lower", "documents", "lang <> lower(lang)"),
        ("brand_upper", "part", "p_brand <> upper(p_brand)"),
        ("type_upper", "part", "p_type <> upper(p_type)"),
    ),
)
def ck_case(spark, sf_dir):
    return _all(
        count_violations(
            read_table(spark, "documents", directory=sf_dir),
            {
                "source_upper": rc.wrong_case("source", "upper"),
                "lang_lower": rc.wrong_case("lang", "lower"),
            },
        ),
        count_violations(
            read_table(spark, "part", directory=sf_dir),
            {
                "brand_upper": rc.wrong_case("p_brand", "upper"),
                "type_upper": rc.wrong_case("p_type", "upper"),
            },
        ),
    )


@query(
    "ck_range",
    violations_sql(
        ("totalprice", "orders", "NOT o_totalprice BETWEEN 5000 AND 450000"),
        ("acctbal", "customer", "c_acctbal < 0"),
        ("quantity", "lineitem", "l_quantity > 45"),
        ("tax", "lineitem", "NOT l_tax BETWEEN 0.01 AND 0.07"),
    ),
)
def ck_range(spark, sf_dir):
    return _all(
        count_violations(
            read_table(spark, "orders", directory=sf_dir),
            {"totalprice": rc.out_of_range("o_totalprice", 5000, 450000)},
        ),
        count_violations(
            read_table(spark, "customer", directory=sf_dir),
            {"acctbal": rc.out_of_range("c_acctbal", low=0)},
        ),
        count_violations(
            read_table(spark, "lineitem", directory=sf_dir),
            {
                "quantity": rc.out_of_range("l_quantity", high=45),
                "tax": rc.out_of_range("l_tax", 0.01, 0.07),
            },
        ),
    )


@query(
    "ck_length",
    violations_sql(
        ("text", "documents", "NOT length(text) BETWEEN 20 AND 5000"),
        ("source", "documents", "NOT length(source) BETWEEN 5 AND 5"),
        ("turn_text", "conversations", "NOT length(text) BETWEEN 20 AND 400"),
    ),
)
def ck_length(spark, sf_dir):
    return _all(
        count_violations(
            read_table(spark, "documents", directory=sf_dir),
            {
                "text": rc.wrong_length("text", 20, 5000),
                "source": rc.wrong_length("source", 5, 5),
            },
        ),
        count_violations(
            read_table(spark, "conversations", directory=sf_dir),
            {"turn_text": rc.wrong_length("text", 20, 400)},
        ),
    )


_RANK = "regexp_replace(o_orderpriority, '^([1-3])-.*', '\\1')"


@query(
    "ck_type",
    violations_sql(
        ("rank_integer", "orders", f"try_cast({_RANK} AS BIGINT) IS NULL"),
        ("day_date", "orders", "try_cast(strftime(o_orderdate, '%Y-02-%d') AS DATE) IS NULL"),
    ),
)
def ck_type(spark, sf_dir):
    rank = F.regexp_replace("o_orderpriority", "^([1-3])-.*", "$1")
    february = F.date_format("o_orderdate", "yyyy-'02'-dd")
    return count_violations(
        read_table(spark, "orders", directory=sf_dir),
        {
            "rank_integer": rc.wrong_type(rank, "bigint"),
            "day_date": rc.wrong_type(february, "date"),
        },
    )


@query(
    "ck_unknown",
    violations_sql(
        ("priority", "orders", "lower(trim(o_orderpriority)) IN ('4-not specified')"),
        ("type", "part", "lower(trim(p_type)) IN ('economy', 'promo')"),
    ),
)
def ck_unknown(spark, sf_dir):
    return _all(
        count_violations(
            read_table(spark, "orders", directory=sf_dir),
            {"priority": rc.is_unknown("o_orderpriority", ["4-NOT SPECIFIED"])},
        ),
        count_violations(
            read_table(spark, "part", directory=sf_dir),
            {"type": rc.is_unknown("p_type", ["economy", "promo"])},
        ),
    )


@query(
    "ck_enum",
    violations_sql(
        ("status", "orders", "o_orderstatus NOT IN ('O', 'F')"),
        ("segment", "customer", "c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')"),
        ("event_type", "events", "event_type NOT IN ('view', 'click', 'purchase')"),
        ("quality", "labels", "quality NOT IN (1)"),
    ),
)
def ck_enum(spark, sf_dir):
    cases = [
        ("orders", "status", rc.not_in_set("o_orderstatus", ["O", "F"])),
        ("customer", "segment", rc.not_in_set("c_mktsegment", ["MACHINERY", "HOUSEHOLD"])),
        ("events", "event_type", rc.not_in_set("event_type", ["view", "click", "purchase"])),
        ("labels", "quality", rc.not_in_set("quality", [1])),
    ]
    return _all(
        *[count_violations(read_table(spark, t, directory=sf_dir), {a: bad}) for t, a, bad in cases]
    )


@query(
    "ck_ordered_pair",
    """
    SELECT 'discount_below_tax' AS check_alias,
           count(*) FILTER (WHERE NOT l_discount < l_tax) AS violations
    FROM lineitem
    UNION ALL
    SELECT 'ordered_before_shipped', count(*) FILTER (WHERE NOT o_orderdate <= l_shipdate)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def ck_ordered_pair(spark, sf_dir):
    lineitem = read_table(spark, "lineitem", directory=sf_dir)
    orders = read_table(spark, "orders", directory=sf_dir)
    across = ordered_pair_violations(
        orders, lineitem, ("o_orderkey", "l_orderkey"), "o_orderdate", "l_shipdate", strict=False
    )
    return _all(
        count_violations(lineitem, {"discount_below_tax": rc.out_of_order("l_discount", "l_tax")}),
        across.select(F.lit("ordered_before_shipped").alias("check_alias"), "violations"),
    )


@query(
    "ck_format",
    violations_sql(
        ("priority", "orders", "NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+$')"),
        ("url", "pages", "NOT regexp_matches(url, '^https://[a-z.]+/[a-z]{2}/[0-9]+$')"),
        ("props", "events", "NOT regexp_matches(props, '\"k\": [0-4]?[0-9]\\}')"),
    ),
)
def ck_format(spark, sf_dir):
    cases = [
        ("orders", "priority", rc.bad_format("o_orderpriority", "^[1-5]-[A-Z]+$")),
        ("pages", "url", rc.bad_format("url", "^https://[a-z.]+/[a-z]{2}/[0-9]+$")),
        ("events", "props", rc.bad_format("props", r'"k": [0-4]?[0-9]\}')),
    ]
    return _all(
        *[count_violations(read_table(spark, t, directory=sf_dir), {a: bad}) for t, a, bad in cases]
    )


# Texts of four shapes, chosen by status; 'P' puts the day of the month into the
# month's place, which is a date only up to the twelfth.
_ISO_TEXT = """CASE o_orderstatus
    WHEN 'F' THEN strftime(o_orderdate, '%Y%m%dT%H%M%S')
    WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f')
    ELSE strftime(o_orderdate, '%Y%d%mT%H%M%S') END"""


@query(
    "ck_iso8601",
    f"""
    WITH texts AS (SELECT {_ISO_TEXT} AS t FROM orders),
    valid AS (
        SELECT length(t) = 15 AND try_strptime(t, '%Y%m%dT%H%M%S') IS NOT NULL AS basic,
               length(t) = 26 AND try_strptime(t, '%Y-%m-%dT%H:%M:%S.%f') IS NOT NULL AS ext
        FROM texts)
    SELECT 'basic' AS check_alias, count(*) FILTER (WHERE NOT basic) AS violations FROM valid
    UNION ALL SELECT 'ext', count(*) FILTER (WHERE NOT ext) FROM valid
    UNION ALL SELECT 'any', count(*) FILTER (WHERE NOT (basic OR ext)) FROM valid
    """,
)
def ck_iso8601(spark, sf_dir):
    orders = read_table(spark, "orders", directory=sf_dir)
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyyMMdd'T'HHmmss"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.date_format(day, "yyyyddMM'T'HHmmss"))
    )
    return count_violations(
        orders.select(text.alias("t")),
        {kind: rc.not_iso8601("t", kind) for kind in ("basic", "ext", "any")},
    )


@query(
    "ck_numeric",
    """
    SELECT 'rank' AS check_alias, 0 AS violations FROM orders HAVING count(*) >= 0
    UNION ALL SELECT 'priority', count(*) FILTER (WHERE o_orderpriority SIMILAR TO '.*[A-Z].*')
    FROM orders
    UNION ALL SELECT 'padded_key', 0 FROM orders HAVING count(*) >= 0
    UNION ALL SELECT 'price_text', count(*) FROM orders
    UNION ALL SELECT 'price', 0 FROM orders HAVING count(*) >= 0
    UNION ALL SELECT 'status_or_key', count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders
    """,
)
def ck_numeric(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    failed = F.col("o_orderstatus") == "F"
    return count_violations(
        read_table(spark, "orders", directory=sf_dir),
        {
            "rank": rc.not_numeric(F.substring("o_orderpriority", 1, 1)),
            "priority": rc.not_numeric("o_orderpriority"),
            "padded_key": rc.not_numeric(F.concat(F.lit("  "), key, F.lit(" "))),
            "price_text": rc.not_numeric(F.format_string("%.2f", "o_totalprice")),
            "price": rc.not_numeric("o_totalprice"),
            "status_or_key": rc.not_numeric(F.when(failed, F.col("o_orderstatus")).otherwise(key)),
        },
    )


@query(
    "ck_retention",
    violations_sql(
        ("one_year", "orders", "o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 365 DAY"),
        ("five_years", "orders", "o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 1826 DAY"),
    ),
)
def ck_retention(spark, sf_dir):
    return count_violations(
        read_table(spark, "orders", directory=sf_dir),
        {
            "one_year": rc.too_old("o_orderdate", TODAY, 365),
            "five_years": rc.too_old("o_orderdate", TODAY, 1826),
        },
    )


@query(
    "ck_incremental",
    violations_sql(
        (
            "totalprice",
            "orders",
            "o_orderdate > '2001-01-01' AND o_orderdate <= '2001-07-01' AND o_totalprice > 450000",
        ),
        (
            "status",
            "orders",
            "o_orderdate > '2001-01-01' AND o_orderdate <= '2001-07-01' "
            "AND o_orderstatus NOT IN ('O', 'F')",
        ),
        ("not_empty", "(SELECT 1) AS one", "false"),
    ),
)
def ck_incremental(spark, sf_dir):
    from tablewarden.operators.fused import empty_table

    orders = read_table(spark, "orders", directory=sf_dir).where(in_window("o_orderdate", *WINDOW))
    return count_violations(
        orders,
        {
            "totalprice": rc.out_of_range("o_totalprice", high=450000),
            "status": rc.not_in_set("o_orderstatus", ["O", "F"]),
        },
        {"not_empty": empty_table()},
    )


@query(
    "ck_by_partition",
    """
    WITH parts AS (
        SELECT strftime(l_shipdate, '%Y%j') AS partition_value,
               count(*) FILTER (WHERE l_quantity > 45) AS q,
               count(*) FILTER (WHERE l_tax > 0.07) AS t
        FROM lineitem GROUP BY 1)
    SELECT partition_value, 'quantity' AS check_alias, q AS violations FROM parts
    UNION ALL SELECT partition_value, 'tax', t FROM parts
    """,
)
def ck_by_partition(spark, sf_dir):
    return count_by_partition(
        read_table(spark, "lineitem", directory=sf_dir),
        F.date_format("l_shipdate", "yyyyDDD"),
        {
            "quantity": rc.out_of_range("l_quantity", high=45),
            "tax": rc.out_of_range("l_tax", high=0.07),
        },
    )
