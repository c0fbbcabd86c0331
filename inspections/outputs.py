"""Raw outputs of checks and setups, variables, labels, and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspections import query
from inspections.fixtures import config_docs
from tablewarden.functions import scoring
from tablewarden.functions.outputs import parse_check_outputs, parse_setup_outputs
from tablewarden.functions.variables import clean_vars, merge_vars, sorted_vars_text
from tablewarden.plans.scores import score_results
from tablewarden.schema import TABLE_CUSTOM_PREFIX, TABLE_PREFIX, VAR_PREFIX
from tablewarden.sources.config import parse_config
from tablewarden.sources.tables import read_table


def _outputs(lineitem, texts):
    """Each line's number picks the shape of the output it stands for."""
    raw = None
    for number, text in texts.items():
        case = F.col("l_linenumber") == number
        raw = F.when(case, text) if raw is None else raw.when(case, text)
    return lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        raw.alias("raw_output"),
        F.when(F.col("l_linestatus") == "F", F.lit(3)).otherwise(F.lit(0)).alias("check_rc"),
    )


@query(
    "parse_check_output",
    """
    WITH shaped AS (
        SELECT *, CASE WHEN l_linestatus = 'F' THEN 3 ELSE 0 END AS process_rc,
               l_linenumber <= 3 AND NOT (l_linenumber = 1 AND l_returnflag = 'R') AS valid
        FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, valid,
           CASE WHEN NOT valid THEN 202 WHEN l_linenumber = 3 THEN 4 ELSE process_rc END
               AS check_rc,
           CASE WHEN NOT valid THEN -1 WHEN l_linenumber = 1 THEN CAST(l_quantity AS BIGINT)
                WHEN l_linenumber = 2 THEN l_partkey ELSE 0 END AS violations,
           CASE WHEN NOT valid THEN NULL WHEN l_linenumber = 2 THEN 'incremental' ELSE 'full' END
               AS mode,
           CASE WHEN l_linenumber = 2 THEN 'part ' || l_partkey END AS log
    FROM shaped
    """,
)
def parse_check_output(spark, sf_dir):
    closing = F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.lit("}"))
    texts = {
        1: F.format_string(
            '{"rc": "0", "violations": "%d"%s', F.col("l_quantity").cast("bigint"), closing
        ),
        2: F.format_string(
            '{"rc": 0, "violations": %d, "mode": "incremental", "log": "part %d"}',
            "l_partkey",
            "l_partkey",
        ),
        3: F.lit('{"rc": "4", "violations": 0, "' + VAR_PREFIX + 'note": "x"}'),
        4: F.lit("violation_cnt: 0"),
        5: F.lit('{"rc": 0}'),
        6: F.format_string('{"violations": %d}', "l_partkey"),
        7: F.lit('{"rc": 0, "violations": 1, "foo": 2}'),
    }
    outputs = _outputs(read_table(spark, "lineitem", directory=sf_dir), texts)
    return parse_check_outputs(outputs).drop("raw_output")


@query(
    "parse_setup_output",
    """
    WITH shaped AS (
        SELECT *, CASE WHEN l_linestatus = 'F' THEN 3 ELSE 0 END AS process_rc,
               l_linenumber <= 3 AS valid
        FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, valid,
           CASE WHEN valid THEN process_rc ELSE 201 END AS check_rc,
           CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'inactive' ELSE 'active' END
               AS table_status,
           CASE WHEN l_linenumber = 2 THEN 'incremental' ELSE 'auto' END AS mode,
           CASE WHEN l_linenumber = 2 THEN l_shipdate END AS data_start_ts,
           CASE WHEN l_linenumber IN (2, 3) THEN l_shipdate + INTERVAL 1 DAY END AS data_stop_ts,
           CASE WHEN l_linenumber = 1 THEN 'PREFIXpart=' || l_partkey || ',PREFIXyear=2015'
                ELSE '' END AS custom_vars
    FROM shaped
    """.replace("PREFIX", TABLE_CUSTOM_PREFIX),
)
def parse_setup_output(spark, sf_dir):
    start = F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss")
    stop = F.date_format(F.date_add("l_shipdate", 1), "yyyyMMdd'T'HHmmssSSSSSS")
    status = F.when(F.col("l_returnflag") == "R", F.lit("inactive")).otherwise(F.lit(""))
    custom = TABLE_CUSTOM_PREFIX
    texts = {
        1: F.format_string(
            f'{{"rc": "0", "table_status": "%s", "{custom}year": 2015, "{custom}part": %d}}',
            status,
            F.col("l_partkey"),
        ),
        2: F.format_string(
            '{"rc": 0, "mode": "incremental", "data_start_ts": "%s", "data_stop_ts": "%s"}',
            start,
            stop,
        ),
        3: F.format_string('{"rc": 0, "data_stop_timestamp": "%s"}', stop),
        4: F.format_string('{"rc": 0, "data_start_ts": "%s"}', F.date_format("l_shipdate", "yyyy-MM-dd")),
        5: F.lit("{}"),
        6: F.lit(f'{{"rc": 0, "{TABLE_PREFIX}blah_foo": 1}}'),
        7: F.lit("   "),
    }
    outputs = _outputs(read_table(spark, "lineitem", directory=sf_dir), texts)
    parsed = parse_setup_outputs(outputs).drop("raw_output")
    return parsed.withColumn("custom_vars", sorted_vars_text(F.col("custom_vars")))


@query(
    "merge_vars",
    """
    SELECT o_orderkey,
           'PREFIX_checkcustom_max=' || o_custkey || ',PREFIX_table=orders,PREFIX_table_mode='
           || CASE WHEN o_orderstatus = 'P' THEN 'full' ELSE '' END
           || ',PREFIX_tablecustom_status='
           || CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS vars
    FROM orders
    """.replace("PREFIX_", VAR_PREFIX),
)
def merged_vars(spark, sf_dir):
    """Set by a setup check, then overridden by the user for some of the rows."""
    status = f"{TABLE_CUSTOM_PREFIX}status"
    from_setup = F.create_map(
        F.lit(TABLE_PREFIX),
        F.lit("orders"),
        F.lit(f"{TABLE_PREFIX}_mode"),
        F.when(F.col("o_orderstatus") == "P", F.lit("full")).when(
            F.col("o_orderstatus") == "O", F.lit(" None")
        ),
        F.lit(status),
        F.col("o_orderstatus"),
    )
    by_user = F.when(
        F.col("o_orderstatus") == "F", F.create_map(F.lit(status), F.lit("done"))
    )
    of_check = F.create_map(
        F.lit(f"{VAR_PREFIX}checkcustom_max"), F.col("o_custkey").cast("string")
    )
    merged = merge_vars(of_check, merge_vars(clean_vars(from_setup), by_user))
    return read_table(spark, "orders", directory=sf_dir).select(
        "o_orderkey", sorted_vars_text(merged).alias("vars")
    )


@query(
    "partition_value",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y%j') END
               AS partition_value,
           CASE WHEN o_orderstatus = 'O' THEN 'date_id' ELSE '' END AS partition_key,
           CASE WHEN o_orderstatus = 'O' THEN '1' ELSE '0' END AS partitioned,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts_text,
           strftime(o_orderdate, '%Y-%m') || '-01' AS month_start
    FROM orders
    """,
)
def partition_values(spark, sf_dir):
    mode = F.when(F.col("o_orderstatus") != "P", F.lit("incremental"))
    key = F.when(F.col("o_orderstatus") == "O", F.lit("date_id"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    return read_table(spark, "orders", directory=sf_dir).select(
        "o_orderkey",
        scoring.partition_value(mode, F.col("o_orderdate")).alias("partition_value"),
        scoring.partition_key_text(key).alias("partition_key"),
        scoring.partitioned_flag(key).alias("partitioned"),
        scoring.timestamp_text(F.col("o_orderdate")).alias("ts_text"),
        scoring.reformat_time(month, "yyyy-MM").alias("month_start"),
    )


@query(
    "score_results",
    """
    WITH counts AS (
        SELECT l_partkey, count(*) FILTER (WHERE l_quantity > 45) AS qty_bad,
               count(*) FILTER (WHERE l_tax > 0.07) AS tax_bad
        FROM lineitem GROUP BY l_partkey),
    checks AS (
        SELECT p.*, 'qty_ck' AS check_name, qty_bad AS v, 'rows' AS unit, 'quality' AS policy,
               CASE p_type WHEN 'ECONOMY' THEN 10 WHEN 'PROMO' THEN 50 ELSE 100 END AS weight,
               CASE WHEN p_type = 'PROMO' THEN 'full' ELSE 'incremental' END AS mode
        FROM counts JOIN part p ON l_partkey = p_partkey
        UNION ALL
        SELECT p.*, 'tax_ck', tax_bad, 'tables', 'consistency',
               CASE WHEN p_type = 'SMALL' THEN 0 ELSE 100 END, 'full'
        FROM counts JOIN part p ON l_partkey = p_partkey),
    scoped AS (
        SELECT *, CASE WHEN v = 0 THEN 0.0 WHEN unit = 'tables' THEN 100.0
                       WHEN p_size > 25 THEN CAST(v AS DOUBLE) / p_size
                       ELSE CAST(v AS DOUBLE) / p_size * 100 END AS scope
        FROM checks)
    SELECT instance_name, 'main' AS database_name, 'part_' || p_partkey AS table_name, check_name,
           v AS check_violation_cnt, policy AS check_policy_type, unit AS check_unit, mode AS check_mode,
           round(CAST(scope AS DOUBLE), 6) AS check_scope,
           CASE WHEN scope * weight / 100 = 0 THEN 0
                ELSE CAST(floor(greatest(1, least(100, scope * weight / 100))) AS INTEGER) END
               AS check_severity_score
    FROM scoped, (VALUES ('prod'), ('dev')) AS i(instance_name)
    WHERE instance_name = 'prod' OR p_size > 20
    UNION ALL
    SELECT 'dev', 'main', 'part_' || p_partkey, check_name, v, NULL, NULL, NULL, NULL, NULL
    FROM scoped WHERE p_size <= 20
    UNION ALL
    SELECT instance_name, 'main', 'part_' || l_partkey, 'row_ck', qty_bad + tax_bad, NULL, NULL, NULL, NULL, NULL
    FROM counts, (VALUES ('prod'), ('dev')) AS i(instance_name)
    """,
)
def scored_results(spark, sf_dir):
    """A part's lines are its table; the configuration knows its estimate and severities.

    Two instances have the same tables and checks; one has no configuration of small parts, and
    neither knows the third check. As many rows come out as go in.
    """
    counts = (
        read_table(spark, "lineitem", directory=sf_dir)
        .groupBy("l_partkey")
        .agg(
            F.count_if(F.col("l_quantity") > 45).alias("qty"),
            F.count_if(F.col("l_tax") > 0.07).alias("tax"),
        )
        .withColumn("row", F.col("qty") + F.col("tax"))
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(f"{c}_ck").alias("check_name"), F.col(c).alias("check_violation_cnt")
            )
            for c in ("qty", "tax", "row")
        ]
    )
    instance = F.explode(F.array(F.lit("prod"), F.lit("dev"))).alias("instance_name")
    results = counts.select(
        F.format_string("part_%d", "l_partkey").alias("table_name"), instance, pairs.alias("pairs")
    ).select("instance_name", F.lit("main").alias("database_name"), "table_name", F.inline("pairs"))
    docs = config_docs(spark, sf_dir).withColumn("database_name", F.lit("main"))
    large = config_docs(spark, sf_dir, above=20).withColumn("database_name", F.lit("main"))
    both = docs.withColumn("instance_name", F.lit("prod")).unionByName(
        large.withColumn("instance_name", F.lit("dev"))
    )
    scored = score_results(results, *parse_config(both))
    return scored.withColumn("check_scope", F.round("check_scope", 6))


@query(
    "config_scan",
    """
    SELECT instance_name, 'main' AS database_name,
           'part_' || p_partkey AS table_name, CAST(p_size AS DOUBLE) AS avg_rows,
           CASE WHEN p_size > 25 THEN 'date_id' END AS partition_key,
           CASE WHEN p_type = 'PROMO' THEN 'full' ELSE 'incremental' END AS table_mode,
           'p_partkey,p_size' AS cols, CAST(2 AS BIGINT) AS n_checks
    FROM part, (VALUES ('prod'), ('dev')) AS i(instance_name) WHERE instance_name = 'prod' OR p_size > 20
    """,
)
def config_scan(spark, sf_dir):
    from inspections.fixtures import written_lines
    from tablewarden.sources.config import read_config

    prod = written_lines(spark, config_docs(spark, sf_dir), "instance-prod_db-main_config.json")
    dev = written_lines(spark, config_docs(spark, sf_dir, above=20), "instance-dev_db-main_config.json")
    dim_table, dim_check = read_config(spark, prod, dev, one_per_line=True)
    keys = ["instance_name", "database_name", "table_name"]
    per_table = dim_check.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_checks"))
    return dim_table.join(per_table, keys).withColumn("cols", F.array_join("cols", ","))
