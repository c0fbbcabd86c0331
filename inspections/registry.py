"""Registry documents: scan, defaults, filter, validation, status, bypass."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspections import query
from inspections.fixtures import REGISTRY_SQL, registry_docs, written_lines
from tablewarden.functions.scoring import effective_mode
from tablewarden.functions.variables import sorted_vars_text
from tablewarden.operators.catalogue import BUILT_IN
from tablewarden.plans import registry as plan
from tablewarden.schema import REGISTRY_FIELDS
from tablewarden.sources.registry import parse_registry, read_registry

FIELDS = ["table_name", "check_alias", *REGISTRY_FIELDS]
FIELDS_SQL = ", ".join(FIELDS)

DEFAULTED_SQL = f"""{REGISTRY_SQL},
    typed AS (SELECT * REPLACE (coalesce(check_type, 'rule') AS check_type) FROM reg),
    defaulted AS (
        SELECT * REPLACE (
            CASE WHEN check_type = 'rule' THEN coalesce(check_mode, 'full') ELSE check_mode END
                AS check_mode,
            CASE WHEN check_type = 'rule' THEN coalesce(check_scope, 'row') ELSE check_scope END
                AS check_scope,
            coalesce(check_status, 'active') AS check_status)
        FROM typed)"""


def _registry(spark, sf_dir):
    return parse_registry(registry_docs(spark, sf_dir))


def _defaulted(spark, sf_dir):
    return plan.default_registry(_registry(spark, sf_dir))


@query(
    "registry_scan",
    f"WITH {REGISTRY_SQL} SELECT {FIELDS_SQL}, given_fields, custom_vars FROM reg",
)
def registry_scan(spark, sf_dir):
    """Written as files, one document a line, and read back through the source."""
    path = written_lines(spark, registry_docs(spark, sf_dir))
    given = F.filter("given", lambda k: k.isin(REGISTRY_FIELDS))
    return read_registry(spark, path, one_per_line=True).select(
        *FIELDS,
        F.array_join(F.array_sort(given), ",").alias("given_fields"),
        sorted_vars_text(F.col("custom")).alias("custom_vars"),
    )


@query("registry_default", f"WITH {DEFAULTED_SQL} SELECT {FIELDS_SQL} FROM defaulted")
def registry_default(spark, sf_dir):
    return _defaulted(spark, sf_dir).select(*FIELDS)


@query(
    "registry_filter",
    f"WITH {REGISTRY_SQL} SELECT {FIELDS_SQL} FROM reg WHERE check_alias = 'size_ck'",
)
def registry_filter(spark, sf_dir):
    return plan.filter_registry(_registry(spark, sf_dir), check="size_ck").select(*FIELDS)


@query(
    "registry_validate",
    f"""
    WITH {DEFAULTED_SQL}
    SELECT table_name, check_alias,
           CASE k WHEN 'fullish' THEN 'check_mode' WHEN 'setup' THEN 'check_scope'
                  WHEN 'profile' THEN 'check_mode,check_scope' ELSE 'custom' END AS problems
    FROM defaulted JOIN cases ON table_name = 'part_' || p_partkey
    WHERE check_alias = 'size_ck' AND k <> 'bare'
    """,
)
def registry_validate(spark, sf_dir):
    return plan.registry_problems(_defaulted(spark, sf_dir)).select(
        "table_name", "check_alias", F.array_join("problems", ",").alias("problems")
    )


@query(
    "inactive_rows",
    f"""
    WITH {DEFAULTED_SQL}
    SELECT table_name, check_alias, check_status, -1 AS check_rc, CAST(-1 AS BIGINT) AS violations, 'full' AS mode
    FROM defaulted WHERE check_status = 'inactive' AND check_type <> 'setup'
    UNION ALL
    SELECT table_name, check_alias, check_status, 0, p_size, check_mode
    FROM defaulted JOIN part ON table_name = 'part_' || p_partkey
    WHERE check_status = 'active' AND check_type <> 'setup'
    """,
)
def inactive_rows(spark, sf_dir):
    """Placeholders joined with the rows of the checks that ran (they found the part's size)."""
    from tablewarden.sources.tables import read_table

    registry = _defaulted(spark, sf_dir).where(F.col("check_type") != "setup")
    part = read_table(spark, "part", directory=sf_dir).select(
        F.format_string("part_%d", "p_partkey").alias("table_name"),
        F.col("p_size").cast("bigint").alias("violations"),
    )
    executed = (
        plan.active_checks(registry)
        .join(part, "table_name")
        .select(
            "table_name",
            "check_alias",
            "check_status",
            F.lit(0).alias("check_rc"),
            "violations",
            F.col("check_mode").alias("mode"),
        )
    )
    return executed.unionByName(plan.inactive_rows(registry).select(*executed.columns))


@query(
    "unknown_checks",
    f"""
    WITH {REGISTRY_SQL}
    SELECT table_name, check_alias, check_name FROM reg WHERE check_name = 'price_rule'
    """,
)
def unknown_checks(spark, sf_dir):
    return plan.unknown_checks(_registry(spark, sf_dir), BUILT_IN.checks).select(
        "table_name", "check_alias", "check_name"
    )


@query(
    "table_bypass",
    f"""
    WITH {DEFAULTED_SQL}
    SELECT table_name, check_alias FROM defaulted JOIN part ON table_name = 'part_' || p_partkey
    WHERE check_type NOT IN ('setup', 'teardown') AND p_brand NOT IN ('Brand#1', 'Brand#2')
    """,
)
def table_bypass(spark, sf_dir):
    """The setup of each part's table reports two brands as inactive."""
    from tablewarden.functions.outputs import parse_setup_outputs
    from tablewarden.sources.tables import read_table

    off = F.col("p_brand").isin("Brand#1", "Brand#2")
    status = F.when(off, F.lit("inactive")).otherwise(F.lit(""))
    outputs = read_table(spark, "part", directory=sf_dir).select(
        F.format_string("part_%d", "p_partkey").alias("table_name"),
        F.format_string('{"rc": 0, "table_status": "%s"}', status).alias("raw_output"),
        F.lit(0).alias("check_rc"),
    )
    return plan.bypass_tables(_defaulted(spark, sf_dir), parse_setup_outputs(outputs)).select(
        "table_name", "check_alias"
    )


@query(
    "effective_mode",
    f"""
    WITH {DEFAULTED_SQL}
    SELECT table_name, check_alias,
           CASE WHEN check_mode = 'incremental' AND p_type <> 'PROMO' THEN 'incremental'
                ELSE 'full' END AS mode
    FROM defaulted JOIN part ON table_name = 'part_' || p_partkey
    """,
)
def effective_modes(spark, sf_dir):
    from inspections.fixtures import config_docs
    from tablewarden.sources.config import parse_config

    dim_table, _ = parse_config(config_docs(spark, sf_dir))
    return (
        _defaulted(spark, sf_dir)
        .join(dim_table, "table_name")
        .select(
            "table_name",
            "check_alias",
            effective_mode(F.col("table_mode"), F.col("check_mode")).alias("mode"),
        )
    )
