"""Schemas, domains and fixed values shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# Names and codes that users' registries, checks and stored histories contain.
# They have to stay exactly as they are for existing inputs to be understood.
VAR_PREFIX = "hapinsp_"
TABLE_PREFIX = "hapinsp_table"
TABLE_CUSTOM_PREFIX = "hapinsp_tablecustom_"
CHECK_CUSTOM_PREFIX = "hapinsp_checkcustom_"
PRIOR_SUFFIX = "_prior"

CHECK_OUTPUT_KEYS = ["rc", "violations", "mode", "log"]
SETUP_OUTPUT_KEYS = ["rc", "table_status", "mode", "log", "data_start_ts", "data_stop_ts"]
SETUP_DEPRECATED_KEYS = ["data_start_timestamp", "data_stop_timestamp"]

RC_BAD_SETUP_OUTPUT = 201
RC_BAD_CHECK_OUTPUT = 202
NO_COUNT = -1

REGULAR_TYPES = ["rule", "profile"]
STAGE_TYPES = ["setup", "teardown"]
CHECK_TYPES = REGULAR_TYPES + STAGE_TYPES
REGISTRY_MODES = ["full", "incremental"]
REGISTRY_SCOPES = ["row", "table", "database"]
STATUSES = ["active", "inactive"]
RESULT_MODES = ["full", "incremental", "auto"]
POLICY_TYPES = ["quality", "consistency", "data-management"]
UNITS = ["rows", "tables"]
SEVERITY_WEIGHTS = {"low": 10, "medium": 50, "high": 100}

LEVELS = ["instance_name", "database_name", "table_name", "check_name"]
VARS = T.MapType(T.StringType(), T.StringType())

#: One row per executed check and run.
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("instance_name", T.StringType()),
        T.StructField("database_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("check_name", T.StringType()),
        T.StructField("check_type", T.StringType()),
        T.StructField("check_policy_type", T.StringType()),
        T.StructField("check_mode", T.StringType()),
        T.StructField("check_unit", T.StringType()),
        T.StructField("check_status", T.StringType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("run_start_timestamp", T.TimestampNTZType()),
        T.StructField("run_stop_timestamp", T.TimestampNTZType()),
        T.StructField("data_start_timestamp", T.TimestampNTZType()),
        T.StructField("data_stop_timestamp", T.TimestampNTZType()),
        T.StructField("check_rc", T.IntegerType()),
        T.StructField("check_scope", T.DoubleType()),
        T.StructField("check_severity_score", T.IntegerType()),
        T.StructField("check_violation_cnt", T.LongType()),
        T.StructField("env_vars", VARS),
    ]
)

#: A result is identified by its place in the hierarchy and the run it belongs to.
RESULT_KEY = LEVELS + ["run_id"]

#: Registry fields with a meaning of their own; everything else is a custom variable.
REGISTRY_FIELDS = ["check_type", "check_name", "check_mode", "check_scope", "check_status"]
REGISTRY_JSON = "map<string,map<string,map<string,string>>>"
# --- End of fixed values ----------------------------------------------------
