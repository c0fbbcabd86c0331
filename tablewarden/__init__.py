"""Data-quality inspection of large tables, written as Spark DataFrame jobs.

Sub-packages
------------
sources    registries, instance configurations, results history, inspected tables
functions  column-level helpers: validators, output parsing, variables, scoring
operators  the checks themselves (row, key, consistency, statistics, policy)
plans      what is built from them: registry rules, a check run, history roll-ups
streaming  the incremental window carried from one run to the next
"""

from tablewarden.plans.runner import run_and_store, run_checks
from tablewarden.schema import RESULT_SCHEMA

__all__ = ["RESULT_SCHEMA", "run_and_store", "run_checks"]
