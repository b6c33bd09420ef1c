"""All registered jobs: key -> (spark, sf_dir) -> DataFrame, plus oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.plans.common import report_types

# (plan module, oracle module) pairs. A key of the oracle module's ``SQL`` or
# of the plan module's ``ROWS_ONLY`` is registered with the plan function of
# that name (or ``KEYS[key]`` where the plan module maps names).
_MODULES = [
    ("basketry.plans.baskets", "basketry.plans.oracle_baskets"),
    ("basketry.plans.sales", "basketry.plans.oracle_sales"),
    ("basketry.plans.stats", "basketry.plans.oracle_stats"),
    ("basketry.plans.text_jobs", "basketry.plans.oracle_text"),
    ("basketry.plans.ml_jobs", "basketry.plans.oracle_ml"),
    ("basketry.plans.operator_keys", "basketry.plans.oracle_operator_keys"),
]


def _load():
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracle: dict[str, str] = {}
    for plan_mod, sql_mod in _MODULES:
        pm = importlib.import_module(plan_mod)
        sm = importlib.import_module(sql_mod)
        sql = getattr(sm, "SQL", {})
        rows_only = getattr(pm, "ROWS_ONLY", ())
        named = getattr(pm, "KEYS", {})
        for key in list(sql) + list(rows_only):
            fn = named.get(key) or getattr(pm, key)
            queries[key] = (lambda f: (lambda spark, sf_dir: report_types(f(spark, sf_dir))))(fn)
        for key, text in sql.items():
            oracle[key] = " ".join(text.split())
    return queries, oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _load()[0]


def oracle_sql() -> dict[str, str]:
    return _load()[1]
