"""Registry of named jobs: ``(spark, sf_dir) -> DataFrame`` plus the DuckDB SQL that
computes the same result (the oracle). A job without SQL gets a rows-only check and a
pytest of its own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLE: dict[str, str] = {}

_JOB_MODULES = (
    "quarry.plans.jobs_text",
    "quarry.plans.jobs_sources",
    "quarry.plans.jobs_relational",
    "quarry.plans.jobs_functions",
    "quarry.plans.jobs_streaming",
    "quarry.plans.jobs_ml_graph",
)


def job(name: str, sql: str | None = None):
    def deco(fn: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"duplicate job {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    for m in _JOB_MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Job]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
