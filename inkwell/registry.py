"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

FLAGSHIP = "bm25_topk"
_FOUND: dict = {}
_SQL: dict[str, str] = {}
#: Modules whose functions are queries.
MODULES = ("retrieval", "evaluation", "documents", "grouping", "governance", "conversations", "streams", "files", "upkeep", "comparisons", "accounts", "pages")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with DuckDB SQL for the same rows where SQL can say it."""

    def add(f):
        def run(spark, sf_dir):
            """Whole numbers of any width come out as long."""
            df = f(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind in ("tinyint", "smallint", "int") else F.col(f"`{c}`") for c, kind in df.dtypes])

        _FOUND[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"inkwell.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_FOUND)


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
