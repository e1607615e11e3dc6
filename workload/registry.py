"""Registry that pairs each Spark query with its SQL counterpart over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.tables import SQL_TABLES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_tables(body: str) -> str:
    """Prefix the derived tables a statement uses (and those they use) as common table expressions."""
    body = body.strip()
    used: list[str] = []

    def visit(text: str) -> None:
        for name, sql in SQL_TABLES.items():
            if name not in used and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s+AS\b", text):
                visit(sql)
                used.append(name)

    visit(body)
    head = [f"{n} AS ({SQL_TABLES[n]})" for n in used]
    tail = body
    if re.match(r"WITH\s", body):
        tail = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body)
        return "WITH RECURSIVE " + ", ".join([*head, tail]) if head else body
    return f"WITH RECURSIVE {', '.join(head)} {tail}" if head else body


def case(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register
