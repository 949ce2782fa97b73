"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetrail.plans import albums, assignment, derivations, evaluation, export, judging, language, profiles, relations, search, sessions

MODULES = (sessions, search, albums, evaluation, relations, profiles, derivations, language, judging, assignment, export)
FLAGSHIP = "keyword_search_topk"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
