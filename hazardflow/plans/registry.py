"""Registered queries: a Spark function and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register
