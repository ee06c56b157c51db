"""One entry per operator: a Spark query over the test tables and, where SQL
can say the same, the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Registry:
    spark: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def keep(function):
            if name in self.spark:
                raise ValueError(f"two queries named {name}")
            self.spark[name] = function
            if sql is not None:
                self.sql[name] = sql.strip()
            return function

        return keep


def all_queries() -> Registry:
    from queries import cascade, catalog, config, diff, files, graph, lines, scan, tables

    whole = Registry()
    for module in (diff, tables, graph, cascade, scan, catalog, config, lines, files):
        for name, function in module.registry.spark.items():
            whole.add(name, module.registry.sql.get(name))(function)
    return whole
