"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from attestra.session import spread

Query = Callable[["Tables"], DataFrame]

VIEW_SQL: dict[str, str] = {}
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


@dataclass
class Tables:
    """The driver tables of one folder and the views over them."""

    spark: SparkSession
    folder: str
    known: dict = field(default_factory=dict)

    def _once(self, key: tuple, make):
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def __getitem__(self, name: str) -> DataFrame:
        return self._once(("table", name), lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def rows(self, name: str) -> int:
        """Row count of a table, from the file footers."""
        return self._once(("rows", name), lambda: self[name].count())

    def text(self, name: str) -> DataFrame:
        """A table whose text is worked on row by row: spread when the file is one split."""
        return self._once(("text", name), lambda: spread(self[name]))


def view(sql: str):
    """Register a view: the decorated function builds it in Spark, ``sql`` in DuckDB."""

    def wrap(build: Callable[[Tables], DataFrame]):
        VIEW_SQL[build.__name__] = sql
        return build

    return wrap


def check(sql: str | None):
    """Register a query under the function's name with its oracle SQL."""

    def wrap(query: Query):
        name = query.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return query

    return wrap


def with_views(sql: str) -> str:
    """The SQL with every view it names, and the views those name, put in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+\b", text)):
            if name in VIEW_SQL and name not in order:
                visit(VIEW_SQL[name])
                order.append(name)

    visit(sql)
    parts = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in order)
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
