"""How queries are declared: a Spark plan, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.text import CJK, INVISIBLE, WS

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name; in SQL, <WS>, <CJK> and <INVISIBLE> stand for the character classes."""

        def wrap(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql.replace("<WS>", WS).replace("<CJK>", CJK).replace("<INVISIBLE>", INVISIBLE)
            return f

        return wrap
