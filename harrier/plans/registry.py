"""Named queries with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harrier.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            key = name or query.__name__
            if key in self.queries:
                raise ValueError(f"two queries named {key}")
            self.queries[key] = query
            if sql is not None:
                self.sql[key] = sql
            return query

        return add

    def both(self, name: str, sql: str, duck: str | None = None) -> None:
        """A query that Spark and DuckDB read alike; ``duck`` where the dialects differ. Tables stand after FROM or JOIN."""
        used = {*re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)} & {*TABLES}
        text = re.sub(r"\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

        run.__name__ = name
        self(duck or sql)(run)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
