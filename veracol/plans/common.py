"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from veracol.sources.stored import scratch as scratch  # noqa: PLC0414

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalog:
    """Queries with their SQL, registered by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracle[name] = sql
            return query

        return register


class Rows:
    """A small inline table that reads alike from Spark and from SQL."""

    def __init__(self, name: str, schema: str, rows: Sequence[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, [tuple(r) for r in rows]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """`name(columns) AS (VALUES ...)`, to stand after WITH."""
        kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
        fields = [f.split() for f in self.schema.split(", ")]

        def value(v: object, kind: str) -> str:
            if v is None:
                return f"CAST(NULL AS {kinds[kind]})"
            return f"CAST('{str(v).replace(chr(39), chr(39) * 2)}' AS {kinds[kind]})"

        rows = ", ".join("(" + ", ".join(value(v, k) for v, (_, k) in zip(r, fields, strict=True)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(n for n, _ in fields)}) AS (VALUES {rows})"


def sql_list(words: Sequence[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
