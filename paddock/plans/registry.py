"""Registered queries and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if there is one."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded, as sums of floats depend on their order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, whole numbers as longs, so that results compare. As in SQL a double's millionths are rounded, not its shortest
    decimal: they differ where that ends in a 5 that the double is below."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("integer", "short", "byte", "long") else F.col(c) for c, k in kinds.items()])
