"""The domain's tables over the given data, for Spark and, as CTEs of the same meaning, for DuckDB.

The large star-schema tables stand for a big change history: an order is a
commit, a line item a symbol changed by it (part = file, supplier = symbol),
and part-supplier pairs are dependency edges.  The change-history tables are
used as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: All times of the data lie before it; every "now" is this parameter.
AS_OF = "2025-01-01 00:00:00"


class Tables:
    """Lazy access to the tables of one directory."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.where, name)

    @cached_property
    def commit(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderpriority").alias("message"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size")
        )

    @cached_property
    def change(self) -> DataFrame:
        """One row per symbol changed by a commit."""
        kind = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "removed").otherwise("modified")
        return self.lineitem.select(
            F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("symbol_id"), F.col("l_linestatus").alias("kind"), kind.alias("change_type"), F.col("l_quantity").alias("lines"), F.col("l_discount").alias("discount")
        )

    @cached_property
    def file(self) -> DataFrame:
        return self.change.select("sha", "path").distinct()

    @cached_property
    def edge(self) -> DataFrame:
        return self.change.groupBy(F.col("path").alias("src"), F.col("symbol_id").alias("dst"), F.col("kind").alias("edge_type")).agg(F.round(1 - F.max("discount"), 4).alias("confidence"))


CTE = """WITH RECURSIVE
commit AS (SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS date, o_orderpriority AS message, o_orderstatus AS status, o_totalprice AS size FROM orders),
change AS (SELECT l_orderkey AS sha, l_partkey AS path, l_suppkey AS symbol_id, l_linestatus AS kind,
  CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END AS change_type, l_quantity AS lines, l_discount AS discount FROM lineitem),
file AS (SELECT DISTINCT sha, path FROM change),
edge AS (SELECT path AS src, symbol_id AS dst, kind AS edge_type, round(1 - max(discount), 4) AS confidence FROM change GROUP BY ALL)
"""

Query = Callable[[SparkSession, str], DataFrame]


def over(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, where: build(Tables(spark, where))


def catalogue(entries: dict[str, tuple[Callable[[Tables], DataFrame], str | None]]) -> dict[str, tuple[Query, str | None]]:
    """Queries over ``Tables``, their SQL preceded by the CTEs (which may be joined by further ones with a leading comma)."""
    return {name: (over(build), sql and CTE + sql) for name, (build, sql) in entries.items()}
