"""Keyed writes as set operations: a new state of a table from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in the given order; the rank filter prunes on the map side too."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins per key; ``seq`` orders the writes and ties are broken by all columns, so the result is one."""
    rest = [F.col(c).asc_nulls_last() for c in sorted(rows.columns) if c not in keys and c != seq]
    return latest(rows, keys, F.col(seq).desc_nulls_last(), *rest)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, the earliest per key; null keys never match and are inserted."""
    return latest(new.join(old.select(*keys).distinct(), keys, "left_anti"), keys, F.col(seq).asc_nulls_last())


def set_flag(rows: DataFrame, group: str, is_set: Column, flag: str) -> DataFrame:
    """Clear-then-set as one recomputed column: within every group only rows that meet ``is_set`` carry the flag."""
    return rows.withColumn(flag, F.coalesce(is_set, F.lit(False)))


def overlay(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """Overrides, and the base rows that no override replaces."""
    return override.unionByName(base.join(override.select(*keys).distinct(), keys, "left_anti"))
