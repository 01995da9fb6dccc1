"""Relational operators beyond what one DataFrame call says."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Cut

ALL = "all"


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Conjunction of equality filters; None and "all" switch one off."""
    conditions = [F.col(c) == v for c, v in wanted.items() if v is not None and v != ALL]
    return rows.where(reduce(Column.__and__, conditions)) if conditions else rows


def search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which a column holds the text; case does not matter, ``%`` and ``_`` are wildcards."""
    return rows.where(reduce(Column.__or__, [F.col(c).ilike(f"%{text}%") for c in columns]))


def first_n(rows: DataFrame, n: int, group: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group; the order should be total, so that the result is one."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, state): added, removed, modified or unchanged by key; both sides are unique by key."""
    a = old.select(*keys, F.struct(F.col(value).alias("v")).alias("_old"))
    b = new.select(*keys, F.struct(F.col(value).alias("v")).alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old.v").eqNullSafe(F.col("_new.v")), "unchanged").otherwise("modified")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def dominant(rows: DataFrame, group: list[str], value: str, declared: list[str] | None = None) -> DataFrame:
    """Most frequent value of each group; a tie goes to the earlier in ``declared``, else to the lesser."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, declared)), F.col(value)) if declared else F.lit(0)
    rank = F.when(rank > 0, rank).otherwise(F.lit(10**6))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("k"), rank.alias("r"), F.col(value).alias("v"))).alias("b"))
    return best.select(*group, F.col("b.v").alias("dominant"), (-F.col("b.k")).alias("n"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Pairs the k-th row of each key on the left with the k-th on the right."""
    a = left.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(left_order)))
    b = right.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(right_order)))
    return a.join(b, [*keys, "_k"]).drop("_k")


def unique_names(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value) of names that stand for exactly one value."""
    return rows.groupBy(name).agg(F.min(value).alias(value), F.max(value).alias("_max")).where(F.col(value) == F.col("_max")).drop("_max")


def best_of_group(rows: DataFrame, group: str, score: str, ordinal: str, least: float) -> DataFrame:
    """The best row of each group: a single row stays whatever its score, of several the best must reach ``least``.

    Null and NaN scores lose to any number; a group without numbers keeps its
    first row by ``ordinal``; of equal scores the first wins.
    """
    real = F.when(~F.isnan(score), F.col(score))
    w = W.partitionBy(group)
    ranked = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(real.desc_nulls_last(), ordinal)))
    return ranked.where("_rn = 1").where((F.col("_n") == 1) | real.isNull() | (real >= least)).drop("_n", "_rn")


def running_share(rows: DataFrame, order: list[str], part: str, whole: str, name: str) -> DataFrame:
    """Running sum of ``part`` over running sum of ``whole`` in percent, along a total order of few rows (one per period)."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.round(100 * F.try_divide(F.sum(part).over(w), F.sum(whole).over(w)), 4))


def tree_rollup(leaves: DataFrame, path: str, score: str, added: str, removed: str) -> DataFrame:
    """Directory tree with node, depth, score = max(own, sum of children), added and removed summed, weight = max(score / greatest, 0.05).

    One aggregation per level from the deepest up; each level holds the nodes
    above the one below and is written once.  A null path is left out.
    """
    cut = Cut(leaves.sparkSession, "rollup")
    own = leaves.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("node")).agg(F.sum(score).alias("score"), F.sum(added).alias("added"), F.sum(removed).alias("removed")).withColumn("depth", F.size(F.split("node", "/")))
    own, counts = cut.put_counted(own, deepest=F.max("depth"))
    max_depth = counts["deepest"] or 1
    done = None
    level = own.where(F.col("depth") == max_depth)
    for depth in range(max_depth, 0, -1):
        done = level if done is None else done.unionByName(level)
        if depth == 1:
            break
        up = F.substring_index("node", "/", depth - 1)
        children = level.groupBy(up.alias("node")).agg(F.sum("score").alias("s"), F.sum("added").alias("a"), F.sum("removed").alias("r"))
        here = own.where(F.col("depth") == depth - 1)
        level = here.join(children, "node", "full_outer").select(
            "node", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("s", F.lit(0.0))).alias("score"), (F.coalesce("added", F.lit(0)) + F.coalesce("a", F.lit(0))).alias("added"), (F.coalesce("removed", F.lit(0)) + F.coalesce("r", F.lit(0))).alias("removed"), F.lit(depth - 1).alias("depth")
        )
        level = cut.put(level)[1]
    top = done.agg(F.max("score")).scalar()
    return done.select("node", "depth", "score", "added", "removed", F.greatest(F.try_divide(F.col("score"), top), F.lit(0.05)).alias("weight"))


def similar_names(left: DataFrame, right: DataFrame, block: list[str], left_id: str, left_name: str, right_id: str, right_name: str, least: float) -> DataFrame:
    """(left_id, right_id, score): names of one block whose normalised edit similarity reaches ``least`` (above 0, below 1).

    A name of n characters can be at most (1 - least) / least * n edits from a
    name so similar to it.  Cut into one piece more, one of its pieces occurs
    unchanged in the other (pigeonhole), so only names that share a piece meet,
    never all of a block.  Null and empty names meet nothing.
    """
    edits, longest = (1 - least) / least, math.ceil(least / (1 - least)) if least > 0.5 else 1
    name, n = F.col(right_name), F.length(right_name)
    k = F.floor(n * edits + 1e-9) + 1

    def bound(i: Column) -> Column:
        return F.floor(i * n / k).cast("int")

    pieces = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.substring(name, bound(i) + 1, bound(i + 1) - bound(i)))
    m = F.length(left_name)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.least(m, F.lit(longest))), lambda size: F.transform(F.sequence(F.lit(1), m - size + 1), lambda i: F.substring(F.col(left_name), i, size))))
    a = left.where(m > 0).select(*block, left_id, left_name, F.explode(F.array_distinct(parts)).alias("_piece"))
    b = right.where(n > 0).select(*block, right_id, right_name, F.explode(F.array_distinct(pieces)).alias("_piece"))
    met = a.join(b, [*block, "_piece"]).drop("_piece").distinct()
    top = F.greatest(F.length(left_name), F.length(right_name))
    score = F.round((top - F.levenshtein(left_name, right_name)) / top, 6)
    return met.withColumn("score", score).where(F.col("score") >= least).select(left_id, right_id, "score")


