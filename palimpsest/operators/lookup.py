"""Joins of references to a unique-key table that stay even when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import FULL_SHA

#: A key that holds more than one row in HOT_SHARE is hot; so there are fewer than HOT_SHARE hot keys at any size.
HOT_SHARE = 1000


def hot_keys(refs: DataFrame, key: str, n_rows: int) -> DataFrame:
    """The keys that hold more than 1/HOT_SHARE of n_rows; at most HOT_SHARE rows by construction."""
    counts = refs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > n_rows / HOT_SHARE).select(key)


def skew_lookup(left: DataFrame, key: str, right: DataFrame, n_rows: int) -> DataFrame:
    """Left join to a table that is unique by ``key`` (a text column of the same name on both sides).

    Hot keys meet their at most HOT_SHARE partners by broadcast; the rest is
    shuffled, where no key then holds more than 1/HOT_SHARE of the rows
    (``n_rows`` is at least the rows of ``left``).  A null key finds nothing;
    such rows are spread over the partitions by a salt.
    """
    salt = F.concat(F.lit("\0"), F.xxhash64(*left.columns).cast("string"))
    spread = left.withColumn("_lk", F.coalesce(F.col(key), salt))
    partner = right.withColumnRenamed(key, "_rk")

    def meet(rows: DataFrame, partners: DataFrame) -> DataFrame:
        return rows.join(partners, F.col("_lk") == F.col("_rk"), "left").drop("_lk", "_rk")

    hot = hot_keys(left, key, n_rows)
    marked = spread.join(F.broadcast(hot.select(F.col(key).alias("_hk"), F.lit(True).alias("_hot"))), F.col("_lk") == F.col("_hk"), "left").drop("_hk")
    few = F.broadcast(partner.join(F.broadcast(hot.withColumnRenamed(key, "_rk")), "_rk", "left_semi"))
    heavy = meet(marked.where("_hot").drop("_hot"), few)
    light = meet(marked.where("_hot IS NULL").drop("_hot"), partner)
    return light.unionByName(heavy)


def resolve_short(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """Full sha of every abbreviated reference: ``ref`` (short) -> ``full``.

    ``refs`` has ``ref`` in normal form, ``commits`` unique ``sha``.  A prefix
    of exactly one sha stands for it; of none or several it stays unresolved
    (no row).  Only shas that begin like some short reference, compared at the
    shortest length there is, are spread over the lengths that occur (at most
    39) and met by equality, so no prefix range is scanned.
    """
    short = refs.where(F.length("ref") < FULL_SHA).select("ref").distinct()
    lengths = short.agg(F.collect_set(F.length("ref")).alias("lengths"))
    lengths = sorted(n for row in lengths.collect() for n in row.lengths)  # at most 39 numbers
    if not lengths:
        return refs.sparkSession.createDataFrame([], "ref string, full string")
    begins = short.select(F.substring("ref", 1, lengths[0]).alias("_b")).distinct()
    near = commits.withColumn("_b", F.substring("sha", 1, lengths[0])).join(begins, "_b", "left_semi")
    spread = near.select("sha", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("_l"))
    spread = spread.select("sha", F.expr("substring(sha, 1, _l)").alias("ref"))
    met = short.join(spread, "ref").groupBy("ref")
    return met.agg(F.min("sha").alias("full"), F.max("sha").alias("_max")).where("full = _max").drop("_max")
