"""Hotspot measures of entities from their change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S

DAY_US = 86_400_000_000.0


def burstiness(events: DataFrame, entity: str, at: str, tie: str) -> DataFrame:
    """(entity, burstiness): half the coefficient of variation of the gaps between events, at most 1.

    With fewer than two events or a mean gap of 0 it is 0; the deviation is
    that of the population.
    """
    us = F.unix_micros(F.col(at))
    gap = (us - F.lag(us).over(W.partitionBy(entity).orderBy(at, tie))) / DAY_US
    gaps = events.select(entity, gap.alias("_gap"))
    return gaps.groupBy(entity).agg(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.stddev_pop("_gap"), F.avg("_gap")) / 2, F.lit(0.0))).alias("burstiness"))


def file_metrics(changes: DataFrame, entity: str, commit: str, author: str, at: str, as_of: Column, n_commits: int) -> DataFrame:
    """The five hotspot measures of each entity, each from 0 to 1."""
    per = changes.groupBy(entity).agg(F.countDistinct(commit).alias("_n"), F.count(F.lit(1)).alias("_changes"), F.countDistinct(author).alias("_authors"), F.max(at).alias("_last"))
    bursts = burstiness(changes.select(entity, commit, at).distinct(), entity, at, commit)
    one = F.lit(1.0)
    return per.join(bursts, entity).select(
        entity,
        F.least(one, F.col("_n") / max(n_commits, 1) ** 0.5).alias("frequency"),
        S.recency(F.col("_last"), as_of).alias("recency"),
        F.least(one, F.col("_authors") / 5).alias("author_diversity"),
        F.least(one, F.col("_changes") / F.col("_n") / 10).alias("intensity"),
        "burstiness",
    )


def scored(metrics: DataFrame) -> DataFrame:
    """The measures with ``score`` and ``level``."""
    score = S.hotspot(*(F.col(c) for c in ("frequency", "recency", "author_diversity", "intensity", "burstiness")))
    return metrics.withColumn("score", score).withColumn("level", S.risk_level(F.col("score")))
