"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import dna_key, norm_path
from ..sources.tables import table


def best_scores(rows: DataFrame) -> DataFrame:
    """Greatest score of each (grp, item); null keys and null, NaN or infinite scores are ignored, -0.0 is 0.0.

    The maximum is taken on the map side first, so a hot group shuffles one row
    per item and partition, spread over (grp, item).
    """
    score = F.col("score").cast("double")
    real = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    value = F.when(score == 0, F.lit(0.0)).otherwise(score)
    return real.groupBy("grp", "item").agg(F.max(value).alias("score"))


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """The first n items of each grp by score descending, item ascending, with rank_no from 1.

    ``scored`` has unique (grp, item).  The rank filter is a plain row_number
    window, which the optimiser turns into a group limit before the shuffle
    (at most n rows per group and partition travel) and another one after it.
    A group with fewer items gives fewer rows; an empty table gives none.
    """
    w = W.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item").asc())
    return scored.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n).withColumn("rank_no", F.col("rank_no").cast("long"))


def symbol_scores(spark: SparkSession, where: str) -> DataFrame:
    rows = table(spark, where, "symbol_history")
    return best_scores(rows.select(norm_path(F.col("file_path")).alias("grp"), dna_key(F.col("symbol_dna_id")).alias("item"), F.col("impact_score").alias("score")))


def p2_found(spark: SparkSession, where: str) -> DataFrame:
    return top_n(symbol_scores(spark, where), 5).select(F.col("grp").alias("file_path"), "rank_no", F.col("item").alias("symbol_dna_id"))
