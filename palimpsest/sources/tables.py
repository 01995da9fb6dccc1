"""Table access.  Parquet scans stay lazy, so pruning and pushdown reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import commit_key


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def commit_rows(commits: DataFrame, *columns: str) -> DataFrame:
    """The Commit row of every sha: the row of the highest load_batch.

    Returns ``sha`` (normal form), ``load_batch`` and the asked columns.  Rows
    equal in sha and batch are copies, of which one stays.  A row whose sha is
    null, blank or all zeros names no commit and is left out.  The rank filter
    becomes a group limit before the shuffle, so a sha that was delivered very
    often is pruned on the map side.
    """
    rows = commits.select(commit_key(F.col("sha")).alias("sha"), "load_batch", *columns).where("sha IS NOT NULL")
    order = [F.col("load_batch").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in columns)]
    w = W.partitionBy("sha").orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
