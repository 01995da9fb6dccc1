"""Vector retrieval: exact top-k by cosine similarity.

The queries are a stated set.  They are taken in blocks of bounded size; each
partition multiplies a block with its rows by one matrix product per Arrow
batch and keeps k rows per query, so what is shuffled is k rows per query and
partition, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import first_n

#: Query vectors of one block; a worker holds one block.
BLOCK = 2048
#: Decimals that similarities are rounded to before they are ranked, so that equal vectors tie.
DECIMALS = 6


def _matrix(vectors) -> np.ndarray:
    """Vectors as unit rows; a zero vector and one of another length or with a null becomes NaN and matches nothing."""
    rows = list(vectors)
    width = max((len(v) for v in rows if v is not None), default=0)
    out = np.full((len(rows), width), np.nan)
    for i, v in enumerate(rows):
        if v is not None and len(v) == width:
            out[i] = np.asarray(v, dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def top_k(queries: DataFrame, rows: DataFrame, k: int, least: float = -1.0, exclude_self: bool = True) -> DataFrame:
    """(query_id, item_id, similarity, rank_no): the k rows most similar to each query, of at least ``least``.

    ``queries`` has query_id and vector, ``rows`` item_id and vector, both
    unique by id.  Equal similarities go by item_id.  Null, zero and odd-length
    vectors have no similarity and are left out.
    """
    spark = rows.sparkSession
    n = queries.count()
    out = None
    blocks = 1 + 2 * n // BLOCK  # twice as many as would just do, for uneven blocks
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "vector").toPandas()
        if not len(mine):
            continue
        shared = spark.sparkContext.broadcast((mine["query_id"].to_numpy(), _matrix(mine["vector"])))

        def scan(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "item_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
            for pdf in it:
                for at in range(0, len(pdf), 1000):
                    part = pdf.iloc[at : at + 1000]
                    m = _matrix(part["vector"])
                    if m.shape[1] != q.shape[1]:
                        continue
                    s = np.round(q @ m.T, DECIMALS) + 0.0
                    items = part["item_id"].to_numpy()
                    if exclude_self:
                        s[ids[:, None] == items[None, :]] = np.nan
                    s[~(s >= least)] = np.nan
                    keep = min(k, s.shape[1])
                    # the k-th best similarity of each query; ties at it all stay until the global rank
                    filled = np.where(np.isnan(s), -np.inf, s)
                    edge = -np.partition(-filled, keep - 1, axis=1)[:, keep - 1 : keep]
                    a, b = np.nonzero((filled >= edge) & (filled > -np.inf))
                    best = pd.concat([best, pd.DataFrame({"query_id": ids[a], "item_id": items[b], "similarity": s[a, b]})])
                    best = best.sort_values(["query_id", "similarity", "item_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
            yield best

        part = rows.select("item_id", "vector").where("vector IS NOT NULL").mapInPandas(scan, "query_id long, item_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, item_id long, similarity double, rank_no int")
    ranked = first_n(out, k, ["query_id"], F.col("similarity").desc(), F.col("item_id"))
    from pyspark.sql import Window as W

    return ranked.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id")))


def centroids(seeds: DataFrame, group: str) -> DataFrame:
    """(group, vector): mean vector of each group's seeds, position by position."""
    at = seeds.select(group, F.posexplode("vector").alias("i", "x"))
    mean = at.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


def rerank(hits: DataFrame, *boosts: tuple) -> DataFrame:
    """Hits with ``score`` = similarity times every boost that applies."""
    score = F.col("similarity")
    for condition, factor in boosts:
        score = score * F.when(condition, factor).otherwise(1.0)
    return hits.withColumn("score", score)
