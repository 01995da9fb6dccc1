"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer.  The total is divided into equal-token
blocks, which Sainte-Lague's highest quotients allocate to the sources and,
within a source, to its shards, giving each shard an integer quota.  A shard
lines its documents up in a seeded order, so block k is the documents that
start in the k-th stretch of that line; the quota takes the first blocks, going
round the line again for repeats.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import norm_source
from ..session import Cut
from ..sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that this vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks that the shard with the least room is divided into, where no block size is given.
LEAST_BLOCKS = 200
#: Documents of one shard, about; and the most shards of a source, so that the quotas (sources x shards) stay small.
#: Larger shards are lined up in segments of about SHARD_DOCS documents each.
SHARD_DOCS, MAX_SHARDS = 50_000, 4096


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """documents (doc_id, source, text) as (doc_id, source, tokens); a null text has 0 tokens, a null id is left out."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path, pattern)
        for pdf in it:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": sizes})

    return documents.select("doc_id", "source", "text").where("doc_id IS NOT NULL").mapInPandas(count, "doc_id long, source string, tokens long")


def apportion(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none beyond its cap; ties go to the earlier.

    A common divisor gives nearly all seats at once; the rest goes one by one.
    """
    seats = min(seats, sum(c for w, c in zip(weights, caps) if w > 0))

    def at(divisor: float) -> list[int]:
        return [min(c, int(w / divisor + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps)]

    got = [0] * len(weights)
    if seats > 0:
        low, high = 0.0, 4.0 * max(weights)
        for _ in range(200):
            mid = (low + high) / 2
            if sum(at(mid)) > seats:
                low = mid
            else:
                high = mid
        got = at(high)
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if w > 0 and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def mix(sized: DataFrame, targets: list[tuple[str, float, int]], total_tokens: int | None = None, block_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents in the mixture, copies from 1 to the source's cap.

    ``sized`` has doc_id (unique), source (normal form) and tokens, and is read
    twice, so it should be a written table.  Without ``total_tokens`` the
    mixture is the largest in which every source that has documents reaches its
    share (shares of absent sources are spread over the others).  With a larger
    total, a source that is used up leaves its blocks to the others.  Shards are
    never small beside a block, as flooring them to whole blocks would lose their
    documents: without ``block_tokens`` the least shard sets it, with it the
    number of shards follows.  A null size is 0, a null id is left out. Sources
    without target, with a share or cap of 0 or without tokens are left out.
    """
    spark = sized.sparkSession
    rules = {s: (share, cap) for s, share, cap in targets if s and share and share > 0 and cap and cap > 0}
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long, copies long")
    if not rules:
        return empty
    listed = spark.createDataFrame([(x,) for x in rules], "source string")
    docs = sized.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens")).where("doc_id IS NOT NULL").join(listed, "source", "left_semi")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")).collect()
    if not counts:
        return empty

    def n_shards(r) -> int:
        most = min(MAX_SHARDS, 1 + r.docs // SHARD_DOCS)
        return most if block_tokens is None else max(1, min(most, rules[r.source][1] * r.tokens // (LEAST_BLOCKS * block_tokens)))

    plan = [(r.source, n_shards(r), 1 + r.docs // (SHARD_DOCS * n_shards(r))) for r in counts]
    placed = docs.join(spark.createDataFrame(plan, "source string, _shards int, _segments int"), "source")
    # the line of a shard goes by a hash; its segments are ranges of the hash
    at = F.xxhash64(F.lit(seed + 1), "doc_id")
    segment = F.floor((F.shiftright(at, 40) + (1 << 23)) * F.col("_segments") / (1 << 24)).cast("int")
    placed = placed.select("doc_id", "source", "tokens", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("_shards")).cast("int").alias("shard"), segment.alias("segment"), at.alias("_at"))
    sums = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").orderBy("source", "shard").collect()  # at most MAX_SHARDS numbers a listed source
    held: dict[str, list[tuple[int, int]]] = {}
    for r in sums:
        held.setdefault(r.source, []).append((r.shard, r.tokens))
    names = sorted(held)
    if not names:
        return empty
    whole = sum(rules[s][0] for s in names)
    shares = [rules[s][0] / whole for s in names]
    if block_tokens is None:
        block_tokens = max(1, min(rules[s][1] * t for s in names for _, t in held[s]) // LEAST_BLOCKS)
    room = [[rules[s][1] * t // block_tokens for _, t in held[s]] for s in names]
    caps = [sum(x) for x in room]
    if total_tokens is None:
        seats = int(min(c / w for c, w in zip(caps, shares)))
    else:
        seats = total_tokens // block_tokens
    quotas = []
    for s, seat, here in zip(names, apportion(shares, seats, caps), room):
        for (shard, tokens), q in zip(held[s], apportion([float(t) for _, t in held[s]], seat, here)):
            quotas.append((s, shard, q * block_tokens, tokens, rules[s][1]))
    quota = F.broadcast(spark.createDataFrame(quotas, "source string, shard int, budget long, there long, cap int"))
    line = ["source", "shard", "segment"]
    w = W.partitionBy(*line).orderBy("_at", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("source", "shard").orderBy("segment").rowsBetween(W.unboundedPreceding, 0)  # a row per segment
    offsets = placed.groupBy(*line).agg(F.sum("tokens").alias("_sum")).select(*line, (F.sum("_sum").over(ahead) - F.col("_sum")).alias("_ahead"))
    begun = placed.withColumn("_in", F.sum("tokens").over(w) - F.col("tokens")).join(offsets, line).withColumn("_before", F.col("_in") + F.col("_ahead"))
    copies = F.least(F.ceil((F.col("budget") - F.col("_before")) / F.col("there")), F.col("cap")).cast("long")
    return begun.join(quota, ["source", "shard"]).withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def corpus_mixture(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame, list[tuple[str, float, int]]]:
    docs = table(spark, where, "documents").select("doc_id", norm_source(F.col("source")).alias("source"), "text")
    sized = Cut(spark, "mixing").put(count_tokens(docs))[1]
    rules = table(spark, where, "mix_targets").groupBy(norm_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    rules = rules.where("source IS NOT NULL").collect()  # the list of targets
    targets = [(r.source, r.share, r.cap) for r in rules]
    return mix(sized, targets), sized, targets


def p8_mixture(spark: SparkSession, where: str) -> DataFrame:
    return corpus_mixture(spark, where)[0]


def p8_shares(spark: SparkSession, where: str) -> DataFrame:
    """Per listed source its target, what was there, what was taken, and the share reached."""
    mixture, sized, targets = corpus_mixture(spark, where)
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    there = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    taken = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies"))
    out = F.broadcast(wanted).join(there, "source", "left").join(taken, "source", "left").na.fill(0)
    return out.withColumn("actual_share", F.round(F.try_divide("taken_tokens", F.sum("taken_tokens").over(W.partitionBy())), 6))
