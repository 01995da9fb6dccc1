"""References to records that do not exist.

A reference is ``(table_name, load_batch, row_key, kind, ref)``; a target is
``(kind, key, load_batch)``; a purge is ``(kind, key, purged_batch)``.  The
orphan search never joins row by row: references are first added up per key
and period, hot keys are marked once and checked by a broadcast of bounded
size, the remaining keys by a shuffled anti-join, and both orphan sets are
united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import FULL_SHA, commit_key, dna_key
from ..session import Cut
from ..sources.tables import commit_rows, table
from .lookup import HOT_SHARE, resolve_short, skew_lookup

COMMIT, DNA = "commit", "dna"


def surviving_keys(targets: DataFrame, purges: DataFrame) -> DataFrame:
    """(kind, key) of targets with a row later than every purge of the key.

    A key without purge survives.  A target row without batch survives only
    where its key was never purged.  Null keys are no targets.
    """
    held = targets.where("key IS NOT NULL").groupBy("kind", "key").agg(F.max("load_batch").alias("last"))
    gone = purges.where("key IS NOT NULL").groupBy("kind", "key").agg(F.max("purged_batch").alias("purged"))
    joined = held.join(gone, ["kind", "key"], "left")
    return joined.where("purged IS NULL OR last > purged").select("kind", "key")


def mark_hot(refs: DataFrame, n_refs: int) -> DataFrame:
    """The references with ``hot``: whether their key holds more than 1/HOT_SHARE of all ``n_refs``.

    References are added up per key first; fewer than HOT_SHARE keys can be
    hot, and they reach the references by broadcast.
    """
    at = ["kind", "key"]
    counts = refs.where("key IS NOT NULL").groupBy(*at).agg(F.count(F.lit(1)).alias("_all"))
    hot = counts.where(F.col("_all") > n_refs / HOT_SHARE).select(*at, F.lit(True).alias("hot"))
    return refs.join(F.broadcast(hot), at, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def orphan_counts(marked: DataFrame, alive: DataFrame) -> DataFrame:
    """Orphaned references per table, period and key: ``n`` and ``hot``, of references that ``mark_hot`` has marked.

    References to nothing (null key) are no orphans.  Copies of a record count
    once each here; distinct records are what ``orphan_records`` gives.
    """
    at = ["kind", "key"]
    per = marked.where("key IS NOT NULL").groupBy("table_name", "load_batch", *at, "hot").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(marked.where("hot").select(*at).distinct())  # fewer than HOT_SHARE keys
    heavy = per.where("hot").join(F.broadcast(alive.join(hot, at, "left_semi")), at, "left_anti")
    light = per.where("NOT hot").join(alive, at, "left_anti")
    return light.unionByName(heavy).select("table_name", "load_batch", *at, "n", "hot")


def orphan_records(marked: DataFrame, counts: DataFrame) -> DataFrame:
    """The referring records of the orphan keys: table_name, load_batch, row_key; copies of a record once.

    Records of hot keys are taken out before the shuffle and meet their keys by
    broadcast.
    """
    at = ["kind", "key"]
    real = marked.where("key IS NOT NULL")
    light = real.where("NOT hot").join(counts.where("NOT hot").select(*at).distinct(), at, "left_semi")
    heavy = real.where("hot").join(F.broadcast(counts.where("hot").select(*at).distinct()), at, "left_semi")
    return light.unionByName(heavy).select("table_name", "load_batch", "row_key").distinct()


def history_references(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    """(references, surviving keys) of the change-history tables.

    Commit references in files.sha and commits_metadata.parent (of the Commit
    row) and identity references in symbols.dna_id and dna_decision_log.dna_id.
    An abbreviated commit reference stands for the one sha it starts; one that
    starts no sha or several keeps its short form, which no target has.
    """
    commits = table(spark, where, "commits_metadata")
    latest = commit_rows(commits, "parent")

    def refs(df: DataFrame, name: str, kind: str, key, row) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), F.col("load_batch").cast("long").alias("load_batch"), row.cast("string").alias("row_key"), F.lit(kind).alias("kind"), key.alias("ref"))

    to_commits = refs(table(spark, where, "files"), "files", COMMIT, commit_key(F.col("sha")), F.col("id")).unionByName(
        refs(latest, "commits_metadata", COMMIT, commit_key(F.col("parent")), F.col("sha"))
    )
    to_dna = [refs(table(spark, where, t), t, DNA, dna_key(F.col("dna_id")), F.col("id")) for t in ("symbols", "dna_decision_log")]
    shas = commits.select(commit_key(F.col("sha")).alias("sha")).where("sha IS NOT NULL").distinct()
    full = resolve_short(to_commits, shas)
    is_short = F.length("ref") < FULL_SHA
    short = skew_lookup(to_commits.where(is_short), "ref", full, commits.count() + table(spark, where, "files").count())
    to_commits = short.withColumn("key", F.coalesce("full", "ref")).drop("full").unionByName(to_commits.where(~is_short).withColumn("key", F.col("ref")))
    every = reduce(DataFrame.unionByName, [d.withColumn("key", F.col("ref")) for d in to_dna], to_commits).where("key IS NOT NULL")

    targets = commits.select(F.lit(COMMIT).alias("kind"), commit_key(F.col("sha")).alias("key"), "load_batch").unionByName(
        table(spark, where, "symbol_versions").select(F.lit(DNA).alias("kind"), dna_key(F.col("dna_id")).alias("key"), "load_batch")
    )
    kind = F.lower(F.btrim("key_kind"))
    purges = table(spark, where, "purged_keys").select(kind.alias("kind"), F.when(kind == DNA, dna_key(F.col("purged_key"))).otherwise(commit_key(F.col("purged_key"))).alias("key"), "purged_batch")
    return every.drop("ref"), surviving_keys(targets, purges)


def history_orphans(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    """(marked references, orphan counts) of the change-history tables.

    Each is written once in the shared folder, as both are read several times.
    """
    cut = Cut(spark, "orphans")
    refs, alive = history_references(spark, where)
    refs, counts = cut.put_counted(refs, all=F.count(F.lit(1)))
    marked, alive = cut.put(mark_hot(refs, counts["all"]))[1], cut.put(alive)[1]
    return marked, cut.put(orphan_counts(marked, alive))[1]


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return orphan_records(*history_orphans(spark, where))


def p1_orphans_per_period(spark: SparkSession, where: str) -> DataFrame:
    """Orphan keys and orphaned references (copies counted) per table and load batch."""
    counts = history_orphans(spark, where)[1]
    return counts.groupBy("table_name", "load_batch").agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("n").alias("orphan_references"))
