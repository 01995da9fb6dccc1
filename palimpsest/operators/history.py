"""History of changing attributes: the periods in which an entity's state held.

An entity's rows are folded as a sorted struct array by a higher-order
function that appends a version only upon change.  No array holds a whole hot
entity: the rows are range-partitioned by (entity, time), so an entity is cut
into chunks no larger than a partition, each chunk is folded, and the chunks
are stitched by the state carried into them.  Only entities at a partition's
edge have several chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import dna_key, norm_path, strip
from ..session import Cut
from ..sources.tables import table

#: Rows that a chunk may hold; the number of range partitions follows from it.
CHUNK_ROWS = 100_000


def _fold(rows: str, first: str) -> str:
    """SQL of the fold over an array of (at, id, s, b, p), starting from the state ``first``.

    The accumulator holds the valid state and the versions so far; a null s or
    b keeps the value before it, p is compared as it is.
    """
    state = "struct(coalesce(x.s, acc.s) AS s, coalesce(x.b, acc.b) AS b, x.p AS p)"
    same = "(acc.any AND coalesce(x.s, acc.s) <=> acc.s AND coalesce(x.b, acc.b) <=> acc.b AND x.p <=> acc.p)"
    version = f"named_struct('at', x.at, 'id', x.id, 's', {state}.s, 'b', {state}.b, 'p', x.p)"
    none = "CAST(array() AS array<struct<at:timestamp,id:bigint,s:string,b:string,p:string>>)"
    start = f"named_struct('any', {first}.any, 's', {first}.s, 'b', {first}.b, 'p', {first}.p, 'v', {none})"
    step = f"named_struct('any', true, 's', {state}.s, 'b', {state}.b, 'p', x.p, 'v', CASE WHEN {same} THEN acc.v ELSE concat(acc.v, array({version})) END)"
    return f"aggregate({rows}, {start}, (acc, x) -> {step}, acc -> acc.v)"


def periods(rows: DataFrame, n_rows: int) -> DataFrame:
    """Periods of unchanged state: entity, first_row_id, next_row_id (-1 if none follows), valid_from, valid_to, s, b, p.

    ``rows`` has entity, at, id, s, b, p; ``n_rows`` sets the number of chunks.
    Of rows with equal time only the highest id counts; a null entity or time
    gives nothing; a null s or b keeps the value valid before it (null until
    there is one), a null p is a state like any other; a state that returns
    opens a new period.
    """
    clean = rows.where("entity IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL")
    one = clean.groupBy("entity", "at").agg(F.max_by(F.struct("id", "s", "b", "p"), F.struct("id", F.struct("s", "b", "p"))).alias("r"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n_rows // CHUNK_ROWS)
    placed = one.select("entity", "at", "r.*").repartitionByRange(parts, "entity", "at").withColumn("chunk", F.spark_partition_id())
    cut = Cut(rows.sparkSession, "history")
    placed = cut.put(placed)[1]  # chunks are what they are from here on, whatever is computed again

    x = F.struct("at", "id", "s", "b", "p")
    chunks = placed.groupBy("entity", "chunk").agg(F.sort_array(F.collect_list(x)).alias("rows"))
    nothing = "named_struct('any', false, 's', CAST(NULL AS string), 'b', CAST(NULL AS string), 'p', CAST(NULL AS string))"
    folded = chunks.select("entity", "chunk", F.expr(_fold("rows", nothing)).alias("v"))

    # the state carried into each chunk, from what the chunks before it say
    def last(c: str):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at")))

    ends = placed.groupBy("entity", "chunk").agg(last("s").alias("s"), last("b").alias("b"), F.max_by(F.struct("p"), F.col("at")).alias("p"))
    before = W.partitionBy("entity").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    step = W.partitionBy("entity").orderBy("chunk")
    carried = ends.select(
        "entity",
        "chunk",
        F.struct(
            (F.row_number().over(step) > 1).alias("any"),
            F.last("s", ignorenulls=True).over(before).alias("s"),
            F.last("b", ignorenulls=True).over(before).alias("b"),
            F.lag("p").over(step)["p"].alias("p"),
        ).alias("c"),
    )
    versions = folded.join(carried, ["entity", "chunk"]).select("entity", "chunk", F.when(F.col("c.any"), F.expr(_fold("v", "c"))).otherwise(F.col("v")).alias("v"))
    versions = versions.where(F.size("v") > 0)
    after = versions.select("entity", "chunk", F.col("v")[0].alias("head"))
    after = after.select("entity", "chunk", F.lead(F.struct(F.col("head.id"), F.col("head.at"))).over(step).alias("next"))
    out = versions.join(after, ["entity", "chunk"]).select("entity", "v", "next", F.posexplode("v").alias("i", "x"))
    following = F.get("v", F.col("i") + 1)
    return out.select(
        "entity",
        F.col("x.id").alias("first_row_id"),
        F.coalesce(following["id"], F.col("next.id"), F.lit(-1)).alias("next_row_id"),
        F.col("x.at").alias("valid_from"),
        F.coalesce(following["at"], F.col("next.at")).alias("valid_to"),
        F.col("x.s").alias("s"),
        F.col("x.b").alias("b"),
        F.col("x.p").alias("p"),
    )


def symbol_states(spark: SparkSession, where: str) -> tuple[DataFrame, int]:
    rows = table(spark, where, "symbol_versions")
    hashed = [F.lower(strip(F.col(c))).alias(a) for c, a in (("signature_hash", "s"), ("body_hash", "b"))]
    return rows.select(dna_key(F.col("dna_id")).alias("entity"), F.col("recorded_at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), *hashed, norm_path(F.col("path")).alias("p")), rows.count()


def p6_found(spark: SparkSession, where: str) -> DataFrame:
    return periods(*symbol_states(spark, where)).select(F.col("entity").alias("dna_id"), "first_row_id", "next_row_id")


def p6_history(spark: SparkSession, where: str) -> DataFrame:
    """The full history: each version's state and the period in which it was valid (open end: null)."""
    return periods(*symbol_states(spark, where)).select(F.col("entity").alias("dna_id"), "valid_from", "valid_to", F.col("s").alias("signature_hash"), F.col("b").alias("body_hash"), F.col("p").alias("path"))
