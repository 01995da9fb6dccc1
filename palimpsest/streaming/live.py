"""Live edits by Structured Streaming.

The functions take a streaming frame of edit events (entity, ts, kind, lines,
symbols) and return a streaming frame; ``run_available`` drives one to the end
of what is there.  The watermark bounds every state, which the processing-time
original lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import Cut

WATERMARK = "10 minutes"
#: The state of an entity ends after so long without an edit.
IDLE_MS = 30 * 86_400_000
MAX_BUFFER = 1000
MAX_LINES, MAX_SYMBOLS, MAX_EDITS = 50, 5, 50


def edit_stream(spark: SparkSession, where: str) -> DataFrame:
    """The events table as a stream of edits; a purchase counts as save."""
    static = spark.read.parquet(f"{where}/events.parquet")
    raw = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", "8").parquet(f"{where}/events.parquet*")  # a pattern takes a file as well as a folder
    return raw.select(
        F.col("event_id"),
        F.col("user_id").alias("entity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", "save").otherwise("edit").alias("kind"),
        F.pmod("event_id", F.lit(9)).cast("int").alias("lines"),
        F.pmod("event_id", F.lit(2)).cast("int").alias("symbols"),
    )


def lateness(spark: SparkSession, where: str) -> str:
    """A watermark delay that loses no event of what is available: how far a file's events lie before the newest of files read no later.

    Files of one modification time may be read in any order.
    """
    at = F.col("_metadata.file_modification_time")
    files = spark.read.parquet(f"{where}/events.parquet").where("ts IS NOT NULL").groupBy(at.alias("read")).agg(F.min(F.col("ts").cast("timestamp")).alias("low"), F.max(F.col("ts").cast("timestamp")).alias("high"))
    newest = F.max("high").over(W.orderBy("read"))  # a row per modification time
    late = files.select((F.unix_seconds(newest) - F.unix_seconds("low")).alias("s")).agg(F.max("s")).first()[0]
    return f"{(late or 0) + 1} seconds"


def sessions(spark: SparkSession, where: str, quiet: str) -> DataFrame:
    """All bursts of what is available, the open ones too: they end with the data.

    The bursts still open at the end are written by a mark, an event of no
    entity whose time lies behind all of them.
    """
    late, cut = lateness(spark, where), Cut(spark, "ends")
    events = edit_stream(spark, where)
    none = spark.createDataFrame([], events.schema)
    path, _ = cut.put(none)
    marked = events.withColumn("mark", F.lit(False)).unionByName(spark.readStream.schema(events.schema).parquet(path).withColumn("mark", F.lit(True)))
    held = marked.withWatermark("ts", late).groupBy("mark", "entity", F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("edits"))
    out = held.select("mark", "entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "edits")
    run = Cut(spark, "stream")
    run_available(out, cut=run)
    last = spark.read.parquet(f"{where}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    mark = last.where("ts IS NOT NULL").select((F.col("ts") + F.expr(f"INTERVAL {quiet}") + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 1 minute")).alias("ts"))
    for _ in range(2):  # a batch writes what the watermark before it closes; the second mark is for sessions without batches of no data
        none.unionByName(mark, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
        found = run_available(out, cut=run)
    return found.where("NOT mark").drop("mark")  # not before, as the filter would be pushed below the watermark


def run_available(stream: DataFrame, mode: str = "append", cut: Cut | None = None) -> DataFrame:
    """Runs a streaming frame over all that is available and returns what it wrote, as a batch frame.

    Output and checkpoint lie in the shared folder, so a restarted query goes
    on where it stopped; so does a further run with the same ``cut``.
    """
    cut = cut or Cut(stream.sparkSession, "stream")
    path = f"{cut.base}/out"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{cut.base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Runs a function on every micro-batch of what is available; a batch may be given again after a failure."""
    cut = Cut(stream.sparkSession, "stream")
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{cut.base}/state").trigger(availableNow=True).start()
    query.awaitTermination()


_BUFFER = T.StructType([T.StructField("edits", T.LongType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])
_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("edits", "lines", "symbols")])


def buffered(stream: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Per entity and batch: edits so far, and size and lines of its buffer of the last MAX_BUFFER changes; both end after IDLE_MS without an edit."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        edits, lines = state.get if state.exists else (0, [])
        lines, newest = list(lines), 0
        for pdf in batches:
            edits += len(pdf)
            lines = (lines + pdf.sort_values(["ts", "event_id"])["lines"].tolist())[-MAX_BUFFER:]
            newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
        state.update((edits, lines))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame({"entity": [key[0]], "edits": [edits], "buffered": [len(lines)], "lines": [sum(lines)]})

    timed = stream.where("ts IS NOT NULL").withWatermark("ts", late)
    return timed.groupBy("entity").applyInPandasWithState(update, "entity long, edits long, buffered long, lines long", _BUFFER, "append", GroupStateTimeout.EventTimeTimeout)


def debounced(stream: DataFrame, quiet: str = "500 milliseconds") -> DataFrame:
    """Bursts of edits of one entity that end in a quiet period: entity, start, end, edits.  Every entity has a timer of its own."""
    held = stream.withWatermark("ts", WATERMARK).groupBy("entity", F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("edits"))
    return held.select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "edits")


def bursts(batch: DataFrame, quiet: str) -> DataFrame:
    """Bursts of a batch's edits: entity, and the first event of each run of edits that follow each other within the quiet period."""
    w = W.partitionBy("entity").orderBy("ts", "event_id")
    begins = F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {quiet}"), F.lit(True))
    return batch.withColumn("_begins", begins).where("_begins").select("entity", "ts", "event_id")


def triggered(stream: DataFrame, resets: bool = True, late: str = WATERMARK) -> DataFrame:
    """Analyses to start: an event when an entity's edits since the last one reach a threshold; then counts begin anew.

    Thresholds are lines, symbols or edits; a save clears the counts too, and
    so do IDLE_MS without an edit.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        edits, lines, symbols = state.get if state.exists else (0, 0, 0)
        fired, newest = [], 0
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
            for event, save, more, named in zip(pdf["event_id"].tolist(), (pdf["kind"] == "save").tolist(), pdf["lines"].tolist(), pdf["symbols"].tolist()):
                if save:
                    if resets:
                        edits = lines = symbols = 0
                    continue
                edits, lines, symbols = edits + 1, lines + more, symbols + named
                if lines >= MAX_LINES or symbols >= MAX_SYMBOLS or edits >= MAX_EDITS:
                    fired.append((key[0], event, edits, lines, symbols))
                    edits = lines = symbols = 0
        state.update((edits, lines, symbols))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame(fired, columns=["entity", "event_id", "edits", "lines", "symbols"])

    timed = stream.where("ts IS NOT NULL").withWatermark("ts", late)
    return timed.groupBy("entity").applyInPandasWithState(update, "entity long, event_id long, edits long, lines long, symbols long", _COUNTS, "append", GroupStateTimeout.EventTimeTimeout)


def written(spark: SparkSession, path: str) -> list[int]:
    """The batches that have been written below a folder, none where the folder is not there; other errors are raised."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [x.getPath().getName() for x in files.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def put_batch(rows: DataFrame, path: str, batch: int, flush_rows: int | None = None) -> None:
    """Writes a batch to a folder of its own, so that a repeated batch replaces itself; no file holds more than ``flush_rows``."""
    writer = rows.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", flush_rows) if flush_rows else writer).parquet(f"{path}/{batch}")


def fresh(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not processed yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def unexpired(cache: DataFrame, at: str, as_of, ttl_seconds: int) -> DataFrame:
    """Cache entries younger than their time to live."""
    return cache.where(F.unix_micros(F.col(at)) > F.unix_micros(as_of) - ttl_seconds * 1_000_000)
