"""Session helpers: a local builder for tests and benches, and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's checkpoint folder.  Only a single-process ``local[...]``
    session without one gets a temporary folder; a cluster without one is an
    error, since no machine-local folder would survive there.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


class Cut:
    """Tables written to the shared folder to cut lineage.

    ``put`` computes a frame once and returns a frame that reads the written
    rows, so a lost executor costs a re-read and never a recomputed loop.
    ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[str] = []
        atexit.register(self.close)

    def put(self, df: DataFrame) -> tuple[str, DataFrame]:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        self.paths.append(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def put_counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """The written table and aggregates of its rows, taken while they are written."""
        seen = Observation()
        _, out = self.put(df.observe(seen, *(c.alias(name) for name, c in counts.items())))
        return out, seen.get

    def drop(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session may be gone; the folder is the cluster's to clean
            pass

    def keep(self, *paths: str) -> None:
        """Drop all tables but these."""
        for path in self.paths:
            if path not in paths:
                self.drop(path)
        self.paths = list(paths)

    def close(self) -> None:
        self.drop(self.base)
