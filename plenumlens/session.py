"""Session defaults, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. AQE coalesces small shuffles, splits skewed join
#: partitions and turns a join into a broadcast once the real size is known.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Settings only a new session can take. Recording the Python line of every column call
#: doubles the time it takes to build the long expressions used here.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

#: Least number of shuffle partitions a cluster starts with, before AQE merges them.
MANY_PARTITIONS = 4096

_local_scratch: str | None = None
_made: list[str] = []


def build_session(app: str = "plenumlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session carrying :data:`SESSION_CONF`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return apply_conf(builder.getOrCreate())


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster an unset
    folder is an error, since other executors could not read a machine-local path.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="plenumlens-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; :func:`clear_scratch` removes it."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this process has written below the shared folder.

    For the owner of a run to call when its results are read or written elsewhere.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where a result is consumed more than once and must not be computed again
    (an evaluator's verdicts, fragments cut from the text). A lost executor then costs
    re-reading a file, not re-running the stages behind it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session somebody else built."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    if not spark.sparkContext.master.startswith("local"):
        # start with many small shuffle partitions; AQE merges them up to its advisory size
        many = max(MANY_PARTITIONS, 4 * spark.sparkContext.defaultParallelism)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(many))
    return spark


def spread_few_files(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores if it has fewer splits than cores.

    A small input in one row group would otherwise be one task. An input with more
    splits than cores is left alone, so a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
