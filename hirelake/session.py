"""Session settings, shared scratch space and lineage cutting."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# AQE splits a skewed shuffle partition (a hot key) into several tasks even
# where that costs one more shuffle downstream.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Shuffle files go when their query ends and not when the driver collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Stream state off the JVM heap: first and last sightings are kept for every posting.
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def build_session(app: str = "hirelake", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    # Python workers get this package with the task, so executors need no install.
    cloudpickle.register_pickle_by_value(sys.modules["hirelake"])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster names it in
    ``spark.checkpoint.dir``. Only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="hirelake-")
        spark.conf.set(CHECKPOINT_DIR, configured)
    return configured.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below one folder per application, which can be dropped when it ends."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/hirelake-{application}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Cut lineage with a written table: survives executor loss, and later plans
    see its true size when they choose between broadcast and shuffle."""
    path = fresh_dir(df.sparkSession, label)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more; other frames are left alone."""
    for path in (vars(t).get("_scratch") for t in tables):
        if path:
            spark = tables[0].sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for heavy per-row work on a plain scan of few files. A scan that
    already has a partition per core, as any large one has, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
