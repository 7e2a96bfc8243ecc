"""Session construction and lineage cutting.

Everything here is plain SparkSession configuration.  The only piece of
policy is :func:`materialize`: iterative or order-sensitive operators cut
their lineage by writing a table into the shared folder named by
``spark.checkpoint.dir`` so that a lost executor never forces a replay of
nondeterministic work (range bounds, ``monotonically_increasing_id``).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of the engine should carry.  AQE re-plans joins and
# splits skewed shuffle partitions at runtime; the UI is a server, keep it off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "featurescape",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from the SparkContext or ``spark.checkpoint.dir``; only a local
    master (tests, single-machine runs) may fall back to a fresh folder under
    the system temp dir.  On a cluster an unset directory is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises on some versions
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="featurescape-ckpt-",
                                dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder "
        "(HDFS/S3/ABFS) before running iterative operators")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared checkpoint
    folder and read it back.

    Freezes nondeterministic columns, cuts the lineage and survives
    executor loss (the data lives in the shared folder), like a reliable
    ``checkpoint()``; unlike it, the planner sees the real file sizes.  A
    checkpointed plan keeps its origin's size estimate, and across
    iterative rounds the join estimates (products of child sizes) grow
    without bound."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.parquet(path)
    out.table_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more: all that
    was derived from them must have been written, or executors lost later could not
    have it computed again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
