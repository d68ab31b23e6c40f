"""Session construction and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a folder of
    its own; on a cluster, where a folder of one machine wouldn't be seen by the others, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def kept(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}"
    where, fs = _own(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared folder: its lineage ends there and it outlives lost executors. It is deleted when
    the application ends, or by ``release``."""
    spark = df.sparkSession
    path = f"{kept(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all that ``written`` has written in this application. For long sessions, once results are stored."""
    where, fs = _own(spark, f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}")
    fs.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, waves: int = 3) -> DataFrame:
    """``df`` in enough partitions to keep all cores busy. Large inputs have them already and aren't shuffled; a small one in
    few files is, as work of seconds a megabyte would else wait for one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(waves * cores, key)
