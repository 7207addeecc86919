"""Session helpers: configuration, checkpoints and table locations."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "weftline", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    as in tests on one machine, a temporary folder is made; with a cluster
    master that would lose data, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="weftline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (never a local one)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """More partitions where a scan has fewer than the cluster has cores.

    Large inputs are split by the scan itself and pass unchanged, without a shuffle.
    """
    cores = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def stored_path(df: DataFrame, name: str = "table") -> str:
    """Write ``df`` as Parquet in the shared checkpoint folder; the path of the table."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return path


_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete the tables that :func:`stored` has written in this process; how many there were.

    Results that still read them can't be computed after that, so a caller does this when it has
    written its own.
    """
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Like :func:`cut`, but later steps read only the columns they need, and the
    planner carries nothing over from the plan that made the table.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df, name))
