"""Session settings and the few services every operator needs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def builder(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession.Builder:
    """A local session with the settings the engine expects (UTC, ANSI, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; only where that is unset in a local session, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession, name: str) -> tuple:
    """(file system, path) of a folder next to the checkpoints of all sessions that share them; it stays when the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_checkpoint_folder(spark)).getParent()
    made = spark._jvm.org.apache.hadoop.fs.Path(path, f"tidemark-{name}")
    fs = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(made)
    return fs, made.toString()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions so that one holds about per_part rows, never fewer than the session's shuffle partitions."""
    return max(shuffle_partitions(spark), -(-rows // per_part))
