"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowsieve")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one process, may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="flowsieve-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever reused."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """The table written to the shared folder and read back.

    For tables that several jobs read: a lost executor costs a re-read instead of the whole lineage,
    and later jobs read only the columns they use. ``partitions`` spreads a table from few files; the
    number is the caller's, so that models which sample by partition don't depend on the cluster.
    """
    path = scratch_path(df.sparkSession, name)
    if partitions:
        df = df.repartition(partitions)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
