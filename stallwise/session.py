"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "stallwise", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(sc: SparkContext) -> str:
    """The cluster's checkpoint folder.

    It is the one named in ``spark.checkpoint.dir``; a folder of our own is set only where
    that is unset, and only for a local master, since other machines could not reach it.
    """
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it back."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


@contextmanager
def stored_by(df: DataFrame, column: str, buckets: int) -> Iterator[DataFrame]:
    """``df`` as a table in the checkpoint folder, bucketed by ``column``, for the time of the context.

    Grouping it by the column, however often, takes no exchange.
    """
    spark = df.sparkSession
    name = f"by_{column}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark.sparkContext)}/{name}"
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
