"""Session helpers: shared folder, lineage cuts, table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OURS: dict[str, object] = {}


def _clean() -> None:
    """Removes this program's intermediate tables and checkpoints as it ends."""
    for path, spark in _OURS.items():
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
        except Exception:  # noqa: BLE001, S112 - the JVM may be gone; what is left is the shared folder's to expire
            continue


def _remember(spark: SparkSession, path: str) -> None:
    if not _OURS:
        atexit.register(_clean)
    _OURS[path] = spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as named by ``spark.checkpoint.dir``.

    Only where the session names none (unit tests in local mode) a folder of our own is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodespark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
        _remember(spark, spark.sparkContext.getCheckpointDir())  # a folder of this program below the named one
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed as the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Written to a table in the shared folder and read again: a lineage cut that is compressed."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over enough partitions for costly work per row; a scan that has enough of them stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(3 * cores, key)
