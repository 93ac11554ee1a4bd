"""Parquet table access, and how this package cuts lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; only ``columns`` reach the scan when they are given."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir, else a local one for tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        import tempfile
        import warnings

        warnings.warn("spark.checkpoint.dir is not set: checkpoints go to a folder of this machine, which is for tests only", stacklevel=2)
        folder = tempfile.mkdtemp(prefix="quadrant-")
        sc.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` with its lineage cut: a reliable checkpoint in the shared folder."""
    shared_folder(frame.sparkSession)
    if not frame.sparkSession.sparkContext.getCheckpointDir():
        frame.sparkSession.sparkContext.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit in which CPU-heavy Python stages are split."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

