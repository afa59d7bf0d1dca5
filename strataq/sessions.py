"""What the operators ask of a session: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new temporary folder where it is unset and one machine does all, as in tests."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return str(there.get())
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strataq-")
    sc.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever file system its path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes a result to the shared folder and cuts its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
