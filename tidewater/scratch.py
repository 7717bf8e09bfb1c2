"""Tables in the folder that the driver and all executors share, for steps that must not be computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in a local session that sets none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    """The file or folder goes, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def session_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes with the session."""
    path = f"{shared_dir(spark)}/tw-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


class Scratch:
    """Tables written to the shared folder, so that later stages neither recompute nor lose them.

    Tables that a result still reads live as long as the session: the folder is marked for deletion when its file
    system closes. Others go by ``drop`` or ``free``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n, self.held = spark, f"{shared_dir(spark)}/tw-{uuid.uuid4().hex}", 0, []

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        if self.n == 1:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(p)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut(self, df: DataFrame) -> DataFrame:
        out = self.put(df)
        self.held.append(out)
        return out[0]

    def free(self, *keep: DataFrame) -> None:
        """Deletes the tables of ``cut`` but those that a result still reads."""
        for df, path in self.held:
            if not any(df is k for k in keep):
                self.drop(path)
        self.held = [x for x in self.held if any(x[0] is k for k in keep)]

    def drop(self, path: str) -> None:
        delete(self.spark, path)
