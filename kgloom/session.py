"""The session that this engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC makes timestamps comparable; AQE splits skewed joins and merges small partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("kgloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; in local mode one of this machine is set where the session names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kgloom-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables, inside of the shared folder."""
    return f"{shared_folder(spark)}/kgloom-{spark.sparkContext.applicationId}"


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` at files in the shared folder, which outlive every executor."""
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: to be called once its results are written, as DataFrames
    that were made before can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
