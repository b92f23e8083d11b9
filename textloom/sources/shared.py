"""The folder that the driver and all executors share, and tables kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def home(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder if everything runs in this one process (tests), and
    an error otherwise, as executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{home(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``kept`` once nothing needs them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores where its files make fewer, as a few small files do; else as it is. A frame
    that holds a shuffle stays as it is too, as to count its tasks would run it."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
