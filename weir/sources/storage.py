"""Tables that Spark derives and keeps: a folder that all executors share, and what they were made from."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the setting is absent and the master is local."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weir-checkpoint-"))
        shared = sc.getCheckpointDir()
    return shared


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends."""
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)


def state_of(df: DataFrame) -> str:
    """A name for the present state of a table of files: it changes with their paths, sizes and times."""
    m = F.col("_metadata")
    row = df.select(F.xxhash64(m["file_path"], m["file_size"], m["file_modification_time"]).alias("h")).distinct().agg(F.bit_xor("h").alias("h"), F.count("*").alias("n")).first()
    return f"{(row.h or 0) & (2**64 - 1):016x}-{row.n}"
