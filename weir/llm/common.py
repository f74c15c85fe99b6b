"""Small helpers shared by the operators: reading tables, checkpoints, splits, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators; it sorts first, as nulls do.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the setting is absent and the master is local."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weir-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: an executor's loss costs no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder, smaller than a checkpoint; unless kept, the table is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        system, place = file_system(spark, path)
        system.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Spark's own access to a path of any store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = file_system(spark, path)
    return system.exists(place)


def removed(spark: SparkSession, path: str) -> None:
    system, place = file_system(spark, path)
    system.delete(place, True)


def whole_text(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3 (a null id counts as the text "null")."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("null"))) % 3 == 1


#: Rows up to which a table made here is broadcast; beyond it joins shuffle. A row of the tables in question has under 64 bytes.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table as the small side of a join: broadcast if it has been counted to hold few rows, shuffled otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def doc_key(docs: DataFrame) -> DataFrame:
    """did, tag, text, in the order of documents by (did, tag).

    did: the doc_id, nulls least. tag: 0 where a did has one text; the texts of one did (or without any) have distinct tags that
    rise with 128 bits of the text's hash. Rows of equal did and text share their key.
    """
    text = whole_text()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), text.alias("text"))
    both = F.struct("h", "g")
    several = checkpoint(rows.groupBy("did").agg(F.min(both).alias("lo"), F.max(both).alias("hi")).filter("lo <> hi").select("did"))
    if several.isEmpty():
        return rows.select("did", F.lit(0).cast("long").alias("tag"), "text")
    keys = rows.select("did", "h", "g").distinct().join(small(several), "did", "left_semi").orderBy("did", "h", "g")
    tags = checkpoint(keys).withColumn("tag", F.monotonically_increasing_id() + 1)  # over written, sorted rows: it rises with them
    return rows.join(small(tags), ["did", "h", "g"], "left").select("did", F.coalesce("tag", F.lit(0)).alias("tag"), "text")


def real_id(did: str = "did") -> Column:
    return F.when(F.col(did) != NULL_ID, F.col(did))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts (one more at the end); no copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8), offs
