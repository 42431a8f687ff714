"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only in local mode may it be unset, a temporary folder serves then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspan-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans don't run or plan it again."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of :func:`settled` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._settled_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(found)


def fingerprint(df: DataFrame) -> str:
    """Digest of the files behind a table: names, sizes and times, not contents."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = F.xxhash64("file_path", "file_size", F.col("file_modification_time").cast("long"))
    n, x, s = files.agg(F.count("*"), F.bit_xor(row), F.sum(F.octet_length(F.col("file_path")) + F.col("file_size"))).first()
    return f"{n}-{(x or 0) & (2**64 - 1):016x}-{s or 0}"
