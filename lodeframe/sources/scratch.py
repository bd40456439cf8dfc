"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a session in one process that names none gets a temporary folder, on a
    cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: what several branches of a plan use is made once, and a lost executor costs a
    file read. Compressed by zstd, as texts take two thirds of the disk then. The files go when the interpreter ends, or by ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodeframe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
            return


atexit.register(release)
