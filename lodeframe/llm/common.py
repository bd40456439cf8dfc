"""Shared helpers: table access, lineage cuts in the shared folder, small column functions."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 400_000

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    A session in one process (``local[...]``, as in tests) that names none gets a temporary folder; on a
    cluster, where a folder of one machine would lose data, its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage so that a lost executor costs a file read and not a recomputation; the
    files go when the interpreter ends or ``release`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodeframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what ``settle`` has written so far."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
            return


atexit.register(release)

_SHIPPED: set[str] = set()
#: Bytes of rows at most that travel to a Python worker at once: long texts make small batches.
BATCH_BYTES = 16 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application, and see to it that
    the session's batches to them are small: this lowers the session's setting for all that comes after
    (the default goes down, what a user has set in other units stays)."""
    context = spark.sparkContext
    now = spark.conf.get(_BYTES).rstrip("b") if spark.conf.isModifiable(_BYTES) else ""
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="lodeframe-"), f"{os.path.basename(top)}-package.zip")
    with zipfile.ZipFile(out, "w") as packed:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    packed.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(out)
    _SHIPPED.add(context.applicationId)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough; else as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def tidy() -> None:
    """Give freed memory of a Python worker back to the system: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))
