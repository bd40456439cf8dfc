"""Files dropped into a folder, merged into the store micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeframe.plans.ingest import Settings, ingest
from lodeframe.sources.store import Store

SCHEMA = "path string, text string"


def follow(spark: SparkSession, folder: str, store: Store, repo_id: str, checkpoint: str, settings: Settings = Settings(), available_now: bool = True) -> StreamingQuery:
    """A query that ingests Parquet files (path, text) as they arrive. Of a path's rows in a batch the last
    one counts: by its file's time, then its file's name, then its place there. Content hashes make a
    replayed batch a no-op, so a restart loses and doubles nothing."""
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    arriving = spark.readStream.schema(SCHEMA).parquet(folder).select("path", "text", place.alias("place"))

    def merge_batch(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("text", "place").alias("text"))
        rows = last.select("path", "text", F.lit(None).cast("string").alias("skip_reason"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.lit(None).cast("timestamp").alias("mtime"))
        ingest(batch.sparkSession, store, repo_id, rows, "incremental", settings, whole=False)

    writer = arriving.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
