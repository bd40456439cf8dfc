"""Change data: classify scanned documents against stored ones, and merge, replace and delete rows.

Parquet tables are not updated in place: a new version is the old rows without the changed keys
(anti-join) plus the new ones, one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["repo_id", "path_norm"]


def classify(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """KEY, stored doc_id and state: new, changed, unchanged, or vanished.

    ``scanned``: KEY, content_hash (null: seen but unreadable, which keeps what is stored);
    ``stored``: KEY, doc_id, content_hash, deleted_at."""
    new, old = scanned.select(*KEY, F.col("content_hash").alias("new_hash"), F.lit(True).alias("seen")), stored.select(*KEY, "doc_id", F.col("content_hash").alias("old_hash"), "deleted_at", F.lit(True).alias("kept"))
    both = new.join(old, KEY, "full_outer")
    same = (F.col("new_hash") == F.col("old_hash")) & F.col("deleted_at").isNull()
    state = (
        F.when(F.col("seen").isNull(), "vanished")
        .when(F.col("new_hash").isNull(), "unreadable")
        .when(F.col("kept").isNull(), "new")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return both.select(*KEY, "doc_id", state.alias("state"))


def upsert(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Documents after an upsert on KEY: a stored doc_id and created_at stay, deleted_at is reset."""
    ids = stored.select(*KEY, F.col("doc_id").alias("_id"), F.col("created_at").alias("_created"))
    fresh = incoming.join(ids, KEY, "left")
    columns = stored.columns
    made = {"doc_id": F.coalesce("_id", "doc_id"), "created_at": F.coalesce("_created", now), "updated_at": now, "last_indexed_at": now, "deleted_at": F.lit(None).cast("timestamp")}
    new = fresh.select(*(made.get(c, F.col(c)).alias(c) for c in columns))
    return stored.join(incoming.select(*KEY), KEY, "left_anti").select(*columns).unionByName(new)


def soft_delete(documents: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    marked = documents.join(ids.select("doc_id", F.lit(True).alias("_gone")).distinct(), "doc_id", "left")
    return marked.withColumn("deleted_at", F.when(F.col("_gone"), now).otherwise(F.col("deleted_at"))).select(*documents.columns)


def without(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of documents that stay: the cascade of a hard delete, table by table."""
    return table.join(ids.select(F.col("doc_id").alias(key)), key, "left_anti").select(*table.columns)


def replace_children(old: DataFrame, changed: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    return without(old, changed, key).unionByName(new.select(*old.columns))


def delete_repo(table: DataFrame, repo_id: str) -> DataFrame:
    return table.where(F.col("repo_id") != repo_id)


def to_index(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("state").isin("new", "changed"))


def run_stats(classified: DataFrame) -> DataFrame:
    """One row: how many documents are in each state."""
    n = lambda s: F.count_if(F.col("state") == s).alias(f"files_{s}")
    return classified.agg(*(n(s) for s in ("new", "changed", "unchanged", "unreadable", "vanished")))
