"""Names of the registered queries, their DataFrame functions and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans import views
from lodeframe.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages of the corpus for a few questions, by hybrid score."""
    found = views.hits(spark, sf_dir)
    return found.select("query_id", "rank", "source_path", "line_start", "line_end", F.round("score", 6).alias("score"), "snippet").orderBy("query_id", "rank")
