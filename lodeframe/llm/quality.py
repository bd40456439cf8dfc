"""Quality rules: fixed rules on words and lines, and a hashed n-gram log-likelihood ratio.

The ratio compares a trusted target's multinomial over hashed uni- and bigrams with the raw
corpus's, per n-gram of the document; documents below a fixed ratio go. The raw counts cover every
document, the target all those labelled good.

Built-in functions only. Two maps over the texts: the first counts hash buckets (BUCKETS rows after
the map side's aggregation, whatever the input), the second scores; the weights travel as one array
of BUCKETS numbers. The good ids are broadcast if counted to be few, else the first map's texts are
shuffled to them; nothing else is shuffled or gathered.

A null or empty text has no words: base_failed is true and kept false. Repeated rows are judged row
by row (and counted as often); without labels the ratio is 0 for every document; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, table, whole

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Mean log-likelihood ratio (nats per n-gram) from which a document is kept.
MIN_RATIO = -0.08

_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE, -1), lambda w: w != "")


def grams(w: str) -> Column:
    """Hash buckets of the uni- and bigrams of a words column."""
    own = F.col(w)
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    one = F.transform(own, lambda x: bucket(F.xxhash64(x)))
    two = F.transform(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda x, i: bucket(F.xxhash64(F.get(own, i), x)))
    return F.concat(one, two)


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """The log ratio of every bucket, in bucket order: BUCKETS numbers, whatever the input."""
    flagged = docs.select("doc_id", whole().alias("t")).join(sized(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    split = flagged.select(F.coalesce("good", F.lit(0)).alias("good"), words(F.col("t")).alias("w"))
    # outer: of an inner explode Spark infers a filter on the array's size that makes the array twice
    spread = split.select("good", F.explode_outer(grams("w")).alias("bucket")).where("bucket IS NOT NULL")
    counts = {r["bucket"]: r for r in spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target")).collect()}
    raw, target = sum(r["raw"] for r in counts.values()), sum(r["target"] for r in counts.values())
    if not target:
        return [0.0] * BUCKETS
    share = lambda n, of: math.log((n + SMOOTHING) / (of + SMOOTHING * BUCKETS))
    pair = lambda b: (counts[b]["target"], counts[b]["raw"]) if b in counts else (0, 0)
    return [round(share(pair(b)[0], target) - share(pair(b)[1], raw), 4) for b in range(BUCKETS)]


def trusted_sample(labels: DataFrame) -> DataFrame:
    """Ids of all good documents."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def _repeated(h: str) -> Column:
    """Words covered by 3-word windows whose hash occurs again: from the sorted window hashes."""
    own = F.col(h)
    return F.when(F.size(F.array_distinct(own)) < F.size(own), F.sort_array(F.transform(own, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and ratio for every document row."""
    found = bucket_weights(docs, trusted_sample(labels))
    weights = F.split(F.lit(",".join(map(str, found))), ",").cast("array<double>")  # folds to one literal
    t = F.col("t")
    text = docs.select("doc_id", whole().alias("t"))
    cut = text.select(
        "doc_id",
        words(t).alias("w"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    own = F.col("w")
    hashed = cut.select(
        "doc_id",
        F.size(own).cast("bigint").alias("n_words"),
        F.length(F.array_join(own, "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform(F.slice(own, 1, F.greatest(F.size(own) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(own, i + 1), F.get(own, i + 2))).alias("h"),
        F.aggregate(grams("w"), F.lit(0.0), lambda a, b: a + F.get(weights, b)).alias("total"),
    )
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    ordered = hashed.select(*counts, "total", _repeated("h").alias("s"))
    s = F.col("s")
    again = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
    starts = ordered.select(*counts, "total", F.sort_array(F.filter(again, lambda x: x.isNotNull())).alias("d"))
    d = F.col("d")
    covered = F.aggregate(F.transform(d, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    full = starts.select(*counts, covered.cast("bigint").alias("n_repeat_words"), F.round(F.col("total") / F.greatest(2 * F.col("n_words") - 1, F.lit(1)), 6).alias("ratio"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return full.select(*counts, "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("ratio") >= MIN_RATIO)).alias("kept"), "ratio")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
