"""Importance resampling towards a target: documents drawn by hashed n-gram weight and Gumbel noise.

Every run of one to NGRAM words is a feature; its bucket's gain is the log ratio of the target's and the
corpus's share. A document's weight is the sum of gains; with noise drawn from its id's hash, the highest
scores are a sample without replacement in proportion to the weights (Gumbel top-k).

Texts differ in length by many powers of ten, so a long one is cut: its words go in chunks of CHUNK, each with
the NGRAM - 1 words that follow, so that a chunk owns exactly the features that start in its own words. Chunks of
long texts are dealt to all tasks and their counts and weights summed by document; texts of at most one
chunk stay in their task. Two passes over the words: the first counts buckets (BUCKETS rows per task), the
second sums gains, which travel as BUCKETS numbers. Ranks come from a range partitioning: a place in a
sorted task after the rows of the tasks before, so that no task sorts everything.

The checksum of a run follows from those of its words (a CRC is linear), over whole blocks with numpy.

A null or empty text has no words, weight 0, and is never drawn; a null id has the noise of the empty id;
repeated rows are scored and ranked row by row; ties go to the smaller id, nulls first; an empty target or
table gives gains by the same formula or an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, table, tidy

NGRAM = 3
BUCKETS = 10_000
SEED = 42
#: A document needs so many words to be drawn; drawn are so many of a hundred.
MIN_WORDS, PERCENT = 20, 5
#: Bytes of text from which a document is cut, and words that a chunk owns.
LONG_BYTES, CHUNK = 200_000, 20_000
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 2_000_000

#: A-Z to a-z; every other ASCII character but digits and letters parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Lengths up to which a checksum is moved on by a table; longer ones are moved byte by byte.
_STEPS = 64


def _tables() -> np.ndarray:
    """For n < _STEPS zero bytes after a checksum: what each byte of the checksum then gives, to be XORed."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    out = np.zeros((_STEPS, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _STEPS):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


_MOVED = _tables()


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of a longer string's CRC-32 that its first bytes give: ``by`` more bytes follow them."""
    out = crc
    while len(by):
        n = np.minimum(by, _STEPS - 1)
        out = _MOVED[n, 0, out & 255] ^ _MOVED[n, 1, (out >> 8) & 255] ^ _MOVED[n, 2, (out >> 16) & 255] ^ _MOVED[n, 3, out >> 24]
        by = by - n
        if not by.any():
            break
    return out


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Features:
    """Buckets of all n-grams of some word lists: ``at`` is the list of each n-gram's first word, ``place`` its position there."""

    def __init__(self, lists: list[list[bytes]]) -> None:
        flat = pa.array([w for own in lists for w in own], pa.binary()).dictionary_encode()
        ids = flat.indices.to_numpy(zero_copy_only=False)
        distinct = flat.dictionary.to_pylist()
        one = np.array([zlib.crc32(w) for w in distinct], np.uint32)
        more = np.array([zlib.crc32(b" " + w) for w in distinct], np.uint32)
        size = np.array([len(w) + 1 for w in distinct], np.int64)
        counts = np.array([len(own) for own in lists], np.int64)
        owner = np.repeat(np.arange(len(lists)), counts)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        crc = one[ids] if len(ids) else np.zeros(0, np.uint32)
        found = [(crc, owner, place)]
        for k in range(1, NGRAM):
            inside = owner[k:] == owner[: max(len(owner) - k, 0)]
            last = ids[k:]
            crc = moved(crc[: len(last)], size[last]) ^ more[last] if len(last) else np.zeros(0, np.uint32)
            found.append((crc[inside], owner[: len(last)][inside], place[: len(last)][inside]))
        self.bucket = np.concatenate([f[0] for f in found]).astype(np.int64) % BUCKETS
        self.at = np.concatenate([f[1] for f in found])
        self.place = np.concatenate([f[2] for f in found])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Features, np.ndarray, list[int]]]:
    """Slices of pieces (rows with own and body), their features, which of these they own, and their own words."""
    for batch in batches:
        names = batch.schema.names
        raw = batch.column(names.index("body")).cast(pa.binary())
        a = 0
        while a < len(batch):
            b, size, lists = a, 0, []
            while b < len(batch) and (b == a or size < BLOCK_BYTES):
                lists.append(words(raw[b].as_py() or b""))
                size += len(raw[b].as_py() or b"")
                b += 1
            rows = batch.slice(a, b - a)
            own = [len(w) if n is None else n for w, n in zip(lists, rows.column(names.index("own")).to_pylist(), strict=True)]
            found = Features(lists)
            yield rows, found, found.place < np.array(own, np.int64)[found.at], own
            a = b
    tidy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for _, found, owned, _ in _blocks(batches):
        total += np.bincount(found.bucket[owned], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])


def _weigh(gains: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found, owned, own in _blocks(batches):
            at = found.at[owned]
            # exact: sums of integers far below 2 ** 53
            weight = np.bincount(at, gains[found.bucket[owned]], len(rows)).astype(np.int64)
            features = np.bincount(at, minlength=len(rows))
            keep = [rows.column(rows.schema.names.index(c)) for c in ("doc_id", "copy", "at")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(own, pa.int64()), pa.array(features, pa.int64()), pa.array(weight)], names=["doc_id", "copy", "at", "n_words", "n_features", "weight"])

    return weigh


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(2).cast(pa.binary())
        for i in range(len(batch)):
            own = words(raw[i].as_py())
            starts = list(range(0, max(len(own), 1), CHUNK))
            n = len(starts)
            columns = [batch.column(c).take(pa.array([i] * n)) for c in (0, 1)]
            counts = [min(CHUNK, len(own) - a) for a in starts]
            bodies = [b" ".join(own[a : a + CHUNK + NGRAM - 1]) for a in starts]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "copy", "at", "own", "body"])
    tidy()


def pieces(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, copy, at, own, body): whole texts of at most LONG_BYTES, whose copy and own are null, and the
    chunks of longer ones, dealt anew; copy tells rows that share an id and differ in text."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.octet_length("t"), F.lit(0)) > LONG_BYTES
    short = slim.where(~long).select("doc_id", F.lit(None).cast("string").alias("copy"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("own"), F.col("t").cast("binary").alias("body"))
    cut = slim.where(long).select("doc_id", F.md5("t").alias("copy"), "t").mapInArrow(_cut, f"doc_id {kind}, copy string, at bigint, own bigint, body binary")
    return short.unionByName(settle(cut.repartition("doc_id", "copy", "at"), "chunks"))


def bucket_counts(parts: DataFrame) -> np.ndarray:
    """How many features fall into each bucket: BUCKETS numbers, whatever the input."""
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.select("own", "body").mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket, in thousandths of a nat, rounded down."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs``."""
    ship(docs.sparkSession)
    parts = pieces(docs, key, text)
    kind = parts.schema["doc_id"].dataType.simpleString()
    found = gains(bucket_counts(parts), bucket_counts(pieces(target, target_text, target_text)))
    each = parts.mapInArrow(_weigh(found), f"doc_id {kind}, copy string, at bigint, n_words bigint, n_features bigint, weight bigint")
    single = each.where("copy IS NULL").select("doc_id", "n_words", "n_features", "weight")
    # equal rows meet in one sum, so divide by their number
    sums = each.where("copy IS NOT NULL").groupBy("doc_id", "copy").agg(F.count_if(F.col("at") == 0).alias("rows"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    several = sums.select("doc_id", *(F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")), F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))).drop("col")
    return single.unionByName(several)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each row in its sorted task."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        columns = [*batch.columns, pa.array(np.full(len(batch), task, np.int32)), pa.array(np.arange(n, n + len(batch), dtype=np.int64))]
        n += len(batch)
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "task", "nth"])


def ranked(scored: DataFrame, first: str, by: list, name: str) -> DataFrame:
    """``scored`` (already written) with column ``name``: the place, from 1, of rows where ``first`` is true, in order of ``by``."""
    order = [F.col(first).desc(), *by]
    sorted_ = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema)
    placed = settle(sorted_.mapInArrow(_place, f"{types}, task int, nth bigint"), "placed")
    # one number for each task
    counts = {r["task"]: r["n"] for r in placed.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [0] * (max(counts, default=0) + 1), 0
    for task in sorted(counts):
        before[task] = total
        total += counts[task]
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    place = F.get(offsets, F.col("task")) + F.col("nth") + 1
    return placed.withColumn(name, F.when(F.col(first), place)).drop("task", "nth")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score and rank (null if it is not drawn)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")
    scored = settle(weights(docs, target, key, text).withColumns({"score": F.col("weight") + noise, "enough": F.col("n_words") >= min_words}), "scored")
    n = scored.agg(F.count_if("enough")).first()[0]
    place = ranked(scored, "enough", [F.col("score").desc(), F.col("doc_id").asc()], "rank")
    return place.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank"))).drop("enough")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


#: A CRC-32 by its definition: eight shifts for each byte of the feature.
OP11_SQL = r"""
WITH source AS (
  SELECT row_number() OVER () AS r, false AS target, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), true, NULL, text FROM benchmark),
docs AS (SELECT r, target, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM source),
starts AS (SELECT r, target, ws, unnest(range(1, len(ws) + 1)) AS k FROM docs),
grams AS (SELECT r, target, array_to_string(ws[k : k + m - 1], ' ') AS g FROM starts, (VALUES (1), (2), (3)) AS v(m) WHERE k + m - 1 <= len(ws)),
kinds AS (SELECT g, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM grams GROUP BY g),
steps AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS step FROM range(256) AS v(b)),
hashed AS (
  SELECT g, s, t, xor(list_reduce(list_transform(string_split(regexp_replace(hex(encode(g)), '(..)', '\1 ', 'g'), ' ')[1 : octet_length(encode(g))], lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, x: xor(c >> 8, step[CAST(xor(c, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM kinds, steps),
buckets AS (SELECT b AS bucket, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t FROM range(10000) AS v(b) LEFT JOIN (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket) ON b = bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (S_ + 10000) / ((s + 1) * (T_ + 10000)))) AS BIGINT) AS gain FROM buckets, (SELECT sum(s) AS S_, sum(t) AS T_ FROM buckets) AS total),
sums AS (SELECT r, CAST(count(*) AS BIGINT) AS n, CAST(sum(gain) AS BIGINT) AS w FROM grams JOIN hashed USING (g) JOIN gains USING (bucket) WHERE NOT target GROUP BY r),
scored AS (
  SELECT r, doc_id, len(ws) >= 20 AS enough, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
    coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM docs LEFT JOIN sums USING (r) WHERE NOT target),
placed AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id ASC NULLS FIRST) AS place, count(*) FILTER (WHERE enough) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
