"""Near duplicates by SimHash fingerprints that differ in at most two of 64 bits.

A fingerprint has a bit set if more than half of the text's shingle hashes have it. Two fingerprints with at
most DISTANCE = 2 differing bits, cut into two halves, have one half that differs in at most one bit: so
each fingerprint is indexed by both halves as they are and by the 32 variants of each with one bit
deleted, and links are found by equality joins on these signatures and verified. Fingerprints whose halves
differ in the deleted bit meet only there, those with an equal half only under the half itself.

A signature that more than HOT fingerprints share would make pairs with the square of their number. Its members
are indexed again by the bits that may still differ: under a key with two bits deleted from the whole
fingerprint at most four different ones can meet, and all that do are linked. So rows grow with the
number of fingerprints, and no link is lost. Copies are one fingerprint from the start.

A null or empty text has fingerprint zero, linked like any other; a text of fewer than three words is one
shingle; rows that share an id keep a fingerprint each; a null id is no document to be named, but its
fingerprint links others, and its component is that of its fingerprint (null if no id is in it); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, sized, table, tidy
from .components import components

WORDS, SEED, DISTANCE = 3, 42, 2
HALF = 32
#: Fingerprints that share a signature and are still compared in pairs.
HOT = 32
#: Shingles whose bits are counted at once.
BLOCK = 100_000


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in blocks; none for a text without words."""
    own = text.lower().split()
    if not own:
        return
    body = b" ".join(own)
    ends = np.cumsum(np.array([len(w) + 1 for w in own])) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(own) - WORDS + 1, 1)
    last = min(WORDS, len(own)) - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(body)
    for k in range(0, n, BLOCK):
        m = min(k + BLOCK, n)
        yield np.array([digest(view[a:b], SEED) for a, b in zip(starts[k:m].tolist(), ends[k + last : m + last].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The fingerprint as a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py() or b"") for t in raw], pa.int64())], names=["doc_id", "fp"])
    tidy()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (a bigint) of every row."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    return slim.mapInArrow(_fingerprints, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _half(which: Column) -> Column:
    return F.when(which == 0, F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))).otherwise(F.shiftrightunsigned("fp", HALF))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _signature(i: Column) -> Column:
    """The i-th of 66: half i div 33; whole if i mod 33 is 0, else with bit i mod 33 - 1 deleted, which ``side`` tells."""
    which, wild = F.floor(i / (HALF + 1)), i % (HALF + 1)
    half = _half(which)
    bit = F.when(wild == 0, F.lit(0).cast("bigint")).otherwise(_bit(wild - 1))
    gone = half.bitwiseAND(F.bitwise_not(bit))
    return F.struct(F.call_function("shiftleft", i.cast("bigint"), F.lit(HALF)).bitwiseOR(gone).alias("sign"), (half != gone).alias("side"))


def signatures(fps: DataFrame) -> DataFrame:
    """Every fingerprint's 66 deletion-variant signatures: fp, sign, side."""
    return fps.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2 * HALF + 1)), _signature)).alias("s")).select("fp", "s.sign", "s.side")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp): all of signatures that at most ``hot`` share, and of the others
    enough to join what is within DISTANCE."""
    signs = signatures(fps)
    whole = (F.shiftrightunsigned("sign", HALF) % (HALF + 1)) == 0
    sizes = signs.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.count_if("side").alias("ones"))
    shared = settle(sizes.where((F.col("n") > 1) & (whole | ((F.col("ones") > 0) & (F.col("ones") < F.col("n"))))), "signs")
    members = settle(signs.join(shared.select("sign", "n"), "sign"), "members")
    cold = members.where(F.col("n") <= hot)
    left = cold.select("sign", F.col("fp").alias("a"), F.col("side").alias("x"))
    right = cold.select("sign", F.col("fp").alias("b"), F.col("side").alias("y"))
    apart = F.when(whole, F.col("a") < F.col("b")).otherwise(~F.col("x") & F.col("y"))
    pairs = left.join(right, "sign").where(apart & (_differ("a", "b") <= DISTANCE)).select("a", "b")
    return pairs.unionByName(_refined(members.where(F.col("n") > hot)))


def _refined(members: DataFrame) -> DataFrame:
    """Links within hot signatures, by keys of the whole fingerprint with two bits deleted."""
    i = F.shiftrightunsigned("sign", HALF)
    which, wild = F.floor(i / (HALF + 1)), i % (HALF + 1)
    other = F.when(which == 0, F.lit(HALF)).otherwise(F.lit(0))
    every = F.sequence(F.lit(0), F.lit(HALF - 1))
    # the half is equal: any two bits of the other one; it differs in one bit at most: that one and any of the other half
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(HALF - 1)), lambda q: F.transform(F.sequence(F.lit(0), q - 1), lambda p: _bit(other + p).bitwiseOR(_bit(other + q)))))
    one = F.transform(every, lambda q: _bit(F.lit(HALF) - other + wild - 1).bitwiseOR(_bit(other + q)))
    masks = members.select("fp", F.explode(F.when(wild == 0, two).otherwise(one)).alias("mask"))
    keys = masks.select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    # at most four members by construction
    met = keys.groupBy("mask", "rest").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.explode("all").alias("b"), F.array_min("all").alias("a")).where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: doc_id, fp (bigint) and component_id, the smallest id that its links reach."""
    rows = settle(fingerprints(docs, key, text), "fingerprints")
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp"), hot)).select(F.col("node").alias("fp"), "component")
    hung = settle(classes.join(sized(found), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "hung")
    least = hung.groupBy("component").agg(F.min("least").alias("component_id"))
    named = hung.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
