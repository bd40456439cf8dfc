"""Exact Jaccard join of documents' word shingles, to its connected components.

The published idea of set-relation skipping, on Spark: lists of an inverted index are skipped in
blocks by position and size, and a set's answers come from those of a set it is known to resemble.

1. Equal sets are one class; from here on a class is one set.
2. Survivors. A set that links with anything shares all but a quarter of its shingles with it, so of
   any part of its shingles too. Every set emits the shingles whose hash lies in the lowest F of the
   hash space (F falls to 0.3 as sets grow) and goes unless enough of them occur in other sets. A task
   merges what its own sets share before it emits, so that a shingle of a third of all documents is a
   row per task. Most documents end here. The rest do the same once more with all their shingles,
   which gives each set's exact number of shingles that any other one has.
3. Index. Survivors list a prefix of the emitted shingles, rare ones before frequent ones: two sets
   that link have a shingle in common there, within the first seventh for the smaller one. Blocks of
   a list hold sets of one size band; an entry has its position in the set's order, and a block's pair
   is skipped if what is left from there on can't make a link.
4. Leaders. In each block sets pair with the least one only, and each set verifies its most frequent
   leader; linked sets take the leader's component.
5. The rest. A set that does not link with its leader is compared with the leader's other sets through
   what each has of the leader, as bits, and at most has beyond it. Sets of different leaders meet in
   lists that hold more than one component (a list within one is never brought together), if what
   other sets have of them at all may suffice. The pairs that this leaves are verified.

Every step that could drop a link is a proven bound; there is no cap. Shingles are compared by 64-bit hashes
(of N different ones some pair agrees with probability N * N / 2 ** 65, and a link of sets of many
shingles needs many such accidents); a set of one shingle, a text of at most five words, is as safe as
one hash.

A document with fewer than five words is its whole sequence as one shingle; null and empty texts
have the empty set and link with nothing; rows that share an id are one node; a null id is no node
(its component is that of an equal text, if any, else null); an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, sized, table, tidy
from .components import components
from .wordhash import Block, blocks, windows

WORDS = 5
#: Sizes from which a share of the hash space is emitted.
SHARES = ((0, 1.0), (40, 0.42), (300, 0.34), (2000, 0.30))
#: Shingles that so many sets emit count as frequent; at most so many of them, the most frequent ones,
#: are told apart (by powers of two): this orders the index and decides no link.
FREQUENT, MAX_FREQUENT = 16, 1 << 18
BUCKETS_PER_PARTITION = 4

_FROM = np.array([n for n, _ in SHARES])
_LIMIT = np.array([min(int(f * 2.0**64), 2**64 - 1) for _, f in SHARES], np.uint64)
_ID = np.uint64((1 << 47) - 1)


def limit(n: int) -> np.uint64:
    return _LIMIT[np.searchsorted(_FROM, n, side="right") - 1]


def own_overlap(n: int) -> int:
    """The least overlap with a linked set of any size."""
    return -(-3 * n // 4)


def wide_overlap(n: int) -> int:
    """The least overlap with a linked set that is not smaller."""
    return -(-6 * n // 7)


# --- sets -----------------------------------------------------------------------------------


def small(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that what is built from one stays small; frees Arrow's own memory."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
        del batch
        tidy()


def raw(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.binary()))


def sets(texts: Iterator[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted distinct shingle hashes of every text."""
    split = ((i, (t or b"").lower().split()) for i, t in enumerate(texts))
    open_: tuple[int, list[np.ndarray]] | None = None
    for group in blocks(split, WORDS - 1):
        block = Block(b" ".join(b" ".join(part) for _, _, part in group))
        words = block.words()
        shingles = windows(words, WORDS)
        first = 0
        for owner, _, part in group:
            n = len(part)
            found = shingles[first : first + n - WORDS + 1] if n >= WORDS else windows(words[first : first + n], n) ^ np.uint64(n)
            first += n
            if open_ and open_[0] == owner:
                open_[1].append(found)
                continue
            if open_:
                yield open_[0], distinct(open_[1])
            open_ = (owner, [found])
    if open_:
        yield open_[0], distinct(open_[1])


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    h = np.sort(np.concatenate(parts))
    return h[np.append(True, h[1:] != h[:-1])]


def set_id(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def emitted(h: np.ndarray) -> tuple[np.ndarray, int, int]:
    """What a set emits, how many of that (from the start) count, and how many must be shared."""
    n = len(h)
    o = own_overlap(n)
    inside = int(np.searchsorted(h, limit(n)))
    wide = int(np.searchsorted(h, limit(o)))
    need = inside - (n - o)
    if need >= 1:
        return h[: max(wide, n - o + 1)], inside, need
    out = h[: max(wide, n - o + 1)]
    return out, len(out), 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        n, ids, needs = [0] * len(batch), [None] * len(batch), [None] * len(batch)
        for i, h in sets(raw(batch.column(1))):
            n[i], ids[i], needs[i] = len(h), set_id(h), emitted(h)[2]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(needs, pa.int64())], names=["doc_id", "n_shingles", "set_id", "need"])


# --- survivors ------------------------------------------------------------------------------


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _emit(n_buckets: int):
    """Rows (bucket, body) of what every set emits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield from _packed((h, *emitted(h)[:2]) for _, h in sets(raw(batch.column(0))))(n_buckets)

    return emit


def _emit_all(n_buckets: int):
    """The same of all shingles of packed sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            every = (np.frombuffer(x, np.uint64) for x in raw(batch.column(0)))
            yield from _packed((h, h, len(h)) for h in every)(n_buckets)

    return emit


def _packed(given: Iterator[tuple[np.ndarray, np.ndarray, int]]):
    """Hashes with the one set here that has them, hashes that several have with their number, and the
    counts of sets' shingles known to be shared, as rows by bucket."""
    seen, hashes, owners = set(), [], []
    for h, out, counted in given:
        own = set_id(h)
        if own in seen:
            continue
        seen.add(own)
        hashes.append(out >> np.uint64(16))
        flags = np.zeros(len(out), np.uint64)
        flags[:counted] = 1
        owners.append((np.uint64(own & int(_ID)) << np.uint64(1)) | flags)

    def rows(n_buckets: int) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        hashes.clear()
        owners.clear()
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        new = np.append(True, h[1:] != h[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(h)))
        several = np.repeat(size > 1, size)
        known = owner[several & (owner & np.uint64(1)).astype(bool)] >> np.uint64(1)
        ids, counts = np.unique(known, return_counts=True)
        alone, alone_owner = h[~several], owner[~several]
        many, weight = h[new][size > 1], size[size > 1]
        b1, b2 = (alone % np.uint64(n_buckets)).astype(np.int64), (many % np.uint64(n_buckets)).astype(np.int64)
        o1, o2 = np.argsort(b1, kind="stable"), np.argsort(b2, kind="stable")
        alone, alone_owner, b1, many, weight, b2 = alone[o1], alone_owner[o1], b1[o1], many[o2], weight[o2], b2[o2]
        buckets, bodies = np.union1d(b1, b2), []
        i1, i2 = np.searchsorted(b1, np.append(buckets, n_buckets)), np.searchsorted(b2, np.append(buckets, n_buckets))
        for k in range(len(buckets)):
            x, y = slice(i1[k], i1[k + 1]), slice(i2[k], i2[k + 1])
            first = k == 0
            head = np.array([x.stop - x.start, y.stop - y.start, len(ids) if first else 0], np.int64)
            body = head.tobytes() + _six(alone[x]) + _six(alone_owner[x]) + _six(many[y]) + weight[y].astype(np.int64).tobytes()
            bodies.append(body + (ids.astype(np.int64).tobytes() + counts.astype(np.int64).tobytes() if first else b""))
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    return rows


TALLY = pa.schema([("frequent", pa.bool_()), ("key", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
TALLY_SQL = "frequent boolean, key bigint, n bigint, body binary"


def _tally(n_buckets: int):
    """Bucket side: rows (true, hash, sets that emit it) for frequent hashes, and (false, bucket, number,
    body) with the sets of a bucket and their numbers of shared shingles found here."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_h, single_owner, many_h, many_n, known, known_n = [], [], [], [], [], []
        for batch in small(batches):
            for body in batch.column(1):
                data = body.as_py()
                n1, n2, n3 = np.frombuffer(data, np.int64, 3).tolist()
                single_h.append(_wide(data, n1, 24))
                single_owner.append(_wide(data, n1, 24 + 6 * n1))
                many_h.append(_wide(data, n2, 24 + 12 * n1))
                at = 24 + 12 * n1 + 6 * n2
                many_n.append(np.frombuffer(data, np.int64, n2, at).copy())
                known.append(np.frombuffer(data, np.int64, n3, at + 8 * n2).astype(np.uint64))
                known_n.append(np.frombuffer(data, np.int64, n3, at + 8 * (n2 + n3)).copy())
        if not single_h:
            return
        h, owner = np.concatenate(single_h), np.concatenate(single_owner)
        single_h.clear()
        single_owner.clear()
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        keep = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
        h, owner = h[keep], owner[keep]
        mh, mn = np.concatenate(many_h), np.concatenate(many_n)
        every, back = np.unique(np.concatenate([h, mh]), return_inverse=True)
        total = np.bincount(back, np.concatenate([np.ones(len(h), np.int64), mn]), len(every)).astype(np.int64)
        shared = total[back[: len(h)]] > 1
        counted = owner[shared & (owner & np.uint64(1)).astype(bool)] >> np.uint64(1)
        yield from _by_bucket(n_buckets, np.concatenate([counted, *known]), np.concatenate([np.ones(len(counted), np.int64), *known_n]))
        often = np.flatnonzero(total >= FREQUENT)
        often = often[np.argsort(-total[often], kind="stable")[:MAX_FREQUENT]]
        none = pa.nulls(len(often), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(often), bool)), pa.array(every[often].astype(np.int64)), pa.array(total[often]), none], schema=TALLY)

    return tally


def _by_bucket(n_buckets: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids, back = np.unique(key, return_inverse=True)
    sums = np.bincount(back, n, len(ids)).astype(np.int64)
    bucket = (ids % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, sums, bucket = ids[order].astype(np.int64), sums[order], bucket[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    ends = np.append(edges[1:], len(bucket))
    bodies = [ids[a:b].tobytes() + sums[a:b].tobytes() for a, b in zip(edges, ends, strict=False)]
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(bodies), bool)), pa.array(bucket[edges]), pa.array((ends - edges) if len(edges) else np.zeros(0, np.int64)), pa.array(bodies, pa.binary())], schema=TALLY)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sums = [], []
    for batch in small(batches):
        for body in batch.column(0):
            data = np.frombuffer(body.as_py(), np.int64).reshape(2, -1)
            ids.append(data[0])
            sums.append(data[1])
    if ids:
        every, back = np.unique(np.concatenate(ids), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.bincount(back, np.concatenate(sums), len(every)).astype(np.int64))], names=["key", "shared"])


def partitions_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tallied(rows: DataFrame, name: str) -> DataFrame:
    n = partitions_of(rows.sparkSession)
    return settle(rows.repartition(n, "bucket").mapInArrow(_tally(n), TALLY_SQL), name)


def shared_counts(tally: DataFrame) -> DataFrame:
    """key, shared: a set's shingles that any other set emits too. A bucket's sets come together as arrays."""
    n = partitions_of(tally.sparkSession)
    return tally.where("NOT frequent").repartition(n, "key").select("body").mapInArrow(_sum, "key bigint, shared bigint")


def frequencies(tally: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles' short hashes, sorted, and their levels (1, 2, ... by powers of two)."""
    often = tally.where("frequent").orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).select("key", "n").toPandas()
    key, n = often["key"].to_numpy(np.uint64), often["n"].to_numpy(np.float64)
    order = np.argsort(key)
    return key[order], (np.floor(np.log2(n[order] / FREQUENT)) + 1).astype(np.int8)


# --- index ----------------------------------------------------------------------------------


def prefix(h: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """The shingles under which a set is listed, how many of them (from the start) it needs to be found
    by sets that are not smaller, and whether they are its first ones in the order of all shingles."""
    n = len(h)
    spare = n - own_overlap(n)
    a = h[: int(np.searchsorted(h, limit(n)))]
    if len(a) <= spare:  # too few of its shingles lie in its share: all it emits
        out = emitted(h)[0]
        return out, len(out), False
    level = np.zeros(len(a), np.int8)
    if len(keys):
        short = a >> np.uint64(16)
        at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
        level = np.where(keys[at] == short, levels[at], 0)
    klass = np.searchsorted(np.sort(_LIMIT), a, side="right")
    return a[np.lexsort((a, level, klass))[: spare + 1]], n - wide_overlap(n) + 1, True


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        docs, packed = [], []
        ids = batch.column(0).to_pylist()
        for i, h in sets(raw(batch.column(1))):
            docs.append(ids[i])
            packed.append(h.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([len(p) // 8 for p in packed], pa.int64()), pa.array([set_id(np.frombuffer(p, np.uint64)) & int(_ID) for p in packed], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "key", "packed"])


def _lists(keys: np.ndarray, levels: np.ndarray):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [prefix(np.frombuffer(x, np.uint64), keys, levels) for x in raw(batch.column(3))]
            heads = pa.array([p.view(np.int64) for p, _, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), heads, pa.array([k for _, k, _ in found], pa.int64()), pa.array([o for _, _, o in found], pa.bool_())], names=["doc_id", "n", "reach", "prefix", "narrow", "ordered"])

    return lists


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        shared, n_a, n_b, masks = [], [], [], []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            n_a.append(len(x))
            n_b.append(len(y))
            there = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
            shared.append(int(there.sum()))
            masks.append(np.packbits(there).tobytes())
        counts = [pa.array(v, pa.int64()) for v in (n_a, n_b, shared)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, pa.array(masks, pa.binary())], names=["a", "b", "n_a", "n_b", "shared", "mask"])


def verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """a, b, their sizes, what they share, and the bits of a's shingles that b has, for every pair (a, b)."""
    first = packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("x"))
    second = packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("y"))
    both = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "x", "y")
    return both.mapInArrow(_intersect, "a bigint, b bigint, n_a bigint, n_b bigint, shared bigint, mask binary")


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where("175 * shared >= 75 * (n_a + n_b)").select("a", "b")


#: Sets in a block of a leader's sets, about.
SIDE = 256
#: Sizes of sets that link lie in the same or in neighbouring bands.
BAND = 1.34


def band(n: str):
    return F.floor(F.log(F.col(n)) / F.log(F.lit(BAND))).cast("int")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one leader's sets that may link though their components differ: a block of outsiders
    (column 0) against a block of any (column 1). What both have of the leader is counted from masks."""
    for batch in small(batches, 64):
        a, b = [], []
        for k in range(len(batch)):
            one, two = (_block(batch.column(i)[k].values) for i in range(2))
            width = max(one["bits"].shape[1], two["bits"].shape[1])
            bits = np.pad(two["bits"], ((0, 0), (0, width - two["bits"].shape[1])))
            own = np.pad(one["bits"], ((0, 0), (0, width - one["bits"].shape[1])))
            for i in range(len(own)):
                both = np.bitwise_count(bits & own[i]).sum(axis=1, dtype=np.int64) + np.minimum(two["beyond"], one["beyond"][i])
                # two outsiders meet twice
                once = ~two["outsider"] | (two["doc_id"] > one["doc_id"][i])
                hit = (two["c"] != one["c"][i]) & once & (175 * both >= 75 * (two["n"] + one["n"][i]))
                found = two["doc_id"][hit]
                a.append(np.full(len(found), one["doc_id"][i]))
                b.append(found)
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], names=["a", "b"])


def _block(rows: pa.StructArray) -> dict[str, np.ndarray]:
    out = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "c", "beyond", "outsider")}
    masks = [np.frombuffer(m, np.uint8) for m in rows.field("mask").to_pylist()]
    bits = np.zeros((len(masks), -(-max(map(len, masks)) // 8) * 8), np.uint8)
    for i, m in enumerate(masks):
        bits[i, : len(m)] = m
    return out | {"bits": bits.view(np.uint64)}


def same_leader(members: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify among sets with one leader, which some of them don't link with.

    ``members``: leader, doc_id, n, c, beyond, mask, outsider. A leader's sets are dealt to blocks of some
    SIDE sets by size band and hash; each block of outsiders meets each block of its own and the next
    bands, as one row that holds both. Rows of a large family are spread over all tasks."""
    banded = members.withColumn("band", band("n"))
    counts = banded.groupBy("leader", "band").agg(F.count(F.lit(1)).alias("all"), F.count_if("outsider").alias("out"))
    mixed = counts.groupBy(F.col("leader").alias("of")).agg(F.sum("out").alias("outs"), F.sum("all").alias("alls")).where("outs > 0 AND alls > 1").select("of")
    needed = counts.join(mixed, F.col("leader") == F.col("of"), "left_semi")
    parts = settle(needed.select("leader", "band", F.ceil(F.col("all") / SIDE).cast("int").alias("n_to"), F.ceil(F.col("out") / SIDE).cast("int").alias("n_from")), "parts")
    known = banded.join(sized(parts), ["leader", "band"])
    slot = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    held = F.collect_list(F.struct("doc_id", "n", "c", "beyond", "outsider", "mask"))
    from_ = known.where("outsider").groupBy("leader", "band", slot("n_from").alias("x")).agg(held.alias("from"))
    to = known.groupBy("leader", F.col("band").alias("to_band"), slot("n_to").alias("y")).agg(held.alias("to"))
    aims = from_.join(sized(parts.select("leader", F.col("band").alias("to_band"), "n_to")), "leader").where("abs(band - to_band) <= 1")
    spread = aims.select("leader", "to_band", "from", F.explode(F.sequence(F.lit(0), F.col("n_to") - 1)).alias("y"))
    return spread.join(to, ["leader", "to_band", "y"]).select("from", "to").mapInArrow(_compare, "a bigint, b bigint")


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id (the key as a long), n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    summary = settle(slim.mapInArrow(_summaries, "doc_id bigint, n_shingles bigint, set_id bigint, need bigint"), "sets")
    grouped = summary.where("set_id IS NOT NULL").groupBy("set_id", "n_shingles", "need").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    classes = settle(grouped, "classes")

    # 2. survivors, by a part of the shingles, then by all of them
    buckets = BUCKETS_PER_PARTITION * partitions_of(spark)
    tally = tallied(slim.select("t").mapInArrow(_emit(buckets), "bucket bigint, body binary"), "tally")
    keyed = classes.where("doc_id IS NOT NULL").withColumn("key", F.col("set_id").bitwiseAND(F.lit(int(_ID))))
    left = settle(keyed.join(shared_counts(tally), "key").where("shared >= need").select("doc_id").distinct(), "survivors")
    keys, levels = frequencies(tally)
    chosen = slim.join(sized(left), "doc_id", "left_semi")
    every = settle(chosen.mapInArrow(_sets, "doc_id bigint, n bigint, key bigint, packed binary"), "packed")
    exact = tallied(every.select("packed").mapInArrow(_emit_all(buckets), "bucket bigint, body binary"), "exact")
    # reach: the shingles of a set that any other one has
    reaching = every.join(sized(settle(shared_counts(exact), "reach")), "key").where("4 * shared >= 3 * n")
    # repeated rows of one document give one entry
    packed = settle(reaching.select("doc_id", "n", F.col("shared").alias("reach"), "packed").dropDuplicates(["doc_id", "packed"]), "index")
    listed = packed.mapInArrow(_lists(keys, levels), "doc_id bigint, n bigint, reach bigint, prefix array<bigint>, narrow bigint, ordered boolean")
    spread = listed.select("doc_id", "n", "reach", "narrow", "ordered", F.posexplode("prefix").alias("pos", "h"))
    # left: the set's shingles from this one on, in the order of all shingles
    left_over = (F.col("n") - F.when(F.col("ordered"), F.col("pos")).otherwise(0)).alias("left")
    entries = settle(spread.select("doc_id", "n", "reach", "h", (F.col("pos") < F.col("narrow")).alias("narrow"), left_over, band("n").alias("band")), "entries")

    # 4. leaders: the set of a block (hash, size band) that others share most of, from aggregated rows
    central = F.struct((F.col("reach") / F.col("n")).alias("share"), (-F.col("doc_id")).alias("first"))
    heads = entries.groupBy("h", "band").agg(F.max_by("doc_id", central).alias("a"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    heads = heads.where("low < high").select("h", "band", "a")
    votes = entries.join(heads, ["h", "band"]).where("doc_id <> a").groupBy(F.col("doc_id").alias("b"), "a").agg(F.count(F.lit(1)).alias("votes"))
    stars = votes.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a"))
    known = settle(verified(stars, packed), "stars")
    links = settle(linked(known), "links")
    parts = components(links)

    # 5. pairs of sets in different components, of lists that hold several
    # (an id with several sets has no leader here, and so no bound)
    led = known.groupBy(F.col("b").alias("doc_id")).agg(F.first("a").alias("leader"), F.first("n_b").alias("n"), F.first("shared").alias("common"), F.first("mask").alias("mask"), F.count(F.lit(1)).alias("sets")).where("sets = 1").drop("sets")
    where = settle(parts.withColumnRenamed("node", "doc_id").join(led, "doc_id", "full_outer"), "where")
    labelled = entries.join(where.select("doc_id", "component", "leader"), "doc_id", "left").select("h", "band", "doc_id", "n", "reach", "narrow", "left", F.coalesce("component", "doc_id").alias("c"), F.coalesce("leader", "doc_id").alias("leader"))
    mixed_lists = labelled.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h")
    open_ = settle(labelled.join(mixed_lists, "h", "left_semi"), "open")
    side = lambda s: open_.select("h", "band", *(F.col(c).alias(f"{c}_{s}") for c in open_.columns if c not in ("h", "band")))
    # different leaders: the smaller one is found by its narrow prefix, in the list's blocks of its own
    # and the next band; what others have and, at the first common shingle, what is left must suffice
    one = side("a").where("narrow_a").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    two = side("b")
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("doc_id_a") < F.col("doc_id_b"))
    enough = 175 * F.least("reach_a", "reach_b", "left_a", "left_b") >= 75 * (F.col("n_a") + F.col("n_b"))
    near = smaller & (4 * F.col("n_a") >= 3 * F.col("n_b")) & enough
    fits = (one["h"] == two["h"]) & (one["band"] == two["band"]) & (F.col("c_a") != F.col("c_b")) & (F.col("leader_a") != F.col("leader_b")) & near
    asked = settle(one.join(two, fits).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct(), "asked")
    # one leader: what they have of it is compared bit by bit
    reach = packed.groupBy("doc_id").agg(F.max("reach").alias("reach"))
    home = where.select(F.col("doc_id").alias("leader"), F.col("component").alias("home"))
    placed = where.where("leader IS NOT NULL").drop("component").join(where.select("doc_id", F.coalesce("component", "doc_id").alias("c")), "doc_id").join(reach, "doc_id").join(home, "leader", "left")
    members = placed.select("leader", "doc_id", "n", "c", F.greatest(F.col("reach") - F.col("common"), F.lit(0)).alias("beyond"), "mask", (F.col("c") != F.coalesce("home", "leader")).alias("outsider"))
    alike = settle(same_leader(members), "alike")
    more = settle(linked(verified(asked.unionByName(alike).distinct(), packed)), "more")
    joined = settle(components(links.unionByName(more)), "components")

    # back to the rows: equal sets, then components
    many = classes.where("copies > 1").select("set_id", "n_shingles", F.col("doc_id").alias("first"))
    placed = summary.join(sized(many), ["set_id", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("node"))
    moved = joined.where("node <> component")
    return placed.join(sized(moved), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(ws[k + 1 : k + 5], ' ') AS s FROM (SELECT r, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS k FROM docs WHERE len(ws) > 0)),
sets AS (SELECT r, count(*) AS n, md5(string_agg(s, '  ' ORDER BY s)) AS id FROM shingles GROUP BY r),
classes AS (SELECT id, min(r) AS r, any_value(n) AS n FROM sets GROUP BY id),
own AS (SELECT c.r, c.n, s FROM classes c JOIN shingles USING (r)),
pairs AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM own a JOIN own b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 75 * (na + nb - i)),
nodes AS (SELECT s.r, c.r AS class, doc_id FROM sets s JOIN classes c USING (id) JOIN docs ON docs.r = s.r),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT x.class, y.class FROM nodes x JOIN nodes y ON x.doc_id = y.doc_id AND x.class <> y.class),
reach AS (SELECT r AS a, r AS b FROM classes UNION SELECT reach.a, steps.b FROM reach JOIN steps ON reach.b = steps.a),
least AS (SELECT reach.a AS class, min(doc_id) AS component_id FROM reach JOIN nodes ON nodes.class = reach.b GROUP BY 1)
SELECT docs.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(least.component_id, docs.doc_id) AS component_id
FROM docs LEFT JOIN sets USING (r) LEFT JOIN nodes USING (r) LEFT JOIN least ON least.class = nodes.class
"""
