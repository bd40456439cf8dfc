"""Substring dedup: windows of words that start in an earlier document are cut out.

Super-k-mer partitioning: consecutive windows of a document that share a minimiser (the least hash
of the MINIMISER-word sequences inside) travel as one packed string to the minimiser's bucket, some
three words per window instead of a whole window each. In a bucket all windows are hashed and
sorted, which gives each one's least document exactly (by 128-bit hashes); windows of later
documents become intervals of words to cut.

A string that a task has met before in a document with a smaller id is decided at once and does not
travel: what many documents share reaches its bucket about once per task, not once per document.
Buckets are some times as many as shuffle partitions; a task holds one bucket's packed strings and sorts
at most MAX_WINDOWS of its windows at once (a bucket that a frequent minimiser fills is sorted in parts). The
intervals return to the documents as one packed row per cut document: broadcast if counted to be small,
else by a shuffled join.

Null and empty texts have no words; a null id is never earlier than another one, and its text stays
whole; rows that share an id are one document (they don't cut each other, and what is cut from one
is cut from all); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle, ship, table, tidy
from .wordhash import Block, blocks, sliding_min, windows

SIZE = 13
MINIMISER = 4
BUCKETS_PER_PARTITION = 4
#: Windows that a task sorts at once; a bucket with more is sorted in parts, by the windows' hashes.
MAX_WINDOWS = 3_000_000
#: Strings that a task remembers, with their least document, to decide later ones at once.
REMEMBER = 200_000
#: Bytes of intervals that are broadcast at the most.
BROADCAST_BYTES = 32 << 20


def runs(group: list[tuple[int, int, list[bytes]]], size: int, minimiser: int) -> tuple[bytes, list[np.ndarray]]:
    """Super-k-mers of a block: its body, and arrays (part, first word in part, first byte, end byte, minimiser)."""
    block = Block(b" ".join(b" ".join(part) for _, _, part in group))
    counts = np.array([len(part) for _, _, part in group])
    first = np.cumsum(counts) - counts
    part_of = np.repeat(np.arange(len(group)), counts)
    least = sliding_min(windows(block.words(), minimiser), size - minimiser + 1)
    n = len(least)
    if not n:
        return block.body, [np.zeros(0, np.int64)] * 5
    valid = part_of[:n] == part_of[size - 1 : size - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (part_of[1:n] != part_of[: n - 1]) | ~valid[:-1]
    a = np.flatnonzero(new & valid)
    edge = np.flatnonzero(new | ~valid)
    b = np.append(edge, n)[np.searchsorted(edge, a) + 1]  # the run's last window is b - 1
    part = part_of[a]
    return block.body, [part, a - first[part], block.starts[a], block.ends[b - 1 + size - 1], least[a]]


def joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _deal(n_buckets: int, size: int, minimiser: int):
    """Map side: documents to rows (bucket, packed super-k-mers, intervals decided here)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        remembered: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw = batch.column(1).cast(pa.binary())
            order = sorted((i for i, d in enumerate(ids) if d is not None), key=lambda i: ids[i])
            texts = ((ids[i], (raw[i].as_py() or b"").split()) for i in order)
            for group in blocks(texts, size - 1):
                body, (part, first, start, end, least) = runs(group, size, minimiser)
                docs = [group[p][0] for p in part.tolist()]
                at = (first + np.array([g[1] for g in group], np.int64)[part]).tolist() if len(part) else []
                seen: dict[bytes, int] = {}
                decided: dict[int, list[tuple[int, int]]] = {}
                travel, strings = [], []
                for k, (doc, a, s, e) in enumerate(zip(docs, at, start.tolist(), end.tolist(), strict=True)):
                    text = body[s:e]
                    earlier = remembered.get(text)
                    if earlier is None:
                        earlier = seen.setdefault(text, doc)
                        if earlier != doc and len(remembered) < REMEMBER:
                            remembered[text] = earlier
                    elif doc < earlier:
                        remembered[text] = doc
                    if earlier < doc:
                        decided.setdefault(doc, []).append((a, a + text.count(b" ") + 1))
                    else:
                        travel.append(k)
                        strings.append(text)
                yield from _packed(press, n_buckets, size, travel, strings, docs, at, least, decided)
        tidy()

    return deal


def _packed(press, n_buckets, size, travel, strings, docs, at, least, decided) -> Iterator[pa.RecordBatch]:
    bucket = (least[travel] % np.uint64(n_buckets)).astype(np.int64) if travel else np.zeros(0, np.int64)
    order = np.argsort(bucket, kind="stable").tolist()
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
    rows, counts, bodies, forwards = [], [], [], []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[a:b]
        head = np.array([[docs[travel[k]], at[travel[k]]] for k in own], np.int64)
        rows.append(int(bucket[own[0]]))
        counts.append(sum(strings[k].count(b" ") for k in own) - (size - 2) * len(own))
        bodies.append(press.compress(np.int64(len(own)).tobytes() + head.T.copy().tobytes() + b"\n".join(strings[k] for k in own)))
        forwards.append(None)
    flat = [(doc, a, b) for doc, found in decided.items() for a, b in joined(found)]
    if flat:
        rows.append(int(flat[0][0]) % n_buckets)
        counts.append(0)
        bodies.append(None)
        forwards.append(press.compress(np.array(flat, np.int64).tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary()), pa.array(forwards, pa.binary())], names=["bucket", "windows", "body", "decided"])


DEALT = "bucket bigint, windows bigint, body binary, decided binary"
CUT = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])


def later_windows(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions of the windows whose sequence also starts in a document with a smaller id."""
    order = np.argsort(h1)
    if not len(order):
        return order
    same = h1[order][1:] == h1[order][:-1]
    some = order[np.append(same, False) | np.insert(same, 0, False)]
    some = some[np.lexsort((doc[some], h2[some], h1[some]))]
    if not len(some):
        return some
    new = np.ones(len(some), bool)
    new[1:] = (h1[some[1:]] != h1[some[:-1]]) | (h2[some[1:]] != h2[some[:-1]])
    least = doc[some[np.flatnonzero(new)]][np.cumsum(new) - 1]
    return some[doc[some] > least]


def _sort(size: int):
    """Bucket side: sort the windows of one bucket after the other, at most MAX_WINDOWS at once."""

    def emit(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(end)], schema=CUT)

    def unpacked(packed: bytes) -> tuple[np.ndarray, ...]:
        """Two hashes, document and place of every window of a body."""
        n = int(np.frombuffer(packed, np.int64, 1)[0])
        doc, at = np.frombuffer(packed, np.int64, 2 * n, 8).reshape(2, n)
        block = Block(packed[8 + 16 * n :])
        breaks = np.searchsorted(block.ends, np.append(np.flatnonzero(block.bytes == 10), len(block.body)))
        count = np.diff(breaks, prepend=-1)
        run_of = np.repeat(np.arange(n), count)
        within = np.arange(len(run_of)) - np.repeat(np.cumsum(count) - count, count)
        m = len(run_of) - size + 1
        inside = np.flatnonzero(run_of[:m] == run_of[size - 1 :])
        run = run_of[inside]
        return windows(block.words(0), size, 0)[inside], windows(block.words(1), size, 1)[inside], doc[run], (at[run] + within[inside]).astype(np.int32)

    def decided_here(bodies: list[bytes], n_windows: int, press) -> Iterator[pa.RecordBatch]:
        n_parts = max(1, -(-n_windows // MAX_WINDOWS))
        for k in range(n_parts):
            parts = []
            for body in bodies:
                found = unpacked(press.decompress(body))
                own = found[0] % np.uint64(n_parts) == k
                parts.append(found if n_parts == 1 else tuple(x[own] for x in found))
            h1, h2, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            late = later_windows(h1, h2, doc)
            doc, at = doc[late], at[late].astype(np.int64)
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            if not len(doc):
                continue
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + size)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(doc)) - 1
            for i in range(0, len(a), 100_000):
                yield emit(doc[a[i : i + 100_000]], at[a[i : i + 100_000]], at[b[i : i + 100_000]] + size)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        now, held, n_windows = None, [], 0
        for batch in batches:
            for bucket, more, body, decided in zip(*(batch.column(i) for i in range(4)), strict=True):
                if decided.is_valid:
                    flat = np.frombuffer(press.decompress(decided.as_py()), np.int64).reshape(-1, 3)
                    yield emit(flat[:, 0].copy(), flat[:, 1].copy(), flat[:, 2].copy())
                if not body.is_valid:
                    continue
                if bucket.as_py() != now and held:
                    yield from decided_here(held, n_windows, press)
                    held, n_windows = [], 0
                now = bucket.as_py()
                held.append(body.as_py())
                n_windows += more.as_py()
        if held:
            yield from decided_here(held, n_windows, press)

    return sort


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.array(joined([(x["first"], x["end"]) for x in found]), np.int64).tobytes() for found in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "cuts"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for raw, cuts in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            own = (raw.as_py() or b"").split()
            n_words.append(len(own))
            left, last = own, 0
            if cuts.is_valid:
                left = []
                for a, b in np.frombuffer(cuts.as_py(), np.int64).reshape(-1, 2).tolist():
                    left += own[last:a]
                    last = b
                left += own[last:]
            n_removed.append(len(own) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, minimiser: int = MINIMISER) -> DataFrame:
    """Per document row: doc_id (the key as a long), n_words, n_removed and kept, the words left."""
    spark = docs.sparkSession
    ship(spark)
    partitions = 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    dealt = slim.mapInArrow(_deal(BUCKETS_PER_PARTITION * partitions, size, minimiser), DEALT)
    found = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort(size), "doc_id bigint, first bigint, end bigint")
    grouped = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("found"))
    cuts = settle(grouped.mapInArrow(_merge, "doc_id bigint, cuts binary"), "cuts")
    extent = cuts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("cuts")).alias("bytes")).first()
    if extent["rows"] <= BROADCAST_ROWS and (extent["bytes"] or 0) <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    both = slim.join(cuts, "doc_id", "left").select("doc_id", "t", "cuts")
    return both.mapInArrow(_apply, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cut_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
spread AS (SELECT doc_id, k, array_to_string(ws[k + 1 : k + SIZE_], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - SIZE_ + 1)) AS k FROM docs WHERE len(ws) >= SIZE_ AND doc_id IS NOT NULL)),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY w) AS first FROM spread) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + SIZE_)) AS p FROM late),
words AS (SELECT r, doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
""".replace("SIZE_", str(SIZE))
