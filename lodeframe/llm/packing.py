"""Packing documents into sequences of a fixed number of tokens.

A document's tokens are cut only if they exceed a sequence: all pieces but the first are then full,
and a full piece is a sequence of its own. What remains is bin packing over the short pieces, whose
lengths are integers below the sequence length: the instance is a histogram with at most 1023 cells,
however many documents there are. On the histogram, Martello-Toth dominance fixes bins that some
optimal packing contains (an item alone when nothing fits beside it, an exact pair, the largest
partner when no two others together beat it), repeatedly, and best-fit decreasing packs the rest.
The plan is a list of bin patterns with multiplicities; a piece finds its place from its length and
its rank among pieces of that length, which comes from counts per task, so no group is gathered.

Null and empty texts are a single end token; repeated rows are packed once each; an empty table
gives no piece; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import itertools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, ship, sized, table, tidy

SEQUENCE = 1024
END = 2

# --- the plan -------------------------------------------------------------------------------


@dataclass
class Pattern:
    """Bins with the same content: (length, copies) in order of placement."""

    items: list[tuple[int, int]]
    times: int


@dataclass
class Instance:
    counts: dict[int, int]
    size: int
    patterns: list[Pattern] = field(default_factory=list)

    def take(self, items: list[tuple[int, int]], times: int) -> None:
        for length, copies in items:
            self.counts[length] -= copies * times
            if not self.counts[length]:
                del self.counts[length]
        self.patterns.append(Pattern(items, times))


def reduce_dominated(x: Instance) -> None:
    """Fix the bins of the largest items for as long as dominance decides them, then go to the next
    smaller largest item; items that it can't decide stay for best fit."""
    kept: dict[int, int] = {}
    while x.counts:
        lengths = sorted(x.counts)
        top, low = lengths[-1], lengths[0]
        rest = x.size - top
        fits = lengths[: bisect.bisect_right(lengths, rest)]
        if not fits and not any(k <= rest for k in kept):
            x.take([(top, 1)], x.counts[top])  # nothing fits beside it
            continue
        partner = fits[-1] if fits else 0
        others = sorted(fits + [k for k in kept if k <= rest])
        exact = partner == rest
        # items beside top: no two of them fit, so that the largest one dominates
        pairs_never_fit = bool(others) and _two_smallest(others, x.counts, kept, top) > rest and partner == others[-1]
        if partner and (exact or pairs_never_fit or _pairs_dominated(others, x.counts, kept, top, partner, rest)):
            if partner == top:
                times = x.counts[top] // 2
                if times:
                    x.take([(top, 2)], times)
                    continue
            else:
                x.take([(top, 1), (partner, 1)], min(x.counts[top], x.counts[partner]))
                continue
        kept[top] = x.counts.pop(top)
        if low == top:
            break
    for length, n in kept.items():
        x.counts[length] = x.counts.get(length, 0) + n


def _copies(length: int, counts: dict[int, int], kept: dict[int, int], top: int) -> int:
    return counts.get(length, 0) + kept.get(length, 0) - (length == top)


def _two_smallest(others: list[int], counts: dict[int, int], kept: dict[int, int], top: int) -> int:
    small = [k for k in others[:3] for _ in range(min(2, _copies(k, counts, kept, top)))][:2]
    return sum(small) if len(small) == 2 else 1 << 30


def _pairs_dominated(others: list[int], counts: dict[int, int], kept: dict[int, int], top: int, partner: int, rest: int) -> bool:
    """True if at most two others fit beside top and no fitting two weigh more than its partner."""
    small = [k for k in others[:4] for _ in range(min(3, _copies(k, counts, kept, top)))][:3]
    if partner != others[-1] or len(small) == 3 and sum(small) <= rest:
        return False
    best, j = 0, len(others) - 1
    for i, a in enumerate(others):
        while j >= 0 and others[j] + a > rest:
            j -= 1
        if j < 0:
            break
        b = others[j]
        if j < i:
            break
        if a == b and _copies(a, counts, kept, top) < 2:
            b = others[j - 1] if j - 1 >= i else 0
            if not b:
                continue
        best = max(best, a + b)
    return best <= partner


def best_fit(x: Instance) -> None:
    """Best-fit decreasing over all that is left, for whole groups of equal bins at a time."""
    spare: dict[int, list[Pattern]] = {}
    order: list[int] = []  # the spare room of open bins, ascending

    def put(p: Pattern, room: int) -> None:
        if room not in spare:
            spare[room] = []
            bisect.insort(order, room)
        spare[room].append(p)

    for length in sorted(x.counts, reverse=True):
        left = x.counts.pop(length)
        while left:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                each = x.size // length
                if left >= each:
                    put(Pattern([(length, each)], left // each), x.size - each * length)
                if left % each:
                    put(Pattern([(length, left % each)], 1), x.size - left % each * length)
                break
            room = order[i]
            p = spare[room].pop()
            if not spare[room]:
                del spare[room]
                order.pop(i)
            each = room // length
            full, odd = min(p.times, left // each), 0
            if full < p.times and left - full * each > 0:
                odd = min(each, left - full * each)
            if full:
                put(Pattern([*p.items, (length, each)], full), room - each * length)
            if odd:
                put(Pattern([*p.items, (length, odd)], 1), room - odd * length)
            if p.times - full - bool(odd):
                put(Pattern(p.items, p.times - full - bool(odd)), room)
            left -= full * each + odd
    x.patterns.extend(p for room in order for p in spare[room])


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[Pattern]:
    x = Instance({k: n for k, n in counts.items() if n}, size)
    reduce_dominated(x)
    best_fit(x)
    return x.patterns


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first bin, copies in a bin, offset of the first copy)."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for p in patterns:
        offset = 0
        for length, copies in p.items:
            found.setdefault(length, []).append((ranks.get(length, 0), base, copies, offset))
            ranks[length] = ranks.get(length, 0) + copies * p.times
            offset += length * copies
        base += p.times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


# --- tokens ---------------------------------------------------------------------------------

_CODERS: dict[str, object] = {}


def fast_vocabulary(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a ``tokenizers`` file whose ids tiktoken must give too, else None.

    That is so for plain byte-level BPE (nothing normalised, dropped, marked or guessed) in which every
    vocabulary entry is a byte or the result of a merge and merges come in the order of their results' ids:
    then the next merge is the pair whose result has the least id, which is tiktoken's rule."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [spec.get("normalizer"), spec.get("truncation"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk"))]
    if model.get("type") != "BPE" or any(odd) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single = {i for t, i in vocab.items() if len(t) == 1}
    if None in made or any(a >= b for a, b in itertools.pairwise(made)) or len(single) != 256 or single | set(made) != set(vocab.values()):
        return None
    return {bytes(shown[c] for c in t): i for t, i in vocab.items()}


class Coder:
    """The ids of a file of ``tokenizers``.

    Where ``fast_vocabulary`` proves that tiktoken gives the same ids, it does so, several times faster; a
    text that holds one of the file's special tokens, and any text for other files, goes to ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = fast_vocabulary(spec)
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.path, self.exact = path, None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- Spark ----------------------------------------------------------------------------------

PIECE = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
PIECE_SQL = "piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def _cut(path: str | None, key: str, size: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path or default_path())
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        end = np.array([END], np.uint32)
        for batch in batches:
            owner, rows, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.concatenate([code.ids(text or ""), end]).astype("<u4")
                first = len(tokens) % size or size
                edges = [0, *range(first, len(tokens) + 1, size)]
                for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    piece = tokens[a:b]
                    owner.append(i)
                    rows.append((n, a, b - a, zlib.crc32(piece.tobytes()), task, int(seen[b - a])))
                    seen[b - a] += 1
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
            columns += [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(PIECE)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, *PIECE.names, *(["ids"] if with_ids else [])])
        tidy()

    return cut


def _place(found: dict[int, np.ndarray], size: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank, task, nth = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank", "task", "nth"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            full = length == size
            sequence[full] = 2 * ((task[full].astype(np.int64) << 40) + nth[full]) + 1
            for n in np.unique(length[~full]):
                at = np.flatnonzero(length == n)
                rows = found[int(n)]
                r = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                within = rank[at] - r[:, 0]
                sequence[at] = 2 * (r[:, 1] + within // r[:, 2])
                offset[at] = r[:, 3] + within % r[:, 2] * n
            keep = [c for c in names if c not in ("task", "nth", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, [ids], sequence_id, offset."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(key), F.col(text).alias(f"{key}_text"))
    kind = slim.schema[key].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    pieces = settle(slim.mapInArrow(_cut(path, key, size, with_ids), f"`{key}` {kind}, {PIECE_SQL}{more}"), "pieces")
    # the rank of a piece among those of its length: its number in its task, after the earlier tasks
    counts = pieces.where(F.col("length") < size).groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts, "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # at most one row for each length below the sequence length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = places(plan(histogram, size))
    ranked = pieces.join(sized(earlier), ["length", "task"], "left").withColumn("rank", F.col("nth") + F.coalesce("earlier", F.lit(0))).drop("earlier")
    ids = ["ids"] if with_ids else []
    ordered = ranked.select(key, "piece", "start", "length", "ids_crc32", *ids, "task", "nth", "rank")
    return ordered.mapInArrow(_place(found, size), f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}, sequence_id bigint, offset bigint")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
