"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

The automaton's letters are word numbers, not bytes, and it holds each item once: an item's consecutive
blocks of half a window, each of which lies in every window around it. One scan of a document's word
numbers finds all blocks; a found block grows to the longest run that document and item share, and runs
of a window's length or more are hits (an item shorter than a window is a single block and must occur
whole). A block that stands in more than HOT places, as in questions made from one template, is left out: windows
around it have another block, or are in the automaton themselves, once for all items. So a found block meets
at most HOT places, and the automaton has about one node per benchmark word (one per word of a window for those). Hits are
mapped back to code point offsets of the original text.

The scan is a map over the documents, without a shuffle. The benchmark's size is counted before it is
collected and broadcast; beyond MAX_BYTES of text it is dealt to several automata, one after the other on the driver
and in the tasks, whose scans are united per document row (so many scans and one shuffle of the texts).

Null and empty texts have no words and are clean; an item without words has no window; repeated
rows are judged row by row; an empty benchmark leaves every document clean; other columns of the
input are not looked at and pass through ``clean_documents``.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, table, tidy

WINDOW = 10
#: Places of a block that an occurrence is compared with at the most.
HOT = 16
#: Bytes of benchmark text in one automaton: some 5 million nodes, 500 MB in a worker, at the most.
MAX_BYTES = 32 << 20
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")  # after A-Z are lower-cased

_NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: The scanner of this worker process, by name of its items.
_BUILT: dict[str, Scanner] = {}


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class Scanner:
    """The automaton over items (id, text), and the items' word numbers that its blocks grow in.

    Its patterns have places (item, first word) to grow in, or, of whole windows and short items, the items alone."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int = WINDOW) -> None:
        import ahocorasick

        self.size = size
        self.known: dict[bytes, int] = {}
        self.items: list[list[int]] = []
        self.names: list[list[str]] = []
        texts: dict[tuple[int, ...], list[str]] = {}
        for name, text in items:
            own = tuple(self.known.setdefault(w, len(self.known) + 1) for w in words(text))
            if own:
                texts.setdefault(own, []).append(name)
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        whole: dict[tuple[int, ...], list[int]] = {}
        block = (size + 1) // 2
        for own, names in texts.items():
            self.items.append(list(own))
            self.names.append(names)
            if len(own) < size:
                whole.setdefault(own, []).append(len(self.items) - 1)
            else:
                for at in range(0, len(own) - block + 1, block):
                    places.setdefault(own[at : at + block], []).append((len(self.items) - 1, at))
        hot = {b for b, found in places.items() if len(found) > HOT}
        for item, own in enumerate(self.items if hot else []):
            bad = [tuple(own[at : at + block]) in hot for at in range(0, len(own) - block + 1, block)] if len(own) >= size else []
            if any(bad):
                for at in range(len(own) - size + 1):
                    inside = range(-(-at // block), (at + size - block) // block + 1)
                    if all(bad[k] for k in inside):
                        whole.setdefault(tuple(own[at : at + size]), []).append(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for letters in (places.keys() - hot) | whole.keys():
            self.tree.add_word(letters, (len(letters), places.get(letters, []) if letters not in hot else [], letters if letters in whole else None))
        self.whole = whole
        if len(self.tree):
            self.tree.make_automaton()

    def hits(self, own: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Runs of hit words as (first, end) word numbers, and the items whose windows occur."""
        if not own or not self.items:
            return [], []
        known = self.known
        text = tuple([known.get(w, 0) for w in own])
        seen: dict[tuple[int, int], int] = {}  # how far an item's words have been compared, by item and shift
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        met: set[tuple[int, ...]] = set()
        for last, (length, places, letters) in self.tree.iter(text):
            first = last + 1 - length
            if letters is not None:
                found.append((first, last + 1))
                if letters not in met:
                    met.add(letters)
                    items.update(self.whole[letters])
            for item, at in places:
                letters = self.items[item]
                shift = first - at
                if seen.get((item, shift), -1) > last:
                    continue
                a, b = first, last + 1
                while a > 0 and a > shift and letters[a - 1 - shift] == text[a - 1]:
                    a -= 1
                stop = min(len(text), shift + len(letters))
                while b < stop and letters[b - shift] == text[b]:
                    b += 1
                seen[item, shift] = b
                if b - a >= self.size:
                    found.append((a, b))
                    items.add(item)
        names = {n for i in items for n in self.names[i]}
        runs: list[list[int]] = []
        for a, b in sorted(found):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return [tuple(r) for r in runs], sorted(names)


class Items(NamedTuple):
    """Benchmark items (id, text) as the executors get them, one of so many parts."""

    name: str
    rows: Broadcast
    of: int


def scanner(items: Items) -> Scanner:
    if items.name not in _BUILT:
        _BUILT.clear()
        _BUILT[items.name] = Scanner(items.rows.value)
    return _BUILT[items.name]


def original(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code point offsets in the original text of runs of word numbers."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


OUT = "n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _scan(benchmark: Items, key: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(benchmark)
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                text = raw.as_py()
                own = words(text)
                runs, ids = find.hits(own)
                n_words.append(len(own))
                n_hit.append(sum(b - a for a, b in runs))
                spans.append(original(text.decode(), runs) if runs else [])
                items.append(ids)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                names=[key, "n_words", "n_hit", "spans", "items"],
            )

    return scan


def shards(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    """The benchmark's items, in as many parts as MAX_BYTES asks for: its size is counted first. A part comes to the
    driver when it is asked for, and is given up with the next one."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, math.ceil(size / MAX_BYTES))
    context = benchmark.sparkSession.sparkContext
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(item), F.lit(n)) == k) if n > 1 else benchmark
        rows = part.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).collect()
        own = Items(uuid.uuid4().hex, context.broadcast([(r["i"], r["t"].encode() if r["t"] is not None else None) for r in rows]), n)
        del rows
        yield own
        if n > 1:
            own.rows.destroy()


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: ``key``, n_words, n_hit, spans (code points, merged) and items (sorted)."""
    ship(docs.sparkSession)
    parts = shards(benchmark, item, item_text)
    part = next(parts)
    if part.of == 1:
        slim = docs.select(F.col(key), F.col(text).alias(f"{key}_t"))
        kind = slim.schema[key].dataType.simpleString()
        return slim.mapInArrow(_scan(part, key), f"`{key}` {kind}, {OUT}")
    # rows are told apart by position, as keys may repeat; spans of different automata can overlap
    slim = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t")), "scan")
    united = None
    for part in itertools.chain([part], parts):
        one = settle(slim.select("row", "t").mapInArrow(_scan(part, "row"), f"row bigint, {OUT}"), "scanned")
        united = one if united is None else united.unionByName(one)
    grouped = united.groupBy("row").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = slim.join(grouped, "row").select("k", "t", "n_words", "spans", "items")
    kind = joined.schema["k"].dataType.simpleString()
    return joined.mapInArrow(_united(key), f"`{key}` {kind}, {OUT}")


def _united(key: str):
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_hit = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = [m.span() for m in WORD.finditer((text or "").translate(_LOWER))] if found else []
                number = {edge: i for i, (a, b) in enumerate(own) for edge in ((0, a), (1, b))}
                # runs without a word between them are one, as in a single automaton
                runs: list[list[int]] = []
                for a, b in sorted((number[0, s["start"]], number[1, s["end"]] + 1) for s in found):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                spans.append([{"start": own[a][0], "end": own[b - 1][1]} for a, b in runs])
                n_hit.append(sum(b - a for a, b in runs))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_hit, pa.int64()), pa.array(spans, span), batch.column(4)], names=[key, "n_words", "n_hit", "spans", "items"])

    return unite


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without a hit, all columns as they were: one map over the rows for one automaton."""
    ship(docs.sparkSession)
    kept = docs
    for part in shards(benchmark, item, item_text):
        kept = kept.mapInArrow(_drop(part, docs.columns.index(text)), docs.schema)
        if part.of > 1:
            kept = settle(kept, "clean")
    return kept


def _drop(benchmark: Items, at: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(benchmark)
        for batch in batches:
            clean = [not find.hits(words(raw.as_py()))[0] for raw in batch.column(at).cast(pa.binary())]
            yield batch.filter(pa.array(clean, pa.bool_()))
        tidy()

    return drop


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
known AS (SELECT DISTINCT item, n, array_to_string(ws[k + 1 : k + n], ' ') AS w FROM (SELECT item, ws, least(len(ws), WINDOW_) AS n, unnest(range(0, greatest(len(ws) - WINDOW_ + 1, 1))) AS k FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM known),
spread AS (SELECT r, n, k, array_to_string(ws[k + 1 : k + n], ' ') AS w FROM (SELECT r, ws, n, unnest(range(0, len(ws) - n + 1)) AS k FROM docs, sizes WHERE len(ws) >= n)),
hits AS (SELECT r, k, n, item FROM spread JOIN known USING (n, w)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
""".replace("WINDOW_", str(WINDOW))
