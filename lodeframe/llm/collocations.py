"""Phrase collocations: word runs that occur far more often than their parts would have it.

Two passes over the texts. The first counts words and the hashes of word pairs, which gives each language's
number of words, its frequent words and a table of bits of its frequent pairs (of a bounded size: a pair that
is not frequent may slip in, none that is can be missing). The second cuts pieces into runs whose pairs are all in that
table, as a phrase of at least MIN_COUNT occurrences has only such pairs; of the runs of some SHARD_BYTES of
text each task builds a generalised suffix automaton, whose end position counts are the shard's counts of all
phrases of at most DEPTH words, and these are summed over all shards. Words of different languages
are different letters of the automaton.

What a phrase contains are the suffixes of its prefixes, which is where suffix links lead; each of those with at least two words
learns the count of the most frequent longer phrase that holds it and goes if it has little occurrence
of its own. Ranks are limited in every task before they are shuffled.

A null language is ``und``; a null or empty text has no words; repeated rows count as often as they are
there; ties in score and count go to the smaller phrase in UTF-8 byte order; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import settle, ship, table, tidy
from .wordhash import mixed

DEPTH, MIN_COUNT, TOP = 4, 30, 2000
#: A candidate goes if some longer one has so many of a hundred of its occurrences.
WITHIN = 80
#: Bytes of text in one automaton, and rows of counts that leave a task at once.
SHARD_BYTES, ROWS = 2_000_000, 50_000
#: The table of frequent pairs has some 16 bits for each, and no more than so many in all (8 MB); beyond that
#: more pairs slip in, to be counted in vain.
MAX_BITS = 1 << 26

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class Words:
    """The words of some texts: ``word`` (a number for each language and word), ``piece``, and what the numbers stand for."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        body = b"\n".join(t.translate(_FOLD) for t in texts)
        raw = np.frombuffer(body, np.uint8)
        inside = (raw != 32) & (raw != 10)
        begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(raw) else np.zeros(0, np.int64)
        self.piece = np.cumsum(raw == 10)[begins]
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        text = np.searchsorted(ends, begins, side="right")
        names = pa.array(langs, pa.string()).dictionary_encode()
        self.langs = names.dictionary
        spelt = pa.array(body.split(), pa.binary()).dictionary_encode()
        size = max(len(spelt.dictionary), 1)
        numbers, self.word, self.count = np.unique(names.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64) * size + spelt.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        self.lang, self.spelt = numbers // size, spelt.dictionary.take(pa.array(numbers % size))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words' positions of all pairs within pieces, each one's number, and the hash of each number."""
        at = np.flatnonzero(self.piece[1:] == self.piece[:-1])
        n = max(len(self.lang), 1)
        kinds, number = np.unique(self.word[at] * n + self.word[at + 1], return_inverse=True)
        tags = [s.encode() + b"\0" for s in self.langs.to_pylist()]
        own = np.array([xxhash.xxh3_64_intdigest(tags[k] + w) for k, w in zip(self.lang.tolist(), self.spelt.to_pylist(), strict=True)], np.uint64)
        return at, number, mixed(own[kinds // n] * _FACTORS[0] + own[kinds % n] * _FACTORS[1])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            texts.append(text.as_py())
            langs.append(lang)
            size += len(texts[-1])
            if size >= SHARD_BYTES:
                own = Words(texts, langs)
                texts, langs, size = [], [], 0
                yield own
                del own
                tidy()
    if texts:
        yield Words(texts, langs)
    tidy()


def _slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), ROWS):
        yield rows.slice(k, ROWS)


def _rows(lang: pa.Array, pair: np.ndarray | None, word: pa.Array | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    pair_ = pa.nulls(len(lang), pa.int64()) if pair is None else pa.array(pair.view(np.int64))
    word_ = pa.nulls(len(lang), pa.string()) if word is None else word.cast(pa.string())
    yield from _slices(pa.RecordBatch.from_arrays([lang, pair_, word_, pa.array(n.astype(np.int64))], names=["lang", "pair", "word", "n"]))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, pair, word, n): counts of words, of pairs' hashes, and of all words (both null)."""
    for own in _shards(batches):
        total = np.bincount(own.lang, own.count, len(own.langs)) if len(own.lang) else np.zeros(len(own.langs))
        yield from _rows(own.langs, None, None, total)
        yield from _rows(own.langs.take(pa.array(own.lang)), None, own.spelt, own.count)
        at, number, hashes = own.pairs()
        lang = np.zeros(len(hashes), np.int64)
        lang[number] = own.lang[own.word[at]]
        yield from _rows(own.langs.take(pa.array(lang)), hashes, None, np.bincount(number, minlength=len(hashes)))


def _second(table_, depth: int):
    """(lang, phrase, n): counts of phrases of at least two words in runs of pairs that the table has."""

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table_.value
        for own in _shards(batches):
            at, number, hashes = own.pairs()
            good = at[_held(bits, hashes)[number]]
            if not len(good):
                continue
            follows = np.zeros(len(own.word) + 1, bool)  # a word is one run with the word before
            follows[good + 1] = True
            keep = np.flatnonzero(follows[:-1] | follows[1:])
            run = np.cumsum(~follows[:-1])[keep]
            for path, state in (found := Automaton(own.word[keep], run, len(own.lang), depth)).substrings():
                if path.shape[1] < 2:
                    continue
                lang = own.langs.take(pa.array(own.lang[path[:, 0]]))
                parts = [own.spelt.take(pa.array(path[:, k])) for k in range(path.shape[1])]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
                yield from _slices(pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(found.count[state])], names=["lang", "phrase", "n"]))

    return second


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(hashes), bool)
    for h in (hashes, hashes >> np.uint64(32)):
        place = h & mask
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def pair_table(pairs: DataFrame) -> np.ndarray:
    """A table of bits in which both places of every pair's hash are set: at most MAX_BITS, whatever the input."""
    n = 1 << 12
    wanted = 16 * pairs.count()
    while n < min(wanted, MAX_BITS):
        n *= 2
    places = F.array(F.col("pair").bitwiseAND(F.lit(n - 1)), F.shiftrightunsigned("pair", 32).bitwiseAND(F.lit(n - 1)))
    one = pairs.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int")).alias("bit"))
    bits = np.zeros(n // 64, np.uint64)
    found = one.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def _parts(ws: Column, n: int) -> Column:
    """All runs of n words."""
    return F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda k: F.array_join(F.slice(ws, k, F.lit(n)), " "))


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = DEPTH, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Candidates (lang, phrase, a), and the counts of frequent words with each language's number of words
    (lang, word, n; word is null for the latter)."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("t"))
    first = slim.mapInArrow(_first, "lang string, pair bigint, word string, n bigint").groupBy("lang", "pair", "word").agg(F.sum("n").alias("n"))
    counts = settle(first.where((F.col("n") >= least) | (F.col("pair").isNull() & F.col("word").isNull())), "counts")
    shared = spark.sparkContext.broadcast(pair_table(counts.where("pair IS NOT NULL").select("pair")))
    found = slim.mapInArrow(_second(shared, depth), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return settle(found, "phrases"), counts.where("pair IS NULL").select("lang", "word", "n")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each candidate, at its lowest-scoring cut."""
    every = candidates.select("lang", "phrase", F.col("a").alias("f")).unionByName(counts.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    ws = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", "a", ws.alias("ws"), F.explode(F.sequence(F.lit(1), F.size(ws) - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")), " ").alias("right"))
    l, r = (every.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    both = cut.join(l, ["lang", "left"]).join(r, ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(28,0)) * 2000000) div (CAST(l AS DECIMAL(28,0)) + r)")
    low = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    totals = counts.where("word IS NULL").select("lang", "n")
    return low.select("lang", "phrase", "a", "low.l", "low.r", "low.score").join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def independent(candidates: DataFrame, depth: int = DEPTH, within: int = WITHIN) -> DataFrame:
    """Candidates without those that mostly occur inside a longer one."""
    ws = F.split("phrase", " ")
    inner = F.flatten(F.array(*(F.when(F.size(ws) > n, _parts(ws, n)).otherwise(F.array().cast("array<string>")) for n in range(2, depth))))
    held = candidates.where(F.size(ws) > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    joined = candidates.join(held, ["lang", "phrase"], "left")
    enough = F.col("longer").cast("decimal(28,0)") * 100 >= F.col("a").cast("decimal(28,0)") * within
    return joined.where(~F.coalesce(enough, F.lit(False))).select(*candidates.columns)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = DEPTH, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    candidates, counts = phrases(docs, lang, text, depth, least)
    # parts may be candidates that go: score all, keep some
    kept = independent(scored(candidates, counts), depth)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS k FROM pieces),
counts AS (SELECT lang, m, array_to_string(ws[k : k + m - 1], ' ') AS phrase, count(*) AS f FROM starts, (VALUES (1), (2), (3), (4)) AS v(m) WHERE k + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE m > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS x, array_to_string(ws[k + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM candidates)),
low AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f), k) AS pick
  FROM cuts AS c JOIN counts AS x ON x.lang = c.lang AND x.phrase = c.x JOIN counts AS y ON y.lang = c.lang AND y.phrase = c.y),
inner_ AS (
  SELECT lang, a, array_to_string(ws[k : k + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM (SELECT lang, a, ws, unnest(range(2, len(ws))) AS m FROM candidates))),
held AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT low.*, n FROM low JOIN totals USING (lang) LEFT JOIN held USING (lang, phrase) WHERE pick = 1 AND (longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000
"""
