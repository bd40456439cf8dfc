"""Resampling, collocations and SimHash against brute force: on the edge tables, on empty ones, and on
inputs made to be hard (long texts, hot signatures, many languages)."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from lodeframe.llm import collocations, registry, resample, simhash
from lodeframe.llm.automaton import Automaton

from .fixtures import empties, tables


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("edges3"))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return empties(spark, tmp_path_factory.mktemp("none3"))


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def duck(sf, sql):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet/*.parquet')")
    return con.sql(sql).fetchall()


# --- resampling -----------------------------------------------------------------------------


def brute_resample(docs, target, percent=5, min_words=20):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
        return len(w), [zlib.crc32(" ".join(w[k : k + m]).encode()) % 10000 for k in range(len(w)) for m in (1, 2, 3) if k + m <= len(w)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for d, text in docs:
        n, g = grams(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in g)
        rows.append([d, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able):
        r.append(k + 1 if k < percent * len(able) // 100 else None)
    return collections.Counter(tuple(r[:4] + [r[5] if len(r) > 5 else None]) for r in rows)


def test_op11(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, sf)]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = collections.Counter(map(tuple, registry.QUERIES["op11_resample"](spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()))
    assert got == brute_resample(docs, target)
    assert got == collections.Counter(duck(sf, f"SELECT doc_id, n_features, weight, score, rank FROM ({registry.ORACLES['op11_resample']})"))


def test_resample_cuts_long_texts(spark, monkeypatch):
    """Chunks with carried words give the sums of whole texts; repeated long rows stay apart; ids of another type."""
    monkeypatch.setattr(resample, "LONG_BYTES", 300)
    monkeypatch.setattr(resample, "CHUNK", 7)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Aa", "bé", "c1", "dd-e", "x" * 70, "Ç"]) for _ in range(rng.choice([0, 3, 25, 400]))) for _ in range(60)]
    rows = [(f"k{i}", t, 1) for i, t in enumerate(texts)] + [("k0", texts[0], 1), ("k1", texts[1], 1), ("k1", texts[2], 1), (None, None, 1), ("k9", "-" * 1000, 1)]
    target = [texts[5], "bé c1 other words", None]
    docs = spark.createDataFrame(rows, "doc_id string, text string, weight int").repartition(4)
    found = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    got = collections.Counter(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect()))
    assert got == brute_resample([r[:2] for r in rows], target, percent=30)


def test_checksums_move_on():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 63, 64, 200):
        a, b = rng.bytes(9), rng.bytes(n)
        assert int(resample.moved(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_op11_on_no_rows(spark, none):
    assert registry.QUERIES["op11_resample"](spark, none).count() == 0


# --- collocations ---------------------------------------------------------------------------


def runs_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\n-\r]", fold(text))]


def brute_collocations(docs, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for ws in runs_of(text):
            n[lang] += len(ws)
            f.update((lang, tuple(ws[k : k + m])) for k in range(len(ws)) for m in (1, 2, 3, 4) if k + m <= len(ws))
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    longest = collections.Counter()
    for (lang, p), a in candidates.items():
        for k, m in itertools.product(range(len(p)), range(2, len(p))):
            if k + m <= len(p):
                longest[lang, p[k : k + m]] = max(longest[lang, p[k : k + m]], a)
    rows = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * longest[lang, p] < 80 * a:
            score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])}


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_op12(spark, sf):
    got = set(map(tuple, registry.QUERIES["op12_collocations"](spark, sf).select(*COLUMNS).collect()))
    assert got == brute_collocations([(r["lang"], r["text"]) for r in documents(spark, sf)], 30, 2000)
    assert got == set(duck(sf, f"SELECT {', '.join(COLUMNS)} FROM ({registry.ORACLES['op12_collocations']})"))


@pytest.mark.parametrize("shard", [200, 6_000_000])
def test_collocations(spark, monkeypatch, shard):
    """Several languages, few words, control characters, ties, nulls, and shards far smaller than the text."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rng = random.Random(5)
    vocabulary = ["new", "York", "the", "of", "é", "a\x01b", "\x1f", "x" * 40, "of\tthe", "stop.", "mid,dle", "\x0bup"]
    docs = [(rng.choice(["en", "de", None, "und", ""]), rng.choice([None, "", " ".join(rng.choices(vocabulary, k=rng.choice([1, 9, 60])))])) for _ in range(400)]
    df = spark.createDataFrame([(i, t, lang, 1, "z") for i, (lang, t) in enumerate(docs)], "doc_id int, text string, lang string, n int, phrase string").repartition(3)
    got = collocations.collocations(df, least=4, top=50)
    assert set(map(tuple, got.select(*COLUMNS).collect())) == brute_collocations(docs, 4, 50)


def test_a_full_pair_table_only_costs_work(spark, monkeypatch):
    """Pairs beyond the table's bits slip in and change no result."""
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    rng = random.Random(6)
    docs = [("en", " ".join(rng.choices("abcdefgh", k=50))) for _ in range(60)]
    got = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), least=10, top=500)
    assert set(map(tuple, got.select(*COLUMNS).collect())) == brute_collocations(docs, 10, 500)


def test_automaton():
    """Counts, states and links by definition: substrings with the same end positions are one state."""
    rng = random.Random(8)
    for depth in (1, 2, 4):
        runs = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(12)]
        word, run = np.array([w for r in runs for w in r]), np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        ends = collections.defaultdict(set)
        for i in range(len(word)):
            for d in range(1, depth + 1):
                if i - d + 1 >= 0 and run[i - d + 1] == run[i]:
                    ends[tuple(word[i - d + 1 : i + 1].tolist())].add(i)
        own = Automaton(word, run, 3, depth)
        state = {tuple(p): s for path, at in own.substrings() for p, s in zip(path.tolist(), at.tolist(), strict=True)}
        assert set(state) == set(ends) and all(own.count[s] == len(ends[p]) for p, s in state.items())
        assert all((state[p] == state[q]) == (ends[p] == ends[q]) for p, q in itertools.combinations(ends, 2))
        for p, s in state.items():
            suffixes = [p[k:] for k in range(1, len(p)) if ends[p[k:]] != ends[p]]
            assert own.link[s] == (state[suffixes[0]] if suffixes else 0)
            assert own.shortest[s] <= len(p) <= own.length[s]


def test_op12_on_no_rows(spark, none):
    assert registry.QUERIES["op12_collocations"](spark, none).count() == 0


# --- SimHash --------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(id, fingerprint) to the least id of each fingerprint's component."""
    fps = sorted({f for _, f in rows})
    of = {f: f for f in fps}

    def top(f):
        while of[f] != f:
            f = of[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            of[top(b)] = top(a)
    least = {}
    for d, f in rows:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return collections.Counter((d, f"{f:016x}", least.get(top(f))) for d, f in rows)


def test_op13(spark, sf):
    got = collections.Counter(map(tuple, registry.QUERIES["op13_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in documents(spark, sf)])


@pytest.mark.parametrize("hot", [1, 4, 32])
def test_links(spark, hot):
    """All links of clusters that share whole halves, differ across both, or chain; hot signatures included."""
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            fps.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(0, 4))}))
        half = base & (2**32 - 1)
        fps |= {half | rng.getrandbits(32) << 32 for _ in range(40)} | {(base >> 32 << 32) | rng.getrandbits(32) for _ in range(40)}
    fps |= {0, 1, 3, 1 << 63, 1 << 63 | 1 << 31, 2**64 - 1}
    signed = sorted(f - (f >> 63 << 64) for f in fps)
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), hot).collect()
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(r["a"] != r["b"] and apart(r["a"], r["b"]) <= 2 for r in found)
    mine = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in found}
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if apart(a, b) <= 2}
    assert mine <= want
    parts = lambda pairs: brute_parts(signed, pairs)
    assert parts(mine) == parts(want)


def brute_parts(nodes, pairs):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        of[y] = x
    return {n: top(n) for n in nodes}


def test_fingerprints_of_long_texts_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    texts = ["One two THREE four five six seven eight nine", "one two three FOUR five six seven eight nine", "x", "x y", None, "  ", "é\x01 b\tc\nd"]
    rows = [(i if i % 5 else None, t, "k") for i, t in enumerate(texts)] + [(3, "another text under this id", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = simhash.near_duplicates(docs)
    assert collections.Counter((r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in got.collect()) == brute_components([(d, brute_fingerprint(t)) for d, t, _ in rows])


def test_op13_on_no_rows(spark, none):
    assert registry.QUERIES["op13_simhash"](spark, none).count() == 0


