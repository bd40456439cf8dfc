"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals score documents.

Training uses a bounded sample of labelled documents (at most SAMPLE_TOXIC and SAMPLE_CLEAN of those
with at most SAMPLE_CHARS code points, chosen by hash, near copies taken once), on the driver. The tables
label documents, not tokens, so that token labels are weak ones: words and word beginnings that a
likelihood-ratio test finds in toxic documents form the vocabulary; in a clean document every token is
labelled clean, in a toxic one every vocabulary word toxic. (A second fit to only those tokens that a
first field agrees with changed no label on the test tables and was left out.) The field (two states, weights for words and
beginnings, transitions) is fitted by gradient ascent on exact forward-backward expectations; a
logistic layer turns a document's marginals into a score. In the layer and in the share of toxic
documents a sampled row stands for the labelled rows of its class outside the sample too, so that
scores mean the same at every size.

Tagging is a map over whole texts without a shuffle. Words outside the vocabulary share one
potential, so that the chain between two vocabulary words is a power of one 2x2 matrix: the
forward-backward pass is exact and visits vocabulary words only.

A null or empty text scores like one without vocabulary words. Without toxic (or without clean)
labelled documents every score is the share of toxic ones. Repeated rows are scored row by row; a
repeated label counts once, toxic if any is; an empty table gives an empty result; other columns
are never inputs of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, sized, table, tidy

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 3000, 12_000
FOLDS = 5
WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (5, 6, 7)
#: Likelihood ratio (G squared) and documents from which a word or beginning enters the vocabulary.
MIN_G2, MIN_DOCS = 14.0, 3
#: Words beside a vocabulary word that a training segment spans.
REACH = 3
STEPS, RIDGE = 60, 1e-3
#: Training segments whose expectations are held at once.
SEGMENTS = 20_000
#: Words whose potential a worker remembers.
CACHE = 400_000


@dataclass
class Model:
    words: dict[str, float]
    beginnings: dict[str, float]
    bias: float
    transitions: list[list[float]]  # log potentials, from state to state
    layer: list[float]  # intercept and weights of the document features
    prior: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def marks(word: str) -> list[str]:
    return [word[:k] for k in BEGINNINGS if len(word) >= k]


# --- tagging --------------------------------------------------------------------------------


class Tagger:
    def __init__(self, m: Model) -> None:
        self.m = m
        t = np.exp(np.array(m.transitions))
        step = t * np.array([1.0, math.exp(m.bias)])  # over a word outside the vocabulary
        values, vectors = np.linalg.eig(step)
        values, vectors = values.real, vectors.real
        inverse = np.linalg.inv(vectors)
        i = int(np.argmax(np.abs(values)))
        self.main = np.outer(vectors[:, i], inverse[i])
        self.other = np.outer(vectors[:, 1 - i], inverse[1 - i])
        self.ratio = float(values[1 - i] / values[i])
        self.t = t
        self.cache: dict[str, float | None] = {}

    def potential(self, word: str) -> float | None:
        """Log potential of the toxic state, or None outside the vocabulary."""
        own = self.m.words.get(word)
        more = [self.m.beginnings[b] for b in marks(word) if b in self.m.beginnings]
        found = None if own is None and not more else self.m.bias + (own or 0.0) + sum(more)
        if len(self.cache) < CACHE:
            self.cache[word] = found
        return found

    def between(self, gap: int) -> list[float]:
        """The normalised matrix power over ``gap`` outside words and the step into the next word."""
        m = (self.main + self.ratio**gap * self.other) @ self.t
        return m.ravel().tolist()

    def marginals(self, own: list[str]) -> tuple[list[int], list[float]]:
        """Positions of vocabulary words and the probability that each is toxic."""
        cache, at, e = self.cache, [], []
        for i, w in enumerate(own):
            x = cache[w] if w in cache else self.potential(w)
            if x is not None:
                at.append(i)
                e.append(math.exp(min(x, 30.0)))
        if not at:
            return [], []
        steps = [self.between(b - a - 1) for a, b in zip([-1, *at], at, strict=False)]
        f, forward = (1.0, 0.0), []
        for (m00, m01, m10, m11), x in zip(steps, e, strict=True):
            a, b = f[0] * m00 + f[1] * m10, (f[0] * m01 + f[1] * m11) * x
            f = (a / (a + b), b / (a + b))
            forward.append(f)
        tail = (self.main + self.ratio ** (len(own) - 1 - at[-1]) * self.other).sum(axis=1)
        back = [(float(tail[0]), float(tail[1]))]
        for (m00, m01, m10, m11), x in zip(steps[:0:-1], e[:0:-1], strict=True):
            n0, n1 = back[-1][0], back[-1][1] * x
            a, b = m00 * n0 + m01 * n1, m10 * n0 + m11 * n1
            back.append((a / (a + b), b / (a + b)))
        return at, [f1 * b1 / (f0 * b0 + f1 * b1) for (f0, f1), (b0, b1) in zip(forward, reversed(back), strict=True)]

    def features(self, p: list[float], n: int) -> list[float]:
        expected = sum(p)
        return [math.log1p(expected), max(p, default=0.0), min(1.0, 20 * expected / max(n, 1)), math.log1p(max(0, len(p) - expected))]

    def score(self, p: list[float], n: int) -> float:
        if not self.m.layer:
            return self.m.prior
        x = self.m.layer[0] + sum(a * b for a, b in zip(self.m.layer[1:], self.features(p, n), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


# --- training -------------------------------------------------------------------------------


def associated(docs: Iterator[tuple[int, set[str]]], toxic: int, clean: int) -> set[str]:
    """Terms found in toxic documents more often than chance allows, by G squared."""
    in_toxic, in_clean = Counter(), Counter()
    for label, terms in docs:
        (in_toxic if label else in_clean).update(terms)
    found = set()
    for term, a in in_toxic.items():
        b = in_clean[term]
        if a < MIN_DOCS or a * clean <= 3 * b * toxic:
            continue
        ea, eb = (a + b) * toxic / (toxic + clean), (a + b) * clean / (toxic + clean)
        if 2 * (a * math.log(a / ea) + (b * math.log(b / eb) if b else 0.0)) >= MIN_G2:
            found.add(term)
    return found


def fit(rows: list[tuple[int, str | None]], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """``weights``: how many labelled rows a clean and a toxic row of the sample stand for."""
    texts, seen, known = [], set(), {}
    for label, text in rows:
        own = [known.setdefault(w, w) for w in tokens(text)]
        sketch = min(zlib.crc32(" ".join(own[i : i + 5]).encode()) for i in range(max(1, len(own) - 4)))
        if (label, sketch) not in seen:
            seen.add((label, sketch))
            texts.append((label, own))
    toxic = sum(label for label, _ in texts)
    clean = len(texts) - toxic
    prior = sum(weights[1] for label, _ in rows if label) / sum(weights[label] for label, _ in rows) if rows else 0.0
    if not toxic or not clean:
        return Model({}, {}, -4.0, [[0.0, -2.0], [0.0, 0.0]], [], prior)
    words = associated(((label, set(own)) for label, own in texts), toxic, clean)
    begins = associated(((label, {b for w in own for b in marks(w)}) for label, own in texts), toxic, clean)
    # a beginning says something only if vocabulary words share it
    begins &= {b for b, n in Counter(b for w in words for b in marks(w)).items() if n > 1}
    if not words:  # nothing tells toxic documents apart
        return Model({}, {}, -4.0, [[0.0, -2.0], [0.0, 0.0]], [], prior)
    field = fit_field(texts, sorted(words), sorted(begins))
    tagger = Tagger(field)
    x = np.array([[1.0, *tagger.features(tagger.marginals(own)[1], len(own))] for _, own in texts])
    shares = np.array([weights[label] for label, _ in texts], float)
    field.layer = fit_layer(x, np.array([label for label, _ in texts], float), shares / shares.mean()).tolist()
    field.prior = prior
    return field


def fit_field(texts: list[tuple[int, list[str]]], words: list[str], begins: list[str]) -> Model:
    index = {w: i + 1 for i, w in enumerate(words)}
    first = {b: len(words) + i + 1 for i, b in enumerate(begins)}
    width = 2 * REACH + 1
    ids, labels, masks = [], [], []
    for label, own in texts:
        if not own:
            continue
        coded = np.array([(index.get(w, 0), *(first.get(w[:k], 0) if len(w) >= k else 0 for k in BEGINNINGS)) for w in own], np.int32)
        centres = np.append(np.flatnonzero(coded.any(axis=1)), len(own) // 2)
        places = np.maximum(0, centres - REACH)[:, None] + np.arange(width)
        real = places < np.minimum(len(own), centres + REACH + 1)[:, None]
        found = coded[np.minimum(places, len(own) - 1)] * real[:, :, None]
        ids.append(found)
        labels.append((found[:, :, 0] > 0) & bool(label))
        masks.append(real)
    x, y, real = np.concatenate(ids), np.concatenate(labels), np.concatenate(masks)
    n = len(x)
    parts = [slice(k, k + SEGMENTS) for k in range(0, n, SEGMENTS)]
    seen_pairs = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & real[:, 1:] & real[:, :-1]).sum() for b in (0, 1)] for a in (0, 1)])
    weights, bias, trans = np.zeros(1 + len(words) + len(begins)), -2.0, np.zeros((2, 2))
    square = [np.zeros_like(weights), 0.0, np.zeros((2, 2))]
    for _ in range(STEPS):
        slope, off_sum, pairs = np.zeros_like(weights), 0.0, np.zeros((2, 2))
        for part in parts:
            mask = real[part].astype(float)
            p, some = expectations((bias + weights[x[part]].sum(axis=2)) * mask, trans, mask)
            off = (y[part] - p) * mask
            slope += np.bincount(x[part].ravel(), np.repeat(off.ravel(), x.shape[2]), len(weights))
            off_sum, pairs = off_sum + off.sum(), pairs + some
        slope = slope / n - RIDGE * weights
        # the padding's own index 0 has no weight
        slope[0] = 0.0
        slopes = [slope, off_sum / n, (seen_pairs - pairs) / n - RIDGE * trans]
        square = [s + g * g for s, g in zip(square, slopes, strict=True)]
        weights, bias, trans = (v + 0.5 * g / np.sqrt(s + 1e-8) for v, g, s in zip((weights, bias, trans), slopes, square, strict=True))
    return Model(
        {w: round(float(weights[i]), 6) for w, i in index.items()},
        {b: round(float(weights[i]), 6) for b, i in first.items()},
        round(float(bias), 6),
        np.round(trans, 6).tolist(),
        [],
        0.0,
    )


def expectations(unary: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state and summed expected transitions, for padded segments."""
    e = np.stack([np.ones_like(unary), np.exp(np.minimum(unary, 30.0))], axis=2)
    t = np.exp(trans)
    n, width = unary.shape
    forward, back = np.zeros((n, width, 2)), np.ones((n, width, 2))
    f = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    forward[:, 0] = f
    for k in range(1, width):
        g = (f @ t) * e[:, k]
        g /= g.sum(axis=1, keepdims=True)
        f = np.where(mask[:, k : k + 1] > 0, g, f)
        forward[:, k] = f
    for k in range(width - 2, -1, -1):
        g = (back[:, k + 1] * e[:, k + 1]) @ t.T
        g /= g.sum(axis=1, keepdims=True)
        back[:, k] = np.where(mask[:, k + 1 : k + 2] > 0, g, back[:, k])
    both = forward * back
    p = both[:, :, 1] / both.sum(axis=2)
    pair = forward[:, :-1, :, None] * t * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    pair *= (mask[:, 1:] * mask[:, :-1])[:, :, None, None]
    return p, pair.sum(axis=(0, 1))


def fit_layer(x: np.ndarray, y: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression, rows weighted by ``shares``, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (shares * (y - p)) - 0.01 * w
        curve = (x * (shares * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return np.round(w, 6)


# --- Spark ----------------------------------------------------------------------------------


def open_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labelled documents outside the held-out fifth."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.where(~held_out(F.col("doc_id")))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows, weights = training_sample(docs, labels)
    return fit(rows, weights)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, str | None]], tuple[float, float]]:
    """Labels and texts of the sample, a document once, and how many labelled documents a sampled clean
    and a sampled toxic one stand for."""
    open_ = open_labels(labels)
    fitting = docs.where(F.col("doc_id").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)).select("doc_id", "text")
    eligible = settle(sized(open_).join(fitting.select("doc_id"), "doc_id").distinct(), "labelled")
    count = lambda df: {r["toxic"]: r["count"] for r in df.groupBy("toxic").count().collect()}
    all_, fit_ = count(open_), count(eligible)
    share = lambda v, n: max(1.0, all_.get(v, 0) / max(1, min(n, fit_.get(v, 0))))
    part = lambda v, n: eligible.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = part(1, SAMPLE_TOXIC).unionByName(part(0, SAMPLE_CLEAN))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids, and one text for each
    once = fitting.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = once.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(r["toxic"], r["text"]) for r in rows], (share(0, SAMPLE_CLEAN), share(1, SAMPLE_TOXIC))


TAGGED = "score double, n_toxic bigint, spans array<struct<start:bigint,end:bigint,p:double>>"
_TAGGERS: dict[int, Tagger] = {}


def tag(docs: DataFrame, model: Model, keys: list[str], text: str = "text", min_p: float = 0.5) -> DataFrame:
    """``keys``, score, n_toxic and spans: code point offsets of words whose marginal is min_p or more."""
    ship(docs.sparkSession)
    slim = docs.select(*keys, F.col(text).alias("_".join(("text", *keys))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            scores, counts, spans = [], [], []
            for raw in batch.column(len(keys)):
                body = raw.as_py()
                own = tokens(body)
                at, p = tagger.marginals(own)
                scores.append(tagger.score(p, len(own)))
                bad = {i: x for i, x in zip(at, p, strict=True) if x >= min_p}
                counts.append(len(bad))
                where = offsets(body) if bad else []
                spans.append([{"start": where[i][0], "end": where[i][1], "p": x} for i, x in bad.items()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, span)], names=[*keys, "score", "n_toxic", "spans"])

    kinds = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{kinds}, {TAGGED}")


def offsets(text: str) -> list[tuple[int, int]]:
    """Code point offsets, in the text as given, of its tokens."""
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return found
    place = [0]  # lower-casing made the text longer: go back character by character
    for i, c in enumerate(text):
        place += [i + 1] * len(c.lower())
    start = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(start[a], place[b]) for a, b in found]


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, all columns as they were: a map over the rows."""
    ship(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            clean = []
            for raw in batch.column(place):
                own = tokens(raw.as_py())
                clean.append(tagger.score(tagger.marginals(own)[1], len(own)) < 0.5)
            yield batch.filter(pa.array(clean, pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return tag(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")
