"""Nearest vectors by cosine: an exact block join, and inverted lists of a coarse quantiser.

A vector is an array of numbers, of (bucket, weight) for sparse ones, or of words that are hashed and counted here. In both
joins vectors stream by the questions of a list, at most QUERY_BLOCK of them in a pass, which go to all tasks by a broadcast:
neither side is shuffled or repeated, and only a pass of questions at a time goes through the driver. Matrix products of TILE
questions and VECTOR_BLOCK vectors leave each question's k nearest of a task; what can't be among them is not listed.

The quantiser is spherical k-means, fitted on a bounded sample (SAMPLE_PER_LIST rows a list); every vector is then
assigned to its nearest list, and a question reads the lists nearest to it. Zero vectors and those of another
length have no distance (NaN) and come last; they are in list 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators.embedding import counter
from lodeframe.operators.streams import Best, beside, least_places
from lodeframe.shipping import ship

#: Vectors of a block, and questions of a pass.
VECTOR_BLOCK, QUERY_BLOCK = 8_192, 16_000
#: Questions and vectors of one matrix product in single precision, pairs of one exact product.
TILE, SPAN, PAIRS = 512, 16_384, 8_192
#: Rows of a block that are made or scaled at once.
ROWS = 2_048
LISTS, SAMPLE_PER_LIST, ROUNDS = 100, 256, 12


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles; rows of another length than ``dim`` (the first one's, if None), or with a
    null inside, are NaN. Sparse rows hold (bucket, weight), or are an array of buckets and one of weights."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_struct(column.type):
        lists, weights = column.field("bucket"), column.field("weight").flatten()
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        return _scattered(counts, np.asarray(lists.flatten()), np.asarray(weights), dim)
    flat = column.flatten()
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    if pa.types.is_struct(flat.type):
        return _scattered(counts, np.asarray(flat.field("bucket")), np.asarray(flat.field("weight")), dim)
    dim = dim if dim is not None else int(counts.max(initial=0))
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    if (counts == dim).all():
        return values.reshape(len(column), dim)
    out = np.full((len(column), dim), np.nan)
    starts = np.cumsum(counts) - counts
    for i in np.flatnonzero(counts == dim):
        out[i] = values[starts[i] : starts[i] + dim]
    return out


def _scattered(counts: np.ndarray, place: np.ndarray, weight: np.ndarray, dim: int) -> np.ndarray:
    out, ends = np.zeros((len(counts), dim)), np.concatenate([[0], np.cumsum(counts)])
    for i in range(0, len(counts), ROWS):  # else indexes take as much memory as the rows
        n, own = counts[i : i + ROWS], slice(ends[i], ends[min(i + ROWS, len(counts))])
        inside = (place[own] >= 0) & (place[own] < dim)
        out[np.repeat(np.arange(i, i + len(n)), n)[inside], place[own][inside]] = weight[own][inside]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; NaN for zero rows."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.sqrt((rows**2).sum(axis=1))[:, None]


# --- exact ----------------------------------------------------------------------------------


def _lengths(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows; NaN for zero rows and those with a NaN."""
    found = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return np.where(found > 0, found, np.nan)


def _above(s: np.ndarray, q: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th greatest of s for each of n questions; -inf if it has fewer."""
    order = np.lexsort((-s, q))
    starts = np.searchsorted(q[order], np.arange(n + 1))
    out = np.full(n, -np.inf, np.float32)
    full = np.flatnonzero(np.diff(starts) >= k)
    out[full] = s[order[starts[full] + k - 1]]
    return out


def _likely(a: np.ndarray, b: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of b, row of a) among which each row of b has its k greatest products and their ties, but for those below
    its ``floor``. ``a`` and ``b``: unit rows in single precision, whose products differ from the true ones by less than half of ``slack``."""
    slack, n = np.float32(4 * (a.shape[1] + 8) * 2.0**-24), len(b)
    q, v, s, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), floor
    start, size = 0, max(4 * k, 2_048)
    while start < len(a):
        part = b @ a[start : start + size].T
        if not start and part.shape[1] > k and np.isneginf(floor).any():  # each question's own bound, before pairs are listed
            least = np.maximum(floor, np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k])
        more_q, more_v = np.nonzero(part >= (least - slack)[:, None])
        q, v, s = np.concatenate([q, more_q]), np.concatenate([v, more_v + start]), np.concatenate([s, part[more_q, more_v]])
        least = np.maximum(floor, _above(s, q, n, k))
        kept = s >= (least - slack)[q]
        q, v, s = q[kept], v[kept], s[kept]
        start, size = start + size, SPAN
    return q, v


def _pairs(keys: pa.Array, a: np.ndarray, b: np.ndarray, own: np.ndarray, k: int, digits: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of b and of a and their distances: the k nearest of a for each of b's ``own`` rows, ties to the smaller key, but
    for those beyond its ``limit``."""
    place = np.empty(len(a), np.int64)
    by_key = np.asarray(pc.array_sort_indices(keys)).astype(np.int64)
    place[by_key] = np.arange(len(a))
    la = _lengths(a)
    real, none = np.flatnonzero(~np.isnan(la)), by_key[np.isnan(la[by_key])][:k]
    slim = np.empty((len(real), a.shape[1]), np.float32)
    for i in range(0, len(real), ROWS):  # no second matrix of doubles
        slim[i : i + ROWS] = a[real[i : i + ROWS]] / la[real[i : i + ROWS], None]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(own), TILE):
        tile = own[at : at + TILE]
        lb = _lengths(b[tile])
        some, empty, lb = tile[~np.isnan(lb)], tile[np.isnan(lb)], lb[~np.isnan(lb)]
        i, v = _likely(slim, (b[some] / lb[:, None]).astype(np.float32), k, (1 - limit[some]).astype(np.float32))
        q, v, distance = some[i], real[v], np.empty(len(i))
        for j in range(0, len(q), PAIRS):
            x, y, l = v[j : j + PAIRS], q[j : j + PAIRS], lb[i[j : j + PAIRS]]
            distance[j : j + PAIRS] = 1 - np.einsum("ij,ij->i", a[x], b[y]) / (la[x] * l)
        kept = least_places(i, v, distance, place, k, digits)
        kept = kept[distance[kept] <= limit[q[kept]]]
        out.append((q[kept], v[kept], distance[kept]))
        # without a distance: they come last, by key
        for rest, last in ((empty, by_key[:k]), (some[np.isinf(limit[some])] if len(real) < k else some[:0], none)):
            out.append((np.repeat(rest, len(last)), np.tile(last, len(rest)), np.full(len(rest) * len(last), np.nan)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _nearest(k: int, dim: int | None, key: str, digits: int):
    """Of a table of vectors (key, _v) and one of questions (query_id, _q)."""

    def nearest(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        keys, a, b = vectors.column(key).combine_chunks(), matrix(vectors.column("_v"), dim), matrix(asked.column("_q"), dim)
        if a.shape[1] != b.shape[1]:
            b = np.full((len(b), a.shape[1]), np.nan)
        q, v, distance = _pairs(keys, a, b, np.arange(len(b)), k, digits, np.full(len(b), np.inf))
        return pa.table([asked.column("query_id").take(pa.array(q)), keys.take(pa.array(v)), pa.array(distance)], names=["query_id", key, "distance"])

    return nearest


def _told(dim: int | None):
    """A pass of questions by their lists. Without ``dim``, vectors are of the length that most questions have."""

    def told(asked: pa.Table) -> dict:
        whole = lambda name: pa.concat_arrays(asked.column(name).chunks) if asked.num_rows else pa.array([], asked.schema.field(name).type)
        q, lists = whole("_q"), whole("_list").dictionary_encode()
        n = dim if dim is not None else int(np.bincount(np.asarray(pc.fill_null(pc.list_value_length(q), 0)), minlength=1).argmax())
        return {"dim": n, "query_id": whole("query_id"), "_q": q, "lists": lists.dictionary, "list": np.asarray(pc.fill_null(lists.indices, -1))}

    return told


def _met(k: int, key: str, digits: int):
    """Vectors (_list, key, _v) by the questions of their list: each question's k nearest of a task."""

    def meet(sent):
        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            dim, b = asked["dim"], matrix(asked["_q"], asked["dim"])
            counted, best = counter(dim), Best(len(b), k, digits)
            by_list = {i: np.flatnonzero(asked["list"] == i) for i in range(len(asked["lists"]))}
            for batch in batches:
                if not len(b):
                    continue
                every = np.asarray(pc.fill_null(pc.index_in(batch.column(0), value_set=asked["lists"].cast(batch.column(0).type)), -1))
                for i in range(0, batch.num_rows, VECTOR_BLOCK):
                    at, keys, rows = every[i : i + VECTOR_BLOCK], batch.column(1).slice(i, VECTOR_BLOCK), batch.column(2).slice(i, VECTOR_BLOCK)
                    named = np.unique(at[at >= 0])
                    if not len(named):
                        continue
                    a = counted(rows) if pa.types.is_list(rows.type) and pa.types.is_string(rows.type.value_type) else matrix(rows, dim)
                    for n in named:
                        own = np.flatnonzero(at == n)
                        whole = len(own) == len(at)
                        q, v, distance = _pairs(keys if whole else keys.take(pa.array(own)), a if whole else a[own], b, by_list[n], k, digits, best.limit)
                        best.add(q, keys.take(pa.array(own[v])), distance)
            yield from best.batches(asked["query_id"], ["query_id", key, "distance"])

        return met

    return meet


def _apart(rows: DataFrame, name: str) -> Column:
    """A vector column in a form that is short on its way to a group: sparse ones as an array of buckets and one of weights."""
    kind = rows.schema[name].dataType.elementType.typeName()
    if kind != "struct":
        return F.col(name)
    return F.struct(F.transform(name, lambda x: x["bucket"].cast("int")).alias("bucket"), F.transform(name, lambda x: x["weight"].cast("double")).alias("weight"))


def block_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str, dim: int | None = None, digits: int = 12) -> DataFrame:
    """query_id, key, distance: each question's k nearest vectors of its list in every task, ties to the smaller key.

    ``vectors``: _list, key, _v; ``queries``: _list, query_id, _q. A question may be in several lists; a null list is none."""
    types = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *queries.schema)}
    rows = vectors.select("_list", key, _apart(vectors, "_v").alias("_v"))
    asked = queries.select("_list", "query_id", _apart(queries, "_q").alias("_q"))
    return beside(rows, asked, F.lit(1), QUERY_BLOCK, _told(dim), _met(k, key, digits), f"query_id {types['query_id']}, `{key}` {types[key]}, distance double")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", dim: int | None = None, digits: int = 12) -> DataFrame:
    """query_id, key, distance, rn: exact nearest vectors of ``queries`` (query_id, query); distances that agree in
    so many digits are ties, which go to the smaller key."""
    left = vectors.select(F.lit(0).alias("_list"), F.col(key), F.col(vector).alias("_v"))
    right = queries.select(F.lit(0).alias("_list"), "query_id", F.col("query").alias("_q"))
    return first(block_topk(left, right, k, key, dim, digits), k, key, digits)


def first(found: DataFrame, k: int, key: str, digits: int = 12) -> DataFrame:
    """The k nearest of each question over all blocks, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.round("distance", digits), F.col(key))
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


# --- inverted lists -------------------------------------------------------------------------


def _sums(centres: np.ndarray):
    """Sums and counts of the unit vectors nearest to each centre: one row for each list and task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            rows = unit(matrix(batch.column(0), centres.shape[1]))
            rows = rows[~np.isnan(rows).any(axis=1)]
            own = (rows @ centres.T).argmax(axis=1)
            np.add.at(total, own, rows)
            count += np.bincount(own, minlength=len(centres))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["list", "n", "total"])

    return sums


def fit_lists(vectors: DataFrame, vector: str = "embedding", dim: int | None = None, lists: int = LISTS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of at most ``lists`` lists (unit rows), by k-means in Spark over a sample of SAMPLE_PER_LIST * ``lists``
    rows: those whose hashes are least, so that the same vectors give the same centres. The driver sees lists * dim numbers a round."""
    ship(vectors.sparkSession)
    slim = vectors.select(F.col(vector).alias("_v")).where(F.size("_v") > 0)
    sample = slim.withColumn("_h", F.xxhash64(F.to_json(F.struct("_v")))).orderBy("_h", F.to_json(F.struct("_v"))).limit(SAMPLE_PER_LIST * lists).select("_v").persist()
    try:
        first = unit(matrix(sample.limit(4 * lists).toArrow().column(0), dim))
        first = first[~np.isnan(first).any(axis=1)]
        centres = np.unique(np.round(first, 12), axis=0)
        centres = centres[np.random.default_rng(7).permutation(len(centres))[:lists]]
        if not len(centres):
            return np.zeros((0, dim or 0))
        for _ in range(rounds):
            each = sample.mapInArrow(_sums(centres), "list int, n bigint, total array<double>")
            sums = each.select("list", F.posexplode("total").alias("d", "x")).groupBy("list", "d").agg(F.sum("x").alias("x")).toArrow()
            total = np.zeros_like(centres)
            total[sums.column("list").to_numpy(), sums.column("d").to_numpy()] = sums.column("x").to_numpy()
            moved = unit(total)
            kept = np.isnan(moved).any(axis=1)
            moved[kept] = centres[kept]  # a list without vectors stays where it is
            if np.allclose(moved, centres, atol=1e-6):
                break
            centres = moved
        return centres
    finally:
        sample.unpersist()


def _listed(centres: np.ndarray, n: int, dense: bool):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            rows = unit(matrix(last, centres.shape[1] if len(centres) else None))
            if dense and not pa.types.is_struct(last.type.value_type) and len(rows) and set(pc.unique(pc.list_value_length(last)).to_pylist()) - {rows.shape[1]}:
                raise ValueError(f"vectors of another dimension than {rows.shape[1]}")
            near = np.zeros((len(rows), 1), np.int64) if not len(centres) else np.argsort(-np.nan_to_num(rows, nan=0.0) @ centres.T, axis=1, kind="stable")[:, :n]
            near[np.isnan(rows).any(axis=1), :] = 0
            columns = [*batch.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))]
            names = [*batch.schema.names, "lists"]
            if dense:
                columns[-2] = pa.array(np.nan_to_num(rows, nan=0.0).astype(np.float32).tolist(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return listed


def with_lists(rows: DataFrame, centres: np.ndarray, vector: str = "embedding", n: int = 1, dense: bool = False) -> DataFrame:
    """``rows`` with the numbers of their n nearest lists (``lists``), nearest first; ``dense``: the vector as unit floats."""
    ship(rows.sparkSession)
    rest = [c for c in rows.columns if c != vector]
    given = rows.select(*rest, vector)
    types = [(f.name, f.dataType.simpleString()) for f in given.schema]
    if dense:
        types[-1] = (vector, "array<float>")
    return given.mapInArrow(_listed(centres, n, dense), ", ".join(f"`{c}` {t}" for c, t in types) + ", lists array<int>")


def assign(vectors: DataFrame, centres: np.ndarray, vector: str = "embedding", dense: bool = False) -> DataFrame:
    """Every vector with its list."""
    found = with_lists(vectors, centres, vector, 1, dense)
    return found.withColumn("list", F.col("lists")[0]).drop("lists")


def probe_topk(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int, key: str = "vec_id", vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """query_id, key, distance, rn: nearest vectors among those in each question's ``probes`` nearest lists.

    ``index`` has column list; ``queries``: query_id, query. A list that no question probes is left out by the
    join, and by the scan where lists are few enough to be named (``probed``)."""
    asked = with_lists(queries.select("query_id", "query"), centres, "query", probes)
    right = asked.select(F.explode("lists").alias("_list"), "query_id", F.col("query").alias("_q"))
    left = index.select(F.col("list").alias("_list"), F.col(key), F.col(vector).alias("_v"))
    return first(block_topk(left, right, k, key, dim), k, key)


def probed(index: DataFrame, queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """The part of a stored index that some questions probe, as a filter that reaches the scan: at most as many
    numbers as there are lists come to the driver."""
    named = with_lists(queries.select("query"), centres, "query", probes).select(F.explode("lists").alias("l")).distinct().collect()
    return index.where(F.col("list").isin([r["l"] for r in named]))
