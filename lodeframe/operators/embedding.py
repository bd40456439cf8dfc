"""Embedders: hashed term counts as sparse rows, and an optional model as a map."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import text as tx
from lodeframe.shipping import ship

DIM = 384
VECTOR = pa.list_(pa.struct([("bucket", pa.int32()), ("weight", pa.float64())]))
#: Rows counted at once, and words whose buckets a worker remembers before it begins anew.
ROWS, KNOWN_WORDS = 500, 200_000
MODEL_ID = "localhashembedder"


def _bucket(word: str, dim: int) -> int:
    """``text.hash_bucket`` of one word."""
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big") % dim


def _bucketed(dim: int):
    """Word lists to the numbers of all words' places (row * dim + bucket), and the number of rows. A word is hashed once for
    each worker that meets it, not at each of its places."""
    known: dict[str, int] = {}

    def places(words: pa.Array) -> np.ndarray:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0)).astype(np.int64)
        named = words.flatten().dictionary_encode()
        distinct = named.dictionary.to_pylist()
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in distinct:
            if w not in known:
                known[w] = _bucket(w, dim)
        buckets = np.array([known[w] for w in distinct], np.int64)[np.asarray(named.indices)]
        return np.repeat(np.arange(len(sizes)), sizes) * dim + buckets

    return places


def counter(dim: int):
    """Word lists to rows of counts of their hashed words, whose directions are the embedding."""
    places = _bucketed(dim)
    return lambda words: np.bincount(places(words), minlength=len(words) * dim).reshape(len(words), dim).astype(np.float64)


def _counted(dim: int):
    """Word lists to sparse unit vectors."""
    places = _bucketed(dim)

    def rows(words: pa.Array) -> pa.Array:
        pairs, n = np.unique(places(words), return_counts=True)
        row = pairs // dim
        n = n.astype(np.float64)
        norm = np.sqrt(np.bincount(row, n * n, minlength=len(words)))
        ends = np.cumsum(np.bincount(row, minlength=len(words)))
        entries = pa.StructArray.from_arrays([pa.array((pairs % dim).astype(np.int32)), pa.array(n / norm[row])], names=["bucket", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), entries)

    def vectors(words: pa.Array) -> pa.Array:
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        parts = [rows(words.slice(i, ROWS)) for i in range(0, len(words), ROWS)]
        pa.default_memory_pool().release_unused()  # the worker joins blocks of vectors next
        return pa.concat_arrays(parts) if parts else pa.array([], VECTOR)

    return vectors


def hash_vectors(df: DataFrame, keys: list[str], text: str = "text", dim: int = DIM) -> DataFrame:
    """Sparse unit vectors of each row's text: keys, vector (an array of bucket and weight, empty for a text without
    words). Counted inside the row: no shuffle. Words are cut in the JVM and counted over Arrow batches."""
    if dim <= 0:
        raise ValueError("dim must be > 0")
    ship(df.sparkSession)
    counted = F.arrow_udf(_counted(dim), "array<struct<bucket:int,weight:double>>")
    return df.select(*keys, counted(tx.words(F.col(text))).alias("vector"))


def word_lists(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The same vectors as the words that they count: keys, vector (an array of strings), which block products hash
    themselves, so that vectors are neither written nor handed from one Python worker to the next."""
    return df.select(*keys, tx.words(F.col(text)).alias("vector"))


def hash_embedding(df: DataFrame, keys: list[str], text: str = "text", dim: int = DIM) -> DataFrame:
    """The same vectors as rows: keys, bucket, weight. Texts without words have none."""
    rows = hash_vectors(df, keys, text, dim).select(*keys, F.explode_outer("vector").alias("_x")).where("_x IS NOT NULL")
    return rows.select(*keys, "_x.bucket", "_x.weight")


def hash_vector(text: Column, dim: int = DIM) -> Column:
    """The dense form of a text's hashed embedding, ARRAY<DOUBLE>, within the row."""
    buckets = F.transform(tx.words(text), lambda w: tx.hash_bucket(w, dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.size(buckets) == 0, counts).otherwise(F.transform(counts, lambda x: F.try_divide(x, norm)))


def model_embedding(df: DataFrame, keys: list[str], model_name: str, text: str = "text", batch_size: int = 32, normalize: bool = True) -> DataFrame:
    """Dense vectors of a sentence-transformers model, loaded once per Python worker; needs that package."""
    ship(df.sparkSession)
    slim = df.select(*keys, F.col(text).alias("t"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("install sentence-transformers to use a model embedder") from e
        model = SentenceTransformer(model_name)
        for batch in batches:
            vectors = model.encode(batch.column(len(keys)).to_pylist(), batch_size=batch_size, normalize_embeddings=normalize)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], names=[*keys, "embedding"])

    kinds = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(embed, f"{kinds}, embedding array<float>")


def model_id(name: str | None) -> str:
    """A stable id for a model name or for its folder in a model cache."""
    raw = str(name or "").strip()
    found = re.search(r"(?:^|/)models--([^/]+?)(?:/snapshots/|$)", raw.replace("\\", "/"))
    return found[1].replace("--", "/") if found else raw
