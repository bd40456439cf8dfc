"""Schemas of the stored tables and of the service's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _I, _L, _B, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()
_TS = T.TimestampType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


DOCUMENTS = _struct(
    ("doc_id", _S, False), ("repo_id", _S, False), ("path", _S, False), ("path_norm", _S, False), ("ext", _S, False),
    ("language", _S, True), ("doc_type", _S, False), ("size_bytes", _L, False), ("mtime", _TS, True), ("content_hash", _S, False),
    ("is_generated", _B, False), ("confidentiality", _S, False), ("tags", T.MapType(_S, _S), False),
    ("created_at", _TS, False), ("updated_at", _TS, False), ("last_indexed_at", _TS, True), ("deleted_at", _TS, True),
)
CHUNKS = _struct(
    ("chunk_id", _S, False), ("doc_id", _S, False), ("chunk_index", _I, False), ("char_start", _I, False), ("char_end", _I, False),
    ("line_start", _I, False), ("line_end", _I, False), ("section_path", _S, True), ("text", _S, False), ("text_hash", _S, False),
    ("token_count", _I, True), ("quality_flags", _struct(("header", _B, True)), False), ("is_header", _B, False),
)
EMBEDDINGS = _struct(
    ("doc_id", _S, False), ("chunk_id", _S, False), ("model_id", _S, False), ("dim", _I, False), ("list", _I, False), ("embedding", T.ArrayType(T.FloatType()), False),
)
#: Centres of the inverted lists that vectors are stored by.
VECTOR_LISTS = _struct(("model_id", _S, False), ("list", _I, False), ("centre", T.ArrayType(_D), False))
#: A token's block: its chunks whose documents fall into one slot, their number and the most places in one of them.
POSTINGS = _struct(
    ("slot", _I, False), ("token", _S, False), ("n", _I, False), ("most", _I, False),
    ("entries", T.ArrayType(_struct(("chunk_id", _S, True), ("doc_id", _S, True), ("pos", T.ArrayType(_I), True))), False),
)
SYMBOLS = _struct(
    ("symbol_id", _S, False), ("doc_id", _S, False), ("repo_id", _S, False), ("name", _S, False), ("name_lower", _S, False), ("kind", _S, False),
    ("namespace", _S, True), ("line_start", _I, False), ("line_end", _I, True), ("signature", _S, True), ("language", _S, True),
)
SYMBOL_REFS = _struct(("ref_id", _S, False), ("repo_id", _S, False), ("caller_doc_id", _S, False), ("callee_name", _S, False), ("line", _I, False), ("language", _S, True))
INDEX_RUNS = _struct(
    ("run_id", _S, False), ("repo_id", _S, False), ("embedding_model", _S, False), ("dim", _I, False), ("chunker_version", _S, False),
    ("config_snapshot", _S, False), ("started_at", _TS, False), ("finished_at", _TS, True),
)

TABLES = {
    "documents": DOCUMENTS,
    "chunks": CHUNKS,
    "chunk_embeddings": EMBEDDINGS,
    "vector_lists": VECTOR_LISTS,
    "postings": POSTINGS,
    "symbols": SYMBOLS,
    "symbol_refs": SYMBOL_REFS,
    "index_runs": INDEX_RUNS,
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
