"""Ingest of a source tree: scan, classify, chunk, embed, extract, merge, and one commit."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe import schema
from lodeframe.functions import text as tx
from lodeframe.operators import chunking, declarations, embedding, merge, retrieval, symbols, vectors
from lodeframe.sources import files
from lodeframe.sources.store import Change, Store

CHUNKER_VERSION = "1"


@dataclass(frozen=True)
class Settings:
    chunk_size_text: int = 1200
    chunk_size_markdown: int = 1600
    chunk_size_code: int = 2500
    overlap: int = 300
    min_chunk_chars: int = 200
    max_file_bytes: int = files.MAX_BYTES
    dim: int = embedding.DIM
    #: A sentence-transformers model for chunks' vectors; empty: hashed word counts.
    model: str = ""
    #: Inverted lists that a new store's vectors are dealt into.
    lists: int = vectors.LISTS
    filter: files.Filter = field(default_factory=files.Filter)


def documents_of(read: DataFrame, repo_id: str) -> DataFrame:
    """Scanned files as document rows with their texts; unreadable files have a null content_hash."""
    named = files.with_norm(read).withColumn("repo_id", F.lit(repo_id))
    kind = tx.source_type(F.col("path"))
    return named.select(
        tx.uuid5(F.concat_ws(":", "repo_id", "path_norm")).alias("doc_id"),
        "repo_id",
        "path",
        "path_norm",
        tx.suffix(F.col("path")).alias("ext"),
        tx.language(F.col("path")).alias("language"),
        tx.doc_type(kind).alias("doc_type"),
        F.coalesce("size_bytes", F.octet_length("text").cast("bigint")).alias("size_bytes"),
        "mtime",
        tx.content_hash(F.col("text")).alias("content_hash"),
        F.lit(False).alias("is_generated"),
        F.lit("internal").alias("confidentiality"),
        F.create_map().cast("map<string,string>").alias("tags"),
        kind.alias("kind"),
        "text",
    )


def children(docs: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """chunks, symbols, symbol_refs of documents (doc_id, path, kind, text)."""
    keys = ["doc_id", "repo_id"]
    code = docs.where("kind = 'code'")
    heads = symbols.code_headers(code, keys)
    sizes = {"md": s.chunk_size_markdown, "text": s.chunk_size_text, "code": s.chunk_size_code}
    made = chunking.chunk_documents(docs, keys, sizes, s.overlap, s.min_chunk_chars, heads)
    chunks = made.select(
        F.sha2(F.concat_ws(":", "doc_id", F.col("chunk_index").cast("string")), 256).alias("chunk_id"),
        "*",
        tx.content_hash(F.col("text")).alias("text_hash"),
        tx.token_count(F.col("text")).alias("token_count"),
        F.struct(F.col("is_header").alias("header")).alias("quality_flags"),
    )
    found = declarations.extract_declarations(code, keys).withColumn("name_lower", F.lower("name"))
    found = found.withColumn("symbol_id", F.sha2(F.concat_ws(":", "doc_id", "kind", "name", F.col("line_start").cast("string")), 256))
    refs = symbols.extract_call_sites(code, keys).withColumnRenamed("doc_id", "caller_doc_id")
    refs = refs.withColumn("ref_id", F.sha2(F.concat_ws(":", "caller_doc_id", "callee_name", F.col("line").cast("string")), 256))
    return {"chunks": chunks, "symbols": found, "symbol_refs": refs}


def chunk_vectors(chunks: DataFrame, s: Settings) -> DataFrame:
    """doc_id, chunk_id and vector of chunks, by the model of the settings or hashed."""
    keys = ["doc_id", "chunk_id"]
    if s.model:
        return embedding.model_embedding(chunks, keys, s.model).withColumnRenamed("embedding", "vector")
    return embedding.hash_vectors(chunks, keys, dim=s.dim)


def stored_centres(store: Store, model: str, version: int | None = None) -> np.ndarray | None:
    """The centres of the store's lists, at most some hundreds; None if it has none for this model."""
    rows = store.read("vector_lists", version).where(F.col("model_id") == model).orderBy("list").collect()
    return np.array([r["centre"] for r in rows]) if rows else None


def list_rows(spark: SparkSession, model: str, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(model, i, c) for i, c in enumerate(centres.tolist())], schema.VECTOR_LISTS)


def embedded(made: DataFrame, model: str, dim: int, centres: np.ndarray) -> DataFrame:
    """Vectors (doc_id, chunk_id, vector) as rows of chunk_embeddings."""
    return vectors.assign(made, centres, "vector", dense=True).select("doc_id", "chunk_id", F.lit(model).alias("model_id"), F.lit(dim).alias("dim"), "list", F.col("vector").alias("embedding"))


def relist(spark: SparkSession, store: Store, lists: int = vectors.LISTS) -> int:
    """Fit the inverted lists anew to the vectors that the store now holds, and store these by them."""
    at = store.version()
    facts = store.manifest(at)["facts"]["chunk_embeddings"]
    rows = store.read("chunk_embeddings", at)
    centres = vectors.fit_lists(rows, "embedding", facts["dim"], lists)
    if not len(centres):
        return at
    again = vectors.assign(rows.drop("list"), centres, "embedding", dense=True)
    return store.commit({"chunk_embeddings": again, "vector_lists": list_rows(spark, facts["model"], centres)}, at, {"chunk_embeddings": facts})


def ingest(spark: SparkSession, store: Store, repo_id: str, scanned: DataFrame, mode: str = "incremental", settings: Settings = Settings(), whole: bool = True) -> dict[str, int]:
    """Bring the store to what ``scanned`` (read_tree's columns) holds; returns the run's counts.

    incremental: unchanged documents stay, vanished ones are marked deleted, unreadable ones keep what
    is stored. full: all are written anew; stored ones that were not indexed go with all their rows.
    ``whole`` false: ``scanned`` is a part of the repository, and documents outside it are left alone.

    All is read at one version. Only the buckets of changed and vanished documents are read beyond the documents table,
    and written; another writer's run in other buckets is kept, one in the same buckets makes this fail (``Conflict``)."""
    if mode not in ("incremental", "full") or mode == "full" and not whole:
        raise ValueError("mode is incremental, or full for a whole repository")
    now, at = F.current_timestamp(), store.version()
    docs = documents_of(scanned, repo_id).cache()
    stored = store.read("documents", at).where(F.col("repo_id") == repo_id)
    if not whole:
        stored = stored.join(docs.select(*merge.KEY), merge.KEY, "left_semi")
    states = merge.classify(docs, stored).cache()
    readable = docs.where("text IS NOT NULL")
    todo = readable if mode == "full" else readable.join(merge.to_index(states).select(*merge.KEY), merge.KEY, "left_semi")
    # documents keep the ids they have
    ids = stored.select(*merge.KEY, F.col("doc_id").alias("_id"))
    todo = todo.join(ids, merge.KEY, "left").withColumn("doc_id", F.coalesce("_id", "doc_id")).drop("_id")
    new = children(todo, settings)
    new["chunks"] = new["chunks"].cache()
    fresh = todo.join(new["chunks"].select("doc_id").distinct(), "doc_id", "left_semi").cache()
    if mode == "full":
        gone = stored.join(fresh.select(*merge.KEY), merge.KEY, "left_anti").select("doc_id").cache()
    else:
        gone = states.where("state = 'vanished'").select("doc_id").join(stored.where("deleted_at IS NULL"), "doc_id", "left_semi").select("doc_id").cache()
    changed = fresh.select("doc_id")
    touched = store.buckets_of(changed.unionByName(gone), version=at)
    part = lambda name: store.read(name, at, touched)
    dated = fresh.withColumns({"created_at": now, "updated_at": now, "last_indexed_at": now, "deleted_at": F.lit(None).cast("timestamp")})
    merged = merge.upsert(part("documents"), dated.select(*schema.DOCUMENTS.fieldNames()), now)
    merged = merge.without(merged, gone) if mode == "full" else merge.soft_delete(merged, gone, now)
    drop = (changed.unionByName(gone) if mode == "full" else changed).distinct()
    counts = states.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "unreadable", "vanished"))).first()
    n_seen, n_indexed, n_gone, n_chunks = docs.count(), fresh.count(), gone.count(), new["chunks"].count()
    changes: dict[str, Change] = {"documents": Change(merged, touched)} if n_indexed or n_gone else {}
    model, facts = embedding.model_id(settings.model) or embedding.MODEL_ID, {}
    if n_indexed or mode == "full" and n_gone:
        chunks = merge.replace_children(part("chunks"), drop, new["chunks"])
        changes |= {"chunks": Change(chunks, touched), "postings": Change(retrieval.posting_blocks(chunks, store.slots(at)), touched)}
        for name, key in (("symbols", "doc_id"), ("symbol_refs", "caller_doc_id")):
            changes[name] = Change(merge.replace_children(part(name), drop, new[name], key), touched)
        made, centres = chunk_vectors(new["chunks"], settings), stored_centres(store, model, at)
        facts = {"chunk_embeddings": {"dim": settings.dim, "model": model}}
        if centres is None:
            centres = vectors.fit_lists(made, "vector", settings.dim, settings.lists)
            if len(centres):
                changes["vector_lists"] = Change(list_rows(spark, model, centres))
        centres = centres if len(centres) else np.zeros((1, settings.dim))
        changes["chunk_embeddings"] = Change(merge.replace_children(part("chunk_embeddings"), drop, embedded(made, model, settings.dim, centres)), touched)
    run = spark.range(1).select(F.lit(str(uuid.uuid4())).alias("run_id"), F.lit(repo_id).alias("repo_id"), F.lit(model).alias("embedding_model"), F.lit(settings.dim).alias("dim"), F.lit(CHUNKER_VERSION).alias("chunker_version"), F.lit(json.dumps(asdict(settings), default=str)).alias("config_snapshot"), now.alias("started_at"), now.alias("finished_at"))
    changes["index_runs"] = Change(run, append=True)
    try:
        version = store.commit(changes, at, facts)
    finally:
        for df in (docs, states, fresh, gone, new["chunks"]):
            df.unpersist()
    store.fold()
    return {
        "files_seen": n_seen,
        "files_indexed": n_indexed,
        "files_skipped": (counts["unchanged"] if mode == "incremental" else 0) + counts["unreadable"],
        "chunks_written": n_chunks,
        "deleted_rows": n_gone if mode == "full" else counts["vanished"],
        "version": version,
    }


def ingest_tree(spark: SparkSession, store: Store, repo_id: str, root: str, mode: str = "incremental", settings: Settings = Settings()) -> dict[str, int]:
    return ingest(spark, store, repo_id, files.read_tree(spark, root, settings.filter, settings.max_file_bytes), mode, settings)


def fingerprint(value: object) -> str:
    """Sixteen hex digits that change with the value, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def index_fingerprint(project_id: str, stats: dict[str, int]) -> str:
    return f"{project_id}:{stats['files_indexed']}:{stats['chunks_written']}:{stats['deleted_rows']}"
