"""Symbol and caller lookups, repository statistics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words that name no symbol
STOP = [
    "apri", "open", "show", "mostra", "trova", "find", "cerca", "usa", "call",
    "chiama", "metodo", "method", "classe", "class", "interfaccia", "interface", "servizio", "service",
]


def live(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("deleted_at").isNull())


def search_symbols(symbols: DataFrame, documents: DataFrame, name: str, repo_id: str | None = None, kind: str | None = None, language: str | None = None, exact: bool = False, limit: int = 20, include_deleted: bool = True) -> DataFrame:
    """Symbols by name or by its beginning, in any case. ``name_lower`` is stored, so that the filter
    reaches the scan. Symbols of soft-deleted documents are found too unless told otherwise."""
    low = F.lit(name.lower())
    found = symbols.where(F.col("name_lower") == low if exact else F.startswith(F.col("name_lower"), low))
    for column, value in (("repo_id", repo_id), ("kind", kind), ("language", language)):
        if value:
            found = found.where(F.col(column) == value)
    docs = documents if include_deleted else live(documents)
    joined = found.join(docs.select("doc_id", F.col("path").alias("source_path")), "doc_id")
    return joined.orderBy("name", "line_start", "source_path", "symbol_id").limit(limit)


def caller_sites(refs: DataFrame, documents: DataFrame, callee: str, repo_id: str | None = None, limit: int = 50) -> DataFrame:
    found = refs.where(F.lower("callee_name") == callee.lower())
    if repo_id:
        found = found.where(F.col("repo_id") == repo_id)
    return found.join(live(documents).select(F.col("doc_id").alias("caller_doc_id"), "path"), "caller_doc_id").select("path", "line").orderBy("path", "line").limit(limit)


def callers_by_name(symbols: DataFrame, refs: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """For each distinct name of ``symbols`` its first callers: name, callers array<struct<path, line>>.

    One join for all names; the limit runs before the lists are gathered."""
    names = symbols.select("name").distinct().withColumn("low", F.lower("name"))
    sites = refs.select(F.lower("callee_name").alias("low"), "caller_doc_id", "line").join(live(documents).select(F.col("doc_id").alias("caller_doc_id"), "path"), "caller_doc_id")
    first = sites.withColumn("rn", F.row_number().over(Window.partitionBy("low").orderBy("path", "line"))).where(F.col("rn") <= limit)
    lists = first.groupBy("low").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("callers"))
    return names.join(lists, "low", "left").select("name", F.coalesce("callers", F.array().cast("array<struct<path:string,line:int>>")).alias("callers"))


def repo_stats(documents: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, documents, chunks, symbols: counts over live documents, repository by repository."""
    docs = live(documents).select("repo_id", "doc_id")
    count = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    per_doc = lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(docs, "doc_id").groupBy("repo_id")
    out = count(docs, "documents").join(per_doc(chunks).agg(F.sum("n").alias("chunks")), "repo_id", "left").join(per_doc(symbols).agg(F.sum("n").alias("symbols")), "repo_id", "left")
    return out.select("repo_id", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


def looks_like_symbol(word: str) -> bool:
    """True for words that are shaped like identifiers: with ``_``, an inner capital, or not all lower."""
    if len(word) < 3 or word.lower() in STOP:
        return False
    return "_" in word or word[1:] != word[1:].lower() or word.isidentifier() and word != word.lower()


def symbol_candidates(query: str | None, most: int = 4) -> list[str]:
    """The first words shaped like symbols, each once in any case."""
    first: dict[str, str] = {}
    for word in [w for w in re.findall("[A-Za-z0-9_]+", query or "") if looks_like_symbol(w)][:most]:
        first.setdefault(word.lower(), word)
    return list(first.values())


def context_symbols(symbols: DataFrame, documents: DataFrame, candidates: DataFrame, each: int = 5) -> DataFrame:
    """For queries' candidate words (query_id, candidate, position): the symbols that begin with one,
    at most ``each`` a word, a symbol once per query. An equi-join on the first two letters, then the whole beginning."""
    words = candidates.withColumn("low", F.lower("candidate")).withColumn("head", F.substring("low", 1, 2))
    hits = symbols.withColumn("head", F.substring("name_lower", 1, 2)).join(words, "head").where(F.startswith("name_lower", F.col("low")))
    named = hits.join(documents.select("doc_id", F.col("path").alias("source_path")), "doc_id")
    ranked = named.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "position").orderBy("name", "line_start", "source_path", "symbol_id"))).where(F.col("rn") <= each)
    once = Window.partitionBy("query_id", "source_path", "name", "kind").orderBy("position", "rn")
    return ranked.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("query_id", "position", "rn", "source_path", "name", "kind", "namespace", "signature", "line_start", "line_end")
