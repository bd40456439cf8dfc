"""The tools a client calls, over a store: thin control flow around the DataFrame plans."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import replace
from pathlib import Path
from time import monotonic
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import paths
from lodeframe.functions import text as tx
from lodeframe.operators import assemble, embedding, lookup, retrieval, workitem
from lodeframe.plans.config import AppConfig, as_bool
from lodeframe.plans.projects import Project, Registry, integrity, integrity_counts
from lodeframe.sources.store import Store

MAX_TOP_K, MAX_SYMBOLS, MAX_CHARS, MAX_QUERY_CHARS = 50, 200, 100_000, 8000
CACHE_ENTRIES, CACHE_SECONDS = 500, 1800


def bounded(value: Any, default: int, most: int) -> int:
    """An integer argument, at least 1 and at most ``most``."""
    try:
        return max(1, min(int(value), most)) if value is not None else default
    except (TypeError, ValueError) as e:
        raise ValueError(f"not an integer: {value!r}") from e


class Cache:
    """Results by the digest of their query and the index version; the oldest goes first."""

    def __init__(self, entries: int = CACHE_ENTRIES, seconds: float = CACHE_SECONDS) -> None:
        self.entries, self.seconds, self.held = entries, seconds, {}

    @staticmethod
    def key(**values: Any) -> str:
        return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str) -> Any:
        at, value = self.held.get(key, (0.0, None))
        if value is not None and monotonic() - at > self.seconds:
            del self.held[key]
            return None
        return value

    def put(self, key: str, value: Any) -> None:
        if len(self.held) >= self.entries and key not in self.held:
            del self.held[min(self.held, key=lambda k: self.held[k][0])]
        self.held[key] = (monotonic(), value)


class Service:
    def __init__(self, spark: SparkSession, store: Store, registry: Registry, config: AppConfig | None = None) -> None:
        self.spark, self.store, self.registry, self.config, self.cache = spark, store, registry, config or AppConfig(), Cache()

    # --- arguments --------------------------------------------------------------------------

    def _project(self, args: dict[str, Any]) -> Project:
        name = str(args.get("project_id") or "").strip()
        if not name:
            raise ValueError("project_id is required")
        return self.registry.get(name)

    def _setting(self, project: Project, name: str) -> dict:
        return getattr(project, name) or getattr(self.config, name)

    def _query(self, args: dict[str, Any]) -> tuple[str | None, list[float] | None]:
        text, vector = args.get("query_text"), args.get("query_embedding")
        if text is None and vector is None:
            raise ValueError("query_text or query_embedding is required")
        if text is not None and len(str(text)) > MAX_QUERY_CHARS:
            raise ValueError(f"query_text exceeds {MAX_QUERY_CHARS} characters")
        if vector is not None:
            if not isinstance(vector, list) or len(vector) != self.config.embedding_dim:
                raise ValueError(f"query_embedding needs {self.config.embedding_dim} numbers")
            vector = [float(x) for x in vector]
        for name in ("embedder", "embedding_model", "embedding_dim", "dsn"):
            if name in args:
                raise ValueError(f"{name} is the server's to set")
        return text, vector

    # --- retrieval --------------------------------------------------------------------------

    def documents(self, repo_id: str, path_prefix: str | None, doc_type: str | None, language: str | None, version: int | None = None) -> DataFrame:
        return retrieval.scoped(lookup.live(self.store.read("documents", version)), repo_id, path_prefix, doc_type, language)

    def chunks(self, repo_id: str, path_prefix: str | None, doc_type: str | None, language: str | None, version: int | None = None) -> DataFrame:
        shown = self.documents(repo_id, path_prefix, doc_type, language, version).select("doc_id", F.col("path").alias("source_path"), "path_norm")
        return self.store.read("chunks", version).join(shown, "doc_id")

    def _asked(self, asked: DataFrame, vector: list[float] | None) -> DataFrame:
        """query_id and vector of questions: as given, by the model of the stored vectors, or hashed."""
        if vector is not None:
            return asked.select("query_id", F.lit(vector).cast("array<double>").alias("vector"))
        if self.config.embedding_model:
            return embedding.model_embedding(asked, ["query_id"], self.config.embedding_model, "query_text").withColumnRenamed("embedding", "vector")
        return embedding.hash_vectors(asked, ["query_id"], "query_text", self.config.embedding_dim)

    def _postings(self, terms: DataFrame, version: int) -> DataFrame:
        """The parts of the posting lists that hold some terms."""
        return self.store.read("postings", version, parts=self.store.parts_of("postings", terms, "token"))

    def searched(self, text: str | None, vector: list[float] | None, prefix: str | None, auto: bool, o: retrieval.Options, **scope: Any) -> tuple[list[dict], dict[str, Any]]:
        """The ranked hits of one question, and how its cascade went."""
        version = self.store.version()
        docs = self.documents(path_prefix=None, version=version, **scope)
        chunks = self.chunks(path_prefix=None, version=version, **scope)
        asked = self.spark.createDataFrame([(0, text or "", prefix, auto)], "query_id bigint, query_text string, prefix string, auto boolean")
        wanted, terms = self._asked(asked, vector), retrieval.query_terms(asked)
        index, blocks = self.store.read("chunk_embeddings", version), self._postings(terms, version)
        low = replace(o, min_score=min(o.min_score, o.min_score_floor))

        def run(own: DataFrame) -> DataFrame:
            within = retrieval.area_documents(docs, own)
            nearest = retrieval.area_vector_topk(index, within, wanted.join(own.select("query_id"), "query_id"), o.candidates, self.config.embedding_dim)
            keyword = retrieval.block_topk(blocks, terms.join(own.select("query_id"), "query_id"), o.candidates, within)
            return retrieval.fuse(nearest, keyword, chunks, low, 1)

        hits, facts = retrieval.cascade(asked, run, o)
        rows = hits.withColumn("snippet", tx.snippet(F.col("text"), F.lit(text or ""))).orderBy("rank").collect()
        return [r.asDict(recursive=True) for r in rows], {k: x for k, x in facts.first().asDict().items() if k != "query_id"}

    def context(self, args: dict[str, Any], cached: bool = True) -> dict[str, Any]:
        """Ranked hits and symbols assembled into files, entry points and a text."""
        text, vector = self._query(args)
        project = self._project(args)
        top_k, max_chars = bounded(args.get("top_k"), 8, MAX_TOP_K), bounded(args.get("max_chars"), 12_000, MAX_CHARS)
        given, file, auto = args.get("path_prefix"), args.get("file"), as_bool(args.get("auto_scope", True))
        doc_type, language = args.get("doc_type") or self.config.default_doc_type, args.get("language")
        key = self.cache.key(version=self.store.version(), text=str(text).strip().lower(), project=project.project_id, top_k=top_k, max_chars=max_chars, prefix=given, file=file, auto=auto, doc_type=doc_type, language=language)
        if cached and vector is None and (held := self.cache.get(key)) is not None:
            return held
        scope = paths.resolve(given, file, text, auto, self._setting(project, "scope_map"), self._setting(project, "path_aliases"))
        o = self.config.options(top_k)
        results, facts = self.searched(text, vector, scope, auto and not (given or file), o, repo_id=project.project_id, doc_type=doc_type, language=language)
        found = self._symbols(text, project.project_id)
        payload = {
            "functional_context": self._assembled(text, results, found, facts["path_prefix"], max_chars),
            "context": self._text(assemble.context_texts(self._hits(results), max_chars), "context"),
            "results": results,
            "symbol_results": found,
            "meta": {"project_id": project.project_id, "top_k": top_k, "max_chars": max_chars, **facts},
        }
        if not results:
            tried = facts["auto_scope_fallback_used"] or facts["relaxed_min_score_fallback_used"]
            payload["meta"]["no_match_reason"] = {"threshold_was": facts["min_score"], "all_fallbacks_attempted": tried, "suggestion": "Use a shorter or more specific query, a wider prefix, or check that the project is indexed."}
        elif cached and vector is None:
            self.cache.put(key, payload)
        return payload

    def _symbols(self, text: str | None, repo_id: str) -> list[dict[str, Any]]:
        words = [(0, w, i) for i, w in enumerate(lookup.symbol_candidates(text))]
        if not words or not self.config.symbol_search_enabled:
            return []
        asked = self.spark.createDataFrame(words, "query_id bigint, candidate string, position int")
        mine = self.store.read("symbols").where(F.col("repo_id") == repo_id)
        return [r.asDict() for r in lookup.context_symbols(mine, self.store.read("documents"), asked).orderBy("position", "rn").collect()]

    def _hits(self, results: list[dict]) -> DataFrame:
        return self.spark.createDataFrame(
            [(0, r["rank"], r["source_path"], float(r["score"]), r["text_hash"], r["line_start"], r["line_end"], r["chunk_index"], r["section_path"], r["snippet"], r["text"]) for r in results],
            "query_id bigint, rank int, source_path string, score double, text_hash string, line_start int, line_end int, chunk_index int, section_path string, snippet string, text string",
        )

    @staticmethod
    def _text(rendered: DataFrame, column: str) -> str:
        row = rendered.first()
        return row[column] if row else ""

    def _assembled(self, text: str | None, results: list[dict], found: list[dict], prefix: str | None, max_chars: int) -> dict[str, Any]:
        limits, hits = assemble.Limits(max_chars=max_chars), self._hits(results)
        symbols = self.spark.createDataFrame(
            [(0, s["source_path"], s["name"], s["kind"], s["namespace"], s["signature"], s["line_start"], s["line_end"]) for s in found],
            "query_id bigint, source_path string, name string, kind string, namespace string, signature string, line_start int, line_end int",
        )
        asked = self.spark.createDataFrame([(0, text or "")], "query_id bigint, query_text string")
        core = assemble.core_files(assemble.file_groups(hits, symbols, asked, limits), limits).cache()
        files = [r.asDict(recursive=True) for r in core.orderBy("place").collect()]
        supporting = [r.asDict() for r in assemble.supporting_matches(hits, core, limits).orderBy("place").collect()]
        entries = [r.asDict() for r in assemble.entry_points(symbols, core, limits).orderBy("place").collect()]
        body = self._text(assemble.rendered(core, max_chars), "assembled_context")
        core.unpersist()
        terms = list(dict.fromkeys(re.findall("[a-z0-9_]{3,}", (text or "").lower())))
        roles = [f["functional_role"] for f in files]
        return {
            "package_version": "functional_context_v1",
            "query": {"text": text, "path_prefix": prefix, "terms": terms},
            "summary": {"core_file_count": len(files), "supporting_match_count": len(supporting), "symbol_hit_count": len(found), "query_term_count": len(terms), "assembled_char_count": len(body), "role_counts": {r: roles.count(r) for r in dict.fromkeys(roles)}},
            "core_files": files,
            "supporting_matches": supporting,
            "entry_points": entries,
            "assembled_context": body,
            "tool_hints": self._hints(text, files, found, results),
        }

    @staticmethod
    def _hints(text: str | None, files: list[dict], found: list[dict], results: list[dict]) -> dict[str, Any]:
        """Names worth a symbol search: of core files, else of symbols found, else of the question."""
        names = [s["name"] for f in files for s in f["symbol_hits"]] or [s["name"] for s in found] or lookup.symbol_candidates(text)
        names = list(dict.fromkeys(names))[:6]
        follow = {"suggested_names": names, "suggested_queries": [{"name": n, "exact": True} for n in names], "focus_paths": [f["source_path"] for f in files][:4]}
        return {"primary_tool": "rag_context", "symbol_follow_up": follow, "recommended_follow_up": [{"tool": "symbol_search", **follow}, {"tool": "rag_search", "reason": "raw matches" if results else "a broader query"}, {"tool": "context_info"}]}

    def search(self, args: dict[str, Any]) -> dict[str, Any]:
        """Hits grouped by file, with a summary and what to do next."""
        base = self.context(args, cached=False)
        results, meta = base["results"], base["meta"]
        rows = self.spark.createDataFrame([(0, r["rank"], r["source_path"], float(r["score"]), r["line_start"], r["line_end"], r["snippet"], r["text"]) for r in results], "query_id bigint, rank int, source_path string, score double, line_start int, line_end int, snippet string, text string")
        groups = [r.asDict() for r in assemble.search_groups(rows).orderBy("place").collect()]
        n = len(groups)
        coverage = "no_hits" if not n else "single_hotspot" if n == 1 else "focused_multi_file" if n <= 3 else "broad_spread"
        steps = ["Confirm one of the top files."] if groups else ["Broaden the query or remove narrow filters."]
        if meta["auto_scope_fallback_used"]:
            steps.append("The inferred scope did not hold: give a scope or a more explicit query.")
        hints = base["functional_context"]["tool_hints"]["symbol_follow_up"]
        return {
            "query": {"text": args.get("query_text"), "path_prefix": meta["path_prefix"], "top_k": meta["top_k"], "doc_type": args.get("doc_type") or self.config.default_doc_type, "language": args.get("language")},
            "summary": {"result_count": len(results), "unique_file_count": n, "top_score": max((r["score"] for r in results), default=0.0), "auto_scope_fallback_used": meta["auto_scope_fallback_used"], "coverage": coverage},
            "result_groups": groups,
            "investigation_hints": {"mode": "raw_investigation", "suggested_files": [g["source_path"] for g in groups][:4], "suggested_symbol_queries": hints["suggested_queries"][:4], "recommended_next_steps": steps},
            "results": results,
            "meta": meta | {"search_mode": "investigation"},
        }

    def full_context(self, args: dict[str, Any]) -> dict[str, Any]:
        """Context with the callers of its entry points (one join for all) and a confidence."""
        base = self.context(args, cached=False)
        context, project = base["functional_context"], base["meta"]["project_id"]
        core = {f["source_path"]: f for f in context["core_files"]}
        names = [(e["name"],) for e in context["entry_points"] if e["name"]]
        callers: dict[str, list] = {}
        if names:
            refs = self.store.read("symbol_refs").where(F.col("repo_id") == project)
            found = lookup.callers_by_name(self.spark.createDataFrame(names, "name string"), refs, self.store.read("documents"), 10)
            callers = {r["name"]: [c.asDict() for c in r["callers"]] for r in found.collect()}
        points = []
        for e in context["entry_points"]:
            point = {"symbol": e["name"], "kind": e["kind"], "path": e["source_path"], "lines": [e["line_start"], e["line_end"]], "signature": e["signature"]}
            if callers.get(e["name"]):
                point |= {"callers": callers[e["name"]], "impact_summary": f"{len(callers[e['name']])} call site(s) refer to it"}
            if as_bool(args.get("explain", False)) and e["source_path"] in core:
                point |= {k: core[e["source_path"]][k] for k in ("selection_reason", "functional_role")}
            points.append(point)
        scores = [f["max_score"] for f in core.values() if f["max_score"]]
        return {
            "context": base["context"],
            "functional_context": context,
            "symbols": base["symbol_results"] if as_bool(args.get("include_symbols", True)) else [],
            "decision_points": points,
            "confidence": round(sum(scores) / len(scores), 4) if scores else 0.0,
            "fallback_used": base["meta"]["auto_scope_fallback_used"] or base["meta"]["relaxed_min_score_fallback_used"],
            "meta": base["meta"],
        }

    def symbol_search(self, args: dict[str, Any]) -> dict[str, Any]:
        name = str(args.get("name") or "").strip()
        if not name:
            raise ValueError("name is required")
        project = self._project(args)
        rows = lookup.search_symbols(self.store.read("symbols"), self.store.read("documents"), name, project.project_id, args.get("kind"), args.get("language"), as_bool(args.get("exact", False)), bounded(args.get("limit"), 20, MAX_SYMBOLS))
        results = [r.asDict() for r in rows.collect()]
        return {"query": name, "count": len(results), "results": results}

    def map_work_item(self, args: dict[str, Any]) -> dict[str, Any]:
        summary, description = str(args.get("summary") or ""), str(args.get("description") or "")
        project = self._project(args)
        base = self.context({**args, "query_text": f"{summary} {description}".strip()[:MAX_QUERY_CHARS] or "-"}, cached=False)["functional_context"]
        frame = lambda rows, kind, *fields: self.spark.createDataFrame([(0, *(r[f] for f in fields)) for r in rows], f"query_id bigint, {kind}")
        core = frame(base["core_files"], "place int, source_path string, aggregate_score double", "place", "source_path", "aggregate_score")
        supporting = frame(base["supporting_matches"], "place int, source_path string", "place", "source_path")
        entries = frame(base["entry_points"], "place int, source_path string, name string", "place", "source_path", "name")
        items = self.spark.createDataFrame([(0, summary, description, args.get("product_target_hint"), project.root_path.name or project.project_id)], "query_id bigint, summary string, description string, hint string, repo_target string")
        count = self.spark.createDataFrame([(0, base["summary"]["symbol_hit_count"])], "query_id bigint, symbols int")
        row = workitem.map_items(items, core, supporting, entries, count, self._setting(project, "product_targets"), self._setting(project, "product_aliases")).first().asDict()
        row.pop("query_id")
        return row | {"ticket_key": args.get("ticket_key"), "project_id": project.project_id, "workspace_root": str(project.root_path)}

    # --- projects ---------------------------------------------------------------------------

    def list_projects(self) -> dict[str, Any]:
        every = self.registry.all()
        return {"projects": [p.public() for p in every], "integrity": integrity_counts(every)}

    def project_info(self, args: dict[str, Any]) -> dict[str, Any]:
        project = self._project(args)
        mine = self.store.read("documents").where(F.col("repo_id") == project.project_id)
        stats = lookup.repo_stats(mine, self.store.read("chunks"), self.store.read("symbols")).first()
        return project.public() | {"stats": stats.asDict() if stats else {"documents": 0, "chunks": 0, "symbols": 0}}

    def readiness(self) -> dict[str, Any]:
        """ready, degraded or blocked, with what stands in the way."""
        every = self.registry.all()
        broken = [p.project_id for p in every if integrity(p)["status"] in ("unreliable", "stale")]
        blockers = [] if self.store.version() else ["the store has no version yet"]
        blockers += [] if every else ["no project is registered"]
        warnings = [f"project {p} is not to be relied on" for p in broken]
        return {"status": "blocked" if blockers else "degraded" if warnings else "ready", "blockers": blockers, "warnings": warnings, "checks": {"store_version": self.store.version(), "projects": len(every)}}

    def context_info(self) -> dict[str, Any]:
        tools = ("rag_context", "rag_search", "rag_full_context", "symbol_search", "map_work_item_to_codebase", "list_projects", "get_project_info", "get_project_snapshot", "context_info")
        return {"tools": list(tools), "limits": {"top_k": MAX_TOP_K, "symbols": MAX_SYMBOLS, "max_chars": MAX_CHARS, "query_chars": MAX_QUERY_CHARS}, "readiness": self.readiness()}

    # --- snapshots --------------------------------------------------------------------------

    def export_snapshot(self, project_id: str, out: str | Path, top: int = 20) -> list[str]:
        """Four JSON files and a text that describe a project: one retrieval for all its areas."""
        project = self.registry.get(project_id)
        scopes = self._setting(project, "scope_map") or {"": ["main", "functionality", "entry"]}
        areas = [(i, p, ks) for i, (p, ks) in enumerate(scopes.items()) if ks]
        docs, refs = self.store.read("documents"), self.store.read("symbol_refs")
        mine = self.store.read("symbols").where(F.col("repo_id") == project_id)
        catalog = mine.join(lookup.live(docs).select("doc_id", F.col("path").alias("source_path")), "doc_id").select("name", "kind", "namespace", "line_start", "line_end", "signature", "language", "source_path")
        asked = self.spark.createDataFrame([(i, " ".join(ks[:3]), p) for i, p, ks in areas], "query_id bigint, query_text string, prefix string")
        chunks = self.chunks(project_id, None, None, None)
        # both legs, their normaliser and their top k are those of each area by itself
        within = retrieval.area_documents(self.documents(project_id, None, None, None), asked)
        o = retrieval.Options(top_k=12, max_chunks_per_doc=3, min_score=self.config.min_score)
        vector = retrieval.area_vector_topk(self.store.read("chunk_embeddings"), within, self._asked(asked, None), o.candidates, self.config.embedding_dim)
        terms = retrieval.query_terms(asked)
        keyword = retrieval.block_topk(self._postings(terms, self.store.version()), terms, o.candidates, within)
        hits = retrieval.retrieve(chunks, vector, keyword, asked, o).withColumn("snippet", tx.snippet(F.col("text")))
        found = catalog.join(hits.select("query_id", "source_path").distinct(), "source_path")
        core = assemble.core_files(assemble.file_groups(hits, found, asked)).cache()
        best = [r.asDict(recursive=True) for r in workitem.top_files(core, top).collect()]
        names = sorted({s["name"] for f in best for s in f["key_symbols"]})
        callers: dict[str, list] = {}
        if names:
            rows = lookup.callers_by_name(self.spark.createDataFrame([(x,) for x in names], "name string"), refs.where(F.col("repo_id") == project_id), docs, 20).collect()
            callers = {r["name"]: [c.asDict() for c in r["callers"]] for r in rows if r["callers"]}
        files = [r.asDict(recursive=True) for r in core.orderBy("query_id", "place").collect()]
        core.unpersist()
        symbols = [r.asDict() | {"callers": callers.get(r["name"], [])} for r in catalog.orderBy("source_path", "line_start", "name").toLocalIterator()]
        shown = [{"area_name": "/".join(x for x in p.replace("\\", "/").split("/") if x) or "general", "path_prefix": p or None, "query_terms": ks, "core_files": [f for f in files if f["query_id"] == i]} for i, p, ks in areas]
        info = self.project_info({"project_id": project_id})
        parts = {"snapshot_index.json": {"project_id": project_id, "stats": info["stats"], "area_count": len(shown), "top_file_count": len(best), "symbol_count": len(symbols), "has_caller_sites": bool(callers)}, "symbols_catalog.json": symbols, "functional_areas.json": shown, "top_files.json": best}
        folder = Path(out)
        folder.mkdir(parents=True, exist_ok=True)
        for name, data in parts.items():
            (folder / name).write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
        text = [f"# {project.display_name}", "", f"Documents: {info['stats']['documents']}, chunks: {info['stats']['chunks']}, symbols: {len(symbols)}", ""]
        for a in shown:
            text += [f"## {a['area_name']}", *(f"- {f['source_path']} ({f['functional_role']}, {f['aggregate_score']:.2f})" for f in a["core_files"]), ""]
        text += ["## Top files", *(f"{i}. {f['source_path']}: {', '.join(s['name'] for s in f['key_symbols'][:5])}" for i, f in enumerate(best, 1)), ""]
        (folder / "CONTEXT.md").write_text("\n".join(text), encoding="utf-8")
        return [str(folder / name) for name in (*parts, "CONTEXT.md")]

    def snapshot(self, args: dict[str, Any], folder: str | Path) -> Any:
        """A part of an exported snapshot: index, symbols, areas, top_files or context."""
        names = {"index": "snapshot_index.json", "symbols": "symbols_catalog.json", "areas": "functional_areas.json", "top_files": "top_files.json", "context": "CONTEXT.md"}
        part = str(args.get("part") or "index")
        if part not in names:
            raise ValueError(f"part is one of {', '.join(names)}")
        at = Path(folder) / names[part]
        if not at.exists():
            raise ValueError("no snapshot; export one first")
        text = at.read_text(encoding="utf-8")
        return text if part == "context" else json.loads(text)
