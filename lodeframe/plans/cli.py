"""Command line: init, list-projects, ingest, query, context, export-snapshot, readiness, and the servers."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from lodeframe import schema
from lodeframe.plans import config as cfg
from lodeframe.plans import transport
from lodeframe.plans.ingest import Settings, fingerprint, index_fingerprint, ingest_tree
from lodeframe.plans.projects import Registry
from lodeframe.plans.service import Service
from lodeframe.sources.files import Filter
from lodeframe.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodeframe")
    top.add_argument("--config")
    top.add_argument("--store", help="needed by every command but proxy")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("init", "list-projects", "readiness"):
        sub.add_parser(name)
    one = sub.add_parser("ingest")
    one.add_argument("--project-id", required=True)
    one.add_argument("--mode", choices=["incremental", "full"])
    for name in ("query", "context"):
        one = sub.add_parser(name)
        one.add_argument("text")
        one.add_argument("--project-id", required=True)
        one.add_argument("--top-k", type=int, default=8)
        one.add_argument("--path-prefix")
        one.add_argument("--doc-type")
    one = sub.add_parser("export-snapshot")
    one.add_argument("--project-id", required=True)
    one.add_argument("--output", required=True)
    for name in ("serve-stdio", "serve-http"):
        one = sub.add_parser(name)
        one.add_argument("--snapshots", default="snapshots", help="the folder that holds a folder for each exported project")
    one.add_argument("--host", default="127.0.0.1")
    one.add_argument("--port", type=int, default=8765)
    sub.choices["serve-stdio"].add_argument("--content-length", action="store_true", help="messages behind headers, not one to a line")
    sub.add_parser("proxy").add_argument("--url", default="http://127.0.0.1:8765/rpc")
    return top


def run_ingest(spark: SparkSession, store: Store, registry: Registry, config: cfg.AppConfig, project_id: str, mode: str | None) -> dict:
    """Ingest a project's tree and keep its state and manifest; a failure is recorded and raised."""
    project = registry.get(project_id)
    if not (config.ingest_enabled and project.ingest_enabled):
        raise PermissionError("ingest is not enabled for this project")
    now = lambda: datetime.now(timezone.utc).isoformat()
    keep = Filter(config.include_patterns, config.exclude_patterns, project.include_dirs or config.include_dirs, [*config.exclude_globs, *project.exclude_globs], config.never_index_ext, config.assets_template_only, config.assets_root_dir, config.assets_template_dir)
    settings = Settings(config.chunk_size, config.md_chunk_size, config.code_chunk_size, config.chunk_overlap, config.min_chunk_chars, config.max_bytes, config.embedding_dim, config.embedding_model, filter=keep)
    started = now()
    registry.save_state(project_id, last_ingest_status="running", last_ingest_started_at=started)
    registry.save_manifest(project_id, last_ingest_status="running", last_ingest_started_at=started, last_error=None)
    try:
        stats = ingest_tree(spark, store, project_id, str(project.root_path), mode or ("incremental" if config.incremental_ingest else "full"), settings)
    except Exception as e:
        registry.save_state(project_id, last_ingest_status="failed", last_ingest_finished_at=now())
        registry.save_manifest(project_id, last_ingest_status="failed", last_error=str(e)[:2000])
        raise
    done, version, print_ = now(), str(stats["version"]), index_fingerprint(project_id, stats)
    registry.save_state(project_id, last_ingest_status="success", last_ingest_finished_at=done, last_successful_ingest_at=done, index_version=version, index_fingerprint=print_)
    registry.save_manifest(project_id, last_ingest_status="success", last_ingest_completed_at=done, index_version=version, index_fingerprint=print_, config_fingerprint=fingerprint(config.__dict__), indexed_documents=stats["files_indexed"], indexed_chunks=stats["chunks_written"], store_target={"store": store.root}, last_error=None)
    return stats


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    token = os.environ.get("LODEFRAME_TOKEN", "").strip() or None
    if args.command == "proxy":
        transport.proxy(sys.stdin.buffer, sys.stdout.buffer, args.url, token)
        return 0
    if not args.store:
        parser().error("--store is needed")
    spark = spark or SparkSession.builder.appName("lodeframe").getOrCreate()
    config = cfg.load(args.config)
    store, registry = Store(spark, args.store), Registry(config.projects_registry_path, config.projects_state_path)
    service = Service(spark, store, registry, config)
    show = lambda x: print(json.dumps(x, indent=2, ensure_ascii=False, default=str))
    if args.command == "init":
        if not store.version():
            store.commit({name: schema.empty(spark, name) for name in schema.TABLES})
        show({"version": store.version()})
    elif args.command == "list-projects":
        show(service.list_projects())
    elif args.command == "readiness":
        show(service.readiness())
    elif args.command == "ingest":
        show(run_ingest(spark, store, registry, config, args.project_id, args.mode))
    elif args.command == "serve-stdio":
        transport.serve_stdio(transport.Dispatcher(service, args.snapshots), sys.stdin.buffer, sys.stdout.buffer, args.content_length)
    elif args.command == "serve-http":
        transport.server(transport.Dispatcher(service, args.snapshots), args.host, args.port, token).serve_forever()
    elif args.command == "export-snapshot":
        show(service.export_snapshot(args.project_id, args.output))
    else:
        given = {"query_text": args.text, "project_id": args.project_id, "top_k": args.top_k, "path_prefix": args.path_prefix, "doc_type": args.doc_type}
        if args.command == "context":
            print(service.context(given)["functional_context"]["assembled_context"])
        else:
            for r in service.search(given)["results"]:
                print(f"{r['rank']}. {r['source_path']}#L{r['line_start']}-L{r['line_end']} score={r['score']:.4f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
