"""One tree through ingest, the service and a snapshot."""

import json

from lodeframe.plans.config import AppConfig
from lodeframe.plans.ingest import Settings, ingest_tree
from lodeframe.plans.projects import Registry
from lodeframe.plans.service import Service
from lodeframe.sources.store import Store


def test_ingest_and_tools(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, text in {"docs/a.md": "# Billing\ninvoice totals are computed\n", "docs/b.txt": "plain words about pages\n", "docs/removed.md": "# gone\nx\n", "api/service.py": "class BillingService:\n    def compute_total(self):\n        return fetch_rows()\n", "api/use.py": "def run_it(s):\n    return compute_total(s)\n"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    (tree / "bin.dat").write_bytes(b"\0\1")
    store, settings = Store(spark, str(tmp_path / "store")), Settings(min_chunk_chars=1)
    first = ingest_tree(spark, store, "r", str(tree), "incremental", settings)
    assert (first["files_indexed"], first["files_skipped"], first["version"]) == (5, 1, 1)
    (tree / "docs/removed.md").unlink()
    (tree / "docs/b.txt").write_text("changed words\n")
    second = ingest_tree(spark, store, "r", str(tree), "incremental", settings)
    assert (second["files_indexed"], second["deleted_rows"]) == (1, 1)
    gone = store.read("documents").where("deleted_at IS NOT NULL").collect()
    assert [r["path"] for r in gone] == ["docs/removed.md"]
    assert store.read("chunks").select("chunk_id").distinct().count() == store.read("chunks").count()

    (tmp_path / "p.yaml").write_text(f"projects:\n- {{project_id: r, root_path: {tree}, scope_map: {{api/: [billing service]}}}}\n")
    service = Service(spark, store, Registry(tmp_path / "p.yaml", tmp_path / "s.json"), AppConfig(default_doc_type="", min_score=0.05))
    found = service.full_context({"project_id": "r", "query_text": "BillingService compute_total", "auto_scope": False, "explain": True})
    assert found["functional_context"]["core_files"][0]["source_path"] == "api/service.py"
    assert any(p["symbol"] == "BillingService" for p in found["decision_points"])
    total = next(p for p in found["decision_points"] if p["symbol"] == "compute_total")
    assert {"path": "api/use.py", "line": 2} in total["callers"]
    assert service.symbol_search({"project_id": "r", "name": "billing"})["count"] == 1
    names = service.export_snapshot("r", tmp_path / "snap")
    assert len(names) == 5 and json.loads((tmp_path / "snap/snapshot_index.json").read_text())["symbol_count"] == 3
