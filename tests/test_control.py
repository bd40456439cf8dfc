import json
import os
import random

import pytest

from lodeframe.functions import paths
from lodeframe.plans import config as cfg
from lodeframe.plans.projects import Registry, integrity, project_of
from lodeframe.plans.service import Cache, bounded
from lodeframe.sources import files


def write(top, tree):
    for name, text in tree.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)


def names(spark, top, **how):
    return {r["path"] for r in files.list_tree(spark, top, files.Filter(**how)).collect()}


def test_listing_against_a_walk(spark, tmp_path):
    """A random tree, with links, empty folders and excluded ones, gives what a walk gives; the driver lists nothing."""
    rng = random.Random(1)
    folders = [tmp_path / "t"]
    for i in range(40):
        folders.append(rng.choice(folders) / rng.choice([f"d{i}", f".d{i}", f"_x{i}", f"e{i}", "skip" if i % 2 else f"skip-{i}"]))
        folders[-1].mkdir(parents=True, exist_ok=True)
    for i in range(400):
        (rng.choice(folders) / rng.choice([f"f{i}.py", f".f{i}", f"_f{i}.md"])).write_text("x" * i)
    (tmp_path / "t/link.py").symlink_to(next((tmp_path / "t").rglob("*.md")))
    (tmp_path / "t/loop").symlink_to(tmp_path / "t", target_is_directory=True)
    keep = files.Filter(exclude_patterns=["skip", "skip-*"])
    want = set()
    for folder, inner, found in os.walk(tmp_path / "t"):
        inner[:] = [n for n in inner if keep.keeps_dir(n)]
        want |= {os.path.realpath(os.path.join(folder, n)) for n in found}
    rows = files.list_tree(spark, tmp_path / "t", keep, folders_per_task=3).collect()
    assert {os.path.realpath(r["full"]) for r in rows} == want and len(want) > 50
    assert all(r["size"] == os.stat(r["full"]).st_size for r in rows)
    read = files.read_tree(spark, tmp_path / "t", keep, bytes_per_task=500)
    assert read.rdd.getNumPartitions() > 3 and read.where("skip_reason IS NULL").count() == len(rows)
    assert files.list_tree(spark, tmp_path / "nowhere").count() == 0


def test_listing(spark, tmp_path):
    write(tmp_path, dict.fromkeys([".local/x.py", ".local/nested/y.md", ".env.json", "src/.env.local", "src/app.py", "local/keep.py", ".github/workflows/ci.yml", "github/other.yml", "node_modules/a.js"], "x"))
    assert names(spark, tmp_path, exclude_globs=[".local/**", "*.env*"], exclude_patterns=["node_modules"], include_patterns=[".py"]) == {"src/app.py", "local/keep.py"}
    assert names(spark, tmp_path, include_dirs=[".github"]) == {".github/workflows/ci.yml"}


def test_reading(tmp_path):
    (tmp_path / "b").write_bytes(b"a\0b")
    (tmp_path / "w").write_bytes("café".encode("cp1252"))
    assert files.read_one(str(tmp_path / "b"))[1] == "binary"
    assert files.read_one(str(tmp_path / "w"))[0] == "café"
    assert files.read_one(str(tmp_path / "w"), 2)[1] == "too_large"
    assert files.read_one(str(tmp_path / "none"))[1] == "stat_failed"
    assert not files.is_binary(b"") and files.is_binary(b"\x01\x02\x03abc")


def test_scopes():
    scopes = {"api/": ["invoice", "bill"], "web/": ["page", "invoice list"]}
    assert paths.resolve("x\\y", None, "invoice", True, scopes) == "x/y"
    assert paths.resolve(None, "src/app", None, True, scopes) == "src/app/"
    assert paths.resolve(None, None, "see src/a/b.cs now", True, scopes).endswith("src/a/b.cs")
    assert paths.resolve(None, None, "the invoice list", True, scopes) == "web/"
    assert paths.resolve(None, None, "the invoice list", False, scopes) is None
    assert paths.to_posix("././a\\b") == "a/b" and paths.prefix("old/x", {"old/": "new/"}) == "new/x"


def test_config(tmp_path):
    write(tmp_path, {"base.yaml": "embedding_dim: '64'\nunknown: 1\n", "c.yaml": "extends: base.yaml\nexclude_globs: a, b\nwrite_enabled: 'no'\n", "x.yaml": "extends: x.yaml\n"})
    c = cfg.load(str(tmp_path / "c.yaml"), {"LODEFRAME_WRITE_ENABLED": "1"})
    assert (c.embedding_dim, c.exclude_globs, c.write_enabled, c.ingest_enabled) == (64, ["a", "b"], True, True)
    assert not cfg.load(None, {"LODEFRAME_WRITE_ENABLED": "1", "LODEFRAME_INGEST_ENABLED": "0"}).ingest_enabled
    with pytest.raises(ValueError):
        cfg.load(str(tmp_path / "x.yaml"), {})


def test_registry(tmp_path):
    write(tmp_path, {"p.yaml": "projects:\n- {project_id: b, root_path: r}\n- {project_id: a, root_path: /abs}\n"})
    r = Registry(tmp_path / "p.yaml", tmp_path / "s.json")
    assert [p.project_id for p in r.all()] == ["a", "b"] and r.get("b").root_path == (tmp_path / "r").resolve()
    write(tmp_path, {"p.yaml": "projects: 5\n"})
    assert len(r.all()) == 2  # the old registry stays
    for bad in ({}, {"project_id": "x"}, 3):
        with pytest.raises(ValueError):
            project_of(bad, tmp_path, {}, tmp_path)
    r.save_state("b", last_ingest_status="success", index_version=None)
    assert json.loads((tmp_path / "s.json").read_text()) == {"b": {"last_ingest_status": "success"}}


def test_integrity(tmp_path):
    def of(state, manifest):
        p = project_of({"project_id": "x", "root_path": "/r"}, tmp_path, {"x": state}, tmp_path)
        return integrity(type(p)(**{**p.__dict__, "manifest": manifest}))["status"]

    done = {"last_ingest_status": "success", "index_version": "1"}
    assert of({}, None) == "not_indexed" and of(done, None) == "unreliable" and of(done, done) == "ok"
    assert of(done, done | {"index_version": "2"}) == "stale" and of({"last_ingest_status": "running"}, None) == "indexing"
    assert of({"last_ingest_status": "failed"}, {"last_ingest_status": "failed"}) == "unreliable"


def test_cache_and_arguments():
    c = Cache(entries=2, seconds=100)
    for k in "abc":
        c.put(k, k)
    assert c.get("a") is None and c.get("c") == "c"
    assert bounded("7", 1, 5) == 5 and bounded(None, 8, 50) == 8
    with pytest.raises(ValueError):
        bounded("x", 1, 5)
