"""A small repository, indexed, changed and indexed again."""

from __future__ import annotations

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph
from codeloom.plans import store as stores
from codeloom.plans.config import Config
from codeloom.plans.repository import NotIndexedError, Repository
from codeloom.plans.tools import Tools

GO = """package work

// Limit is the most.
const Limit = 3

// Runner runs.
type Runner struct{ n int }

// Start starts it. Later text.
func (r *Runner) Start(x int) error {
\thelper(x)
\treturn nil
}

func helper(x int) int { return x }
"""
PY = '''class Box:
    """Box holds."""

    @property
    def size(self):
        return len(self.items)


def build():
    return Box()
'''


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "repo"
    for name, text in {
        "go.mod": "module x\n",
        "pkg/work.go": GO,
        "lib/box.py": PY,
        "lib/__init__.py": "",
        "lib/bad.py": "def (:\n",
        "node_modules/x.js": "function no() {}",
        ".gitignore": "*.tmp\nskip/\n",
        "skip/a.py": "def a(): pass\n",
        "note.tmp": "x",
        ".env": "API_KEY=\nHOST='h'\nTOKEN=changeme\n# no\nHOST=two\n",
    }.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return top


@pytest.fixture
def repo(spark, root, tmp_path):
    return Repository(spark, str(root), Config(cache_root=str(tmp_path / "cache")))


def names(df):
    return {r.name for r in df.select("name").collect()}


def test_index_and_queries(repo, spark, root):
    said = repo.index()
    assert said.mode == "filesystem" and len(said.warnings) == 1
    assert names(repo.symbols) == {"Limit", "Runner", "Start", "helper", "Box", "size", "build"}
    paths = {r.path for r in repo.files.collect()}
    assert "lib/__init__.py" in paths and "skip/a.py" not in paths and "note.tmp" not in paths and "node_modules/x.js" not in paths

    start = repo.symbols.filter("name = 'Start'").first()
    assert (start.qualified_name, start.signature, start.summary) == ("pkg.Runner.Start", "func (Runner) Start(x int)", "Start starts it.")
    assert start.package_root == "." and start.line_start == 10
    assert repo.symbols.filter("name = 'size'").first().kind == "method"

    edge = repo.edges.filter(F.col("caller_id") == start.id).first()
    assert edge.callee_id == repo.symbols.filter("name = 'helper'").first().id
    deps = repo.deps(start.id, "calls").collect()
    assert [d.qualified_name for d in deps] == ["pkg.helper"]
    assert repo.deps(start.id, "sideways").count() == 0
    with pytest.raises(graph.UnknownSymbolError):
        repo.deps("nope")

    assert repo.search("Sta").first()["name"] == "Start"
    assert repo.search("start", kind="function").count() == 0
    assert repo.search("a.b").count() == 0
    symbols, files = repo.get([start.id], [".env", "pkg/work.go"], 1)
    assert symbols.first().source.startswith("\nfunc (r *Runner) Start")
    contents = {r.path: r for r in files.collect()}
    assert contents[".env"].content == "[redacted]" and contents["pkg/work.go"].language == "go"
    with pytest.raises(FileNotFoundError):
        repo.get([], ["../outside"])
    assert [r.name for r in repo.outline("pkg/work.go").collect()] == ["Limit", "Runner", "Start", "helper"]
    assert repo.outline("none").count() == 0

    tree = {r.path: r for r in repo.tree(depth=2).collect()}
    assert tree["pkg"].is_dir and tree["pkg/work.go"].symbol_count == 4
    row = repo.overview().first()
    assert row.total_symbols == 7 and row.repo == "repo" and {x.language for x in row.languages} == {"go", "python"}
    status = repo.status(verify=True).first()
    assert status.mismatched == 0 and status.total == 7

    files, variables = repo.env()
    assert {r.key: r.state for r in variables.collect()} == {"API_KEY": "empty", "HOST": "set", "TOKEN": "placeholder"}
    assert files.filter("exists").count() == 1


def test_changes_equal_a_full_build(repo, spark, root, tmp_path):
    repo.index()
    assert repo.sync().indexed == 0
    (root / "pkg/work.go").write_text(GO.replace("helper", "assist"))
    (root / "lib/box.py").unlink()
    said = repo.sync()
    assert said.indexed == 1 and said.deleted == 1
    other = Repository(spark, str(root), Config(cache_root=str(tmp_path / "other")))
    other.index()
    columns = [c for c in repo.symbols.columns if c not in ("indexed_at",)]
    key = lambda df, cs: sorted(map(str, df.select(cs).collect()))
    assert key(repo.symbols, columns) == key(other.symbols, columns)
    assert key(repo.edges, repo.edges.columns) == key(other.edges, other.edges.columns)
    for part in ("postings", "lengths"):
        own, full = (getattr(r.store.search_index(), part) for r in (repo, other))
        assert key(own, own.columns) == key(full, full.columns)
    assert repo.search("assist").count() == 1 and repo.search("helper").count() == 0 and repo.search("Box").count() == 0


def test_the_limit_goes_on_next_time(spark, tmp_path):
    top = tmp_path / "many"
    top.mkdir()
    for k in range(6):
        (top / f"f{k}.py").write_text(f"def f{k}(): pass\n")
    (top / "a.bin").write_bytes(b"\0" * 100)
    repo = Repository(spark, str(top), Config(cache_root=str(tmp_path / "cache"), max_files=3))
    first = repo.index()
    assert first.indexed == 2 and any("limit of 3 files" in w and "4 files are left" in w for w in first.warnings)  # the binary one counts as looked at
    second = repo.sync()
    assert (second.indexed, second.deleted) == (3, 0) and any("1 files are left" in w for w in second.warnings)
    third = repo.sync()
    assert (third.indexed, third.deleted, third.warnings) == (1, 0, [])
    assert names(repo.symbols) == {f"f{k}" for k in range(6)}
    (top / "f0.py").write_text("def other(): pass\n")
    last = repo.sync()
    assert (last.indexed, last.deleted) == (1, 0) and names(repo.symbols) == {"other", *(f"f{k}" for k in range(1, 6))}


def test_unchanged_files_are_not_read(repo, spark, root, monkeypatch):
    from codeloom.sources import filesystem

    repo.index()
    for f in root.rglob("*"):  # long ago, so that a further change would show
        os.utime(f, (1_600_000_000, 1_600_000_000))
    repo.sync()
    asked, real = [], filesystem.contents

    def spy(files, *rest):
        asked.append({r.path for r in files.select("path").collect()})
        return real(files, *rest)

    monkeypatch.setattr(filesystem, "contents", spy)
    assert repo.sync().indexed == 0
    (root / "lib/box.py").write_text(PY + "\nclass New:\n    pass\n")
    assert repo.sync().indexed == 1
    assert asked == [set(), {"lib/box.py"}]


def test_a_store_on_another_file_system(spark, root, tmp_path):
    (tmp_path / "far").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.loom.link./c", f"file://{tmp_path}/far")
    cache = "viewfs://loom/c/cache"
    repo = Repository(spark, str(root), Config(cache_root=cache))
    repo.index()
    assert repo.search("Sta").first()["name"] == "Start"
    repo.record("search", 1.0, 5)
    (root / "pkg/work.go").write_text(GO.replace("helper", "assist"))
    assert repo.sync().indexed == 1 and repo.search("assist").count() == 1
    assert repo.savings().first().tokens_saved == 5
    assert stores.cache_status(cache)["total_bytes"] > 0 and (tmp_path / "far/cache/repos.json").exists()
    assert stores.prune(cache, 3600) == [] and stores.prune(cache, -1) == [repo.store.hash] and stores.manifest(cache) == []


def test_a_folder_of_one_machine_is_refused_on_a_cluster(tmp_path):
    class Far:
        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(ValueError, match="one machine"):
        stores.Store(Far, str(tmp_path), str(tmp_path))
    assert stores.Store(Far, str(tmp_path), str(tmp_path), shared=True).hash


def test_git_mode_and_diff(spark, root, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)

    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    repo = Repository(spark, str(root), Config(cache_root=str(tmp_path / "cache")))
    assert repo.index().mode == "git"
    assert repo.status().first().commit_valid
    (root / "pkg/work.go").write_text(GO + "\nfunc more() {}\n")
    git("commit", "-qam", "two")
    repo.sync()
    assert {(r.qualified_name, r.change) for r in repo.diff("HEAD~1").collect()} >= {("pkg.more", "modified")}
    with pytest.raises(subprocess.CalledProcessError):
        repo.diff("nowhere")


def test_tools_and_savings(repo, spark, root):
    tools = Tools(spark, repo.config, str(root))
    assert tools.call("search", query="Start")["is_error"]
    repo.index()
    out = tools.call("search", query="Start")
    assert out["total"] == 1 and out["metadata"]["tokens_saved"] == 15
    assert json.dumps(out)
    assert tools.call("nothing")["is_error"]
    tools.call("overview")
    tools.call("env")
    total = repo.savings().first()
    assert (total.tokens_saved, total.calls) == (75, 2)
    assert tools.counters.calls == 3
    assert repo.sessions().first().calls == 2
    assert tools.call("tree", depth=1)["nodes"]


def test_cache(repo, root, tmp_path):
    cache = str(tmp_path / "cache")
    with pytest.raises(NotIndexedError):
        Repository(repo.spark, str(root), repo.config, must_exist=True)
    repo.index()
    assert stores.cache_status(cache)["total_bytes"] > 0
    assert stores.prune(cache, 3600) == []
    assert stores.prune(cache, -1) == [repo.store.hash]
    assert stores.manifest(cache) == []
