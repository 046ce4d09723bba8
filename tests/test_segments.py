"""The log of segments: reads, merges and concurrent writers against plain tables."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from codeloom.plans import segments
from codeloom.plans.config import Config
from codeloom.plans.repository import Repository
from codeloom.plans.segments import Change, ConflictError, Log, Manifest, Table
from codeloom.sources.storage import HadoopStorage, LocalStorage

SCHEMA = "file string, n long"


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, LocalStorage(str(tmp_path)), "log", {"t": Table(SCHEMA, "file", "file")})


@pytest.fixture
def far_log(spark, tmp_path):
    return Log(spark, HadoopStorage(spark, f"file://{tmp_path}"), "log", {"t": Table(SCHEMA, "file", "file")})


def rows(log, manifest=None):
    return sorted(map(tuple, log.read("t", manifest).collect()), key=str)


def change(spark, new=(), gone=()):
    return {"t": Change(spark.createDataFrame(list(new), SCHEMA), spark.createDataFrame([(g,) for g in gone], "file string"))}


def put(log, spark, new=(), gone=()):
    return log.commit(log.stage(log.current(), change(spark, new, gone)))


def test_changes_equal_a_plain_table(log, spark):
    rng, plain, seen = random.Random(1), [], []
    for number in range(1, 8):
        gone = {rng.choice("abcdefgh") for _ in range(rng.randint(0, 3))}
        new = [(rng.choice([*sorted(gone), "i"]), number * 100 + k) for k in range(rng.randint(0, 4))]
        plain = [r for r in plain if r[0] not in gone] + new
        state = put(log, spark, new, gone)
        assert rows(log) == sorted(plain, key=str)
        seen.append((state, sorted(plain, key=str)))
        if number % 3 == 0:
            merged = log.compact()
            assert rows(log, merged) == sorted(plain, key=str)
            assert len(merged.segments["t"]) <= 3 * segments.FANOUT
    assert len(log.numbers()) == segments.KEEP
    old = [(s, want) for s, want in seen if s.number in log.numbers()]
    assert old and all(rows(log, s) == want for s, want in old)  # a reader keeps what it has opened


def test_null_keys_and_empty_changes(log, spark):
    put(log, spark, [(None, 1), ("a", 2)])
    assert log.current().segments["t"][0].low is None
    put(log, spark, [], [])
    assert rows(log) == [("a", 2), (None, 1)] and len(log.current().segments["t"]) == 1 and not log.current().gone
    put(log, spark, [("a", 3)], ["a", "zzz"])
    assert rows(log) == [("a", 3), (None, 1)]
    assert log.current().gone["t"][0].rows == 2


def test_ranges_that_do_not_meet_are_read_as_they_are(log, spark):
    put(log, spark, [("a", 1), ("c", 2)])
    put(log, spark, [("m", 3), ("p", 4)])
    put(log, spark, [("m", 5)], ["m", "n"])
    assert rows(log) == [("a", 1), ("c", 2), ("m", 5), ("p", 4)]
    first = log.current().segments["t"][:1]
    assert "Join" not in log.read("t", segments=first)._jdf.queryExecution().executedPlan().toString()
    for _ in range(segments.SETS):
        put(log, spark, [("p", 9)], ["p"])
    log.compact()
    assert not log.current().gone["t"] and rows(log) == [("a", 1), ("c", 2), ("m", 5), ("p", 9)]


def test_only_one_writer_commits_a_number(far_log, spark):
    log = far_log
    base = put(log, spark, [("a", 1)])
    one, two = (log.stage(base, change(spark, [("b", n)])) for n in (2, 3))
    log.commit(one)
    with pytest.raises(ConflictError):
        log.commit(two)
    assert rows(log) == [("a", 1), ("b", 2)]
    assert not log.storage.create_text(log._manifest(one.number), "x")  # the last guard, without the look before
    assert log.current().text() == one.text() and Manifest.parse(one.text()) == one


def test_two_writers_lose_no_update(spark, tmp_path):
    log = Log(spark, LocalStorage(str(tmp_path)), "log", {"t": Table(SCHEMA, "file", "file")})
    put(log, spark, [("a", 0)])

    def write(who: str) -> None:
        for k in range(2):
            while True:
                try:
                    put(log, spark, [(who, k)])
                    break
                except ConflictError:
                    continue

    writers = [threading.Thread(target=write, args=(w,)) for w in ("x", "y")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert rows(log) == sorted([("a", 0), *((w, k) for w in "xy" for k in range(2))], key=str)


def source(name: str, calls: str, n: int = 120) -> str:
    return "".join(f"def {name}_{k}(x):\n    \"\"\"Gives what {name} number {k} has.\"\"\"\n    return {calls}_{k}(x)\n\n\n" for k in range(n))


def test_a_change_writes_what_changed(spark, tmp_path):
    root, cache = tmp_path / "repo", tmp_path / "cache"
    root.mkdir()
    for k in range(12):
        (root / f"m{k}.py").write_text(source(f"f{k}", f"f{(k + 1) % 12}"))
    repo = Repository(spark, str(root), Config(cache_root=str(cache)))
    repo.index()
    folder = cache / repo.store.hash
    before = {p: p.stat().st_size for p in folder.rglob("*.parquet")}
    (root / "m3.py").write_text(source("f3", "f4").replace("number 7 has", "number seven has"))
    repo.sync()
    written = {p: p.stat().st_size for p in folder.rglob("*.parquet") if p not in before and "/files/" not in str(p)}
    assert before.keys() <= {*folder.rglob("*.parquet")} and sum(written.values()) < 0.35 * sum(before.values())
    postings = [p for p in written if "/segments/postings/" in str(p)]
    assert postings and sum(written[p] for p in postings) < 0.3 * sum(n for p, n in before.items() if "/segments/postings/" in str(p))
    assert repo.search("seven").count() == 1


def test_random_changes_equal_a_full_build(spark, tmp_path):
    rng, root = random.Random(7), tmp_path / "repo"
    root.mkdir()
    repo = Repository(spark, str(root), Config(cache_root=str(tmp_path / "cache")))
    names = [f"n{k}" for k in range(5)]

    def put_file(k: int) -> None:
        own = rng.sample(names, 2)
        (root / f"m{k}.py").write_text("".join(f"def {n}(x):\n    return {rng.choice(names)}(x) + {rng.choice(names)}(x, {rng.randint(0, 3)})\n\n\n" for n in own))

    for k in range(4):
        put_file(k)
    repo.index()
    for turn in range(2):
        put_file(rng.randint(0, 5))
        if turn == 1:
            (root / "m1.py").unlink(missing_ok=True)
        repo.sync()
        full = Repository(spark, str(root), Config(cache_root=str(tmp_path / f"full{turn}")))
        full.index()
        plain = lambda df, cs: sorted(map(str, df.select(cs).collect()))
        same = [c for c in repo.symbols.columns if c not in ("indexed_at", "possible_unresolved")]
        assert plain(repo.symbols, same) == plain(full.symbols, same)
        ends = ["caller_id", "callee_id", "confidence", F.when(F.col("callee_id").isNull(), F.col("raw_expression"))]
        assert plain(repo.edges, ends) == plain(full.edges, ends)
    repo.store.log.compact()
    assert plain(repo.symbols, same) == plain(full.symbols, same)


def test_a_run_that_loses_starts_again(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def a(): pass\n")
    config = Config(cache_root=str(tmp_path / "cache"))
    repo, real, lost = Repository(spark, str(root), config), Log.commit, []

    def commit(self, manifest):
        if not lost:  # another run is done first
            lost.append(manifest.number)
            (root / "b.py").write_text("def b(): pass\n")
            Repository(spark, str(root), config).sync()
        return real(self, manifest)

    monkeypatch.setattr(Log, "commit", commit)
    repo.index()
    assert {r.name for r in repo.symbols.collect()} == {"a", "b"} and repo.files.count() == 2 and lost == [1]
