"""Spelling variants, the hash tree and nearest neighbours against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import crosspolytope, merkle, queries, spelling
from codeloom.llm.automaton import Automaton
from tests.llm.test_queries import SF, duck  # noqa: F401


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def made_words(seed: int, n: int, letters: str = "abé") -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(n)]


# --- 11


def test_automaton_numbers_and_errors():
    words = sorted(set(made_words(1, 1200, "abc")))
    automaton = Automaton(words)
    assert len(automaton.steps) < len(words)  # endings are shared
    for word in words[::5] + ["aaaaaaa", "abcabcabc", ""]:
        for exact in (0, 3, len(word)):
            found = automaton.one_error(word, exact)
            assert sorted(found) == [k for k, w in enumerate(words) if is_near(word, w) and w[:exact] == word[:exact]]


def plain_variants(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize(("part", "crowded"), [(1 << 15, 1 << 14), (40, 3)])
def test_variants(spark, monkeypatch, part, crowded):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    rng = random.Random(2)
    counts = {w: rng.choice([2, 3, 30, 31, 400, 5000]) for w in made_words(3, 350) + made_words(4, 60, "ab") + ["a" * 300, "a" * 301]}
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n int"))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == plain_variants(counts)


def test_words_of_texts(spark):
    import re

    texts = [None, "", "short words only", "Straße STRASSEN straßen Größenwahn größenwahn", "abcdefgh-abcdefgh ABCDEFGH", "x" * 50_000 + " " + "x" * 50_000, "Éclairées éclairées", "日本語日本語日本語 abcdefgh"] * 3
    rows = [(i if i % 5 else None, t, 1) for i, t in enumerate(texts)]
    want = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            want[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 3 == 0 else low] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    got = spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string, word int"), damaged=3)
    assert dict(map(tuple, got.collect())) == want
    assert spelling.group_variants(got).count() == len(want)
    assert spelling.group_variants(got.filter("false")).count() == 0


# --- 12


def h(*x: str) -> str:
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    return [(bool(i >> k & 1), level[i >> k ^ 1] if i >> k ^ 1 < len(level) else None) for k, level in enumerate(levels[:-1])]


@pytest.mark.parametrize("stacked", [1, 2, 3])
def test_traversal(stacked):
    for n in (1, 2, 3, 5, 8, 9, 31, 33, 100):
        leaves = [h(str(k)) for k in range(n)]
        levels = plain_levels(leaves)
        traversal = merkle.Traversal(leaves, len(levels) - 1, stacked)
        assert list(traversal.paths()) == [[s for _, s in plain_path(levels, k)] for k in range(n)]
        assert merkle.Growing(leaves, 0, len(levels) - 1, 0).complete().top == levels[-1][0]


def test_growing_subtrees_stay_small():
    leaves = [h(str(k)) for k in range(1024)]
    seen = []

    class Watched(merkle.Growing):
        def step(self):
            seen.append(len(self.nodes) + len(self.stack))
            return super().step()

    before, merkle.Growing = merkle.Growing, Watched
    try:
        assert sum(1 for _ in merkle.Traversal(leaves, 10, 2).paths()) == 1024
    finally:
        merkle.Growing = before
    assert max(seen) <= 2 * (4 + 11)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "en", "en", "en", "é", "de", "-"]), h(str(rng.randint(0, 90))), k) for k in range(150)] + [(7, "en", h("same"), 1)] * 30 + [(1, "alone", h("x"), 0)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, proof int")
    got = merkle.manifest(df, height=height).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([r[2] for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]) for g in order}
    upper = plain_levels([trees[g][-1][0] for g in order])
    want = Counter()
    for k, g in enumerate(order):
        for i, leaf in enumerate(trees[g][0]):
            want[g, leaf, str(plain_path(trees[g], i) + plain_path(upper, k)), trees[g][-1][0], upper[-1][0]] += 1
    assert Counter((r.kept.lang, r.kept.leaf, str([tuple(s) for s in r.proof]), r.subroot, r.root) for r in got) == want
    assert Counter(r.kept.proof for r in got) == Counter(r[3] for r in rows)  # a column named like a result
    folded = merkle.manifest(df, height=height).select(merkle.fold(merkle.F.col("kept.leaf"), merkle.F.col("proof")).alias("f"), "root")
    assert all(r.f == r.root for r in folded.collect())
    assert merkle.manifest(df.filter("false")).count() == 0


def test_row_digest(spark):
    rows = [(1, "ü", None), (None, "", "x" * 100_000)]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    got = [r[0] for r in df.select(merkle.row_digest(*(merkle.F.col(c) for c in "abc"))).collect()]
    assert got == [h("1:12:ü-"), h("-0:100000:" + "x" * 100_000)]


# --- 13


def plain_nearest(rows, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, v in rows:
        if i % 100 == 0:
            met = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in rows if len(w) == len(v) and (j, w) != (i, v))[:k]
            out |= {(i, rank, j, round(d, 9)) for rank, (d, j) in enumerate(met, 1)}
    return out


@pytest.mark.parametrize("rotations", [1, 2, 3])
@pytest.mark.parametrize("crowded", [1 << 10, 5])
def test_nearest_with_every_bucket_is_exact(spark, monkeypatch, rotations, crowded):
    monkeypatch.setattr(crosspolytope, "CROWDED", crowded)
    monkeypatch.setattr(crosspolytope, "fit", lambda *_: (rotations, 16**rotations if rotations < 3 else 4096))
    rng = np.random.default_rng(rotations)
    rows = [(k, np.round(rng.normal(size=8), 1).tolist()) for k in range(260)] + [(k, [0.5] * 8) for k in range(300, 500, 4)]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [1.0, None] * 4), (604, [float("nan")] * 8), (605, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(700, [1.0, 2.0, 2.0]), (701, [1.0, 2.0, 2.5]), (800, [3.0, -1.0, 0.0])] + [rows[100]] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = crosspolytope.search(df, df.filter("vec_id % 100 = 0"), k=4).collect()
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got} == plain_nearest(rows, 4)
    assert len(got) == len({(r.query_id, r.rank) for r in got})


def test_nearest_of_large_numbers_and_none(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e190]), (2, [-1e200, 0.0]), (3, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = crosspolytope.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, pytest.approx(1e190)), (3, pytest.approx(1e200)), (2, pytest.approx(2e200))]
    assert crosspolytope.search(df.filter("false"), df.filter("false")).count() == 0
    assert crosspolytope.search(df, df.filter("false")).count() == 0


def test_recall_of_op13(spark, duck):  # noqa: F811
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    want = plain_nearest(rows, 10)
    got = {(r.query_id, r.vec_id, round(r.score, 9)) for r in queries.QUERIES["op13_nearest"](spark, SF).collect()}
    assert len(got) == len(want) and len(got & {(q, j, d) for q, _, j, d in want}) >= 0.9 * len(want)


def test_fit_takes_finer_buckets_where_neighbours_are_near(spark):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(3000, 8))
    rows = [(3 * k + j, (m + rng.normal(scale=1e-3, size=8)).tolist()) for k, m in enumerate(middles) for j in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    keyed = crosspolytope.keyed(df, "vec_id", "embedding")
    rotations, probes = crosspolytope.fit(crosspolytope.entries(keyed, 2), keyed.filter("id % 100 = 0"), 2)
    assert rotations > 1 and probes < 20


def test_many_found_are_merged_in_time(spark):
    F = crosspolytope.F
    n = 40_000  # all found in each table; comparing all pairs takes minutes
    pair = F.struct((F.col("id") / 7).alias("d"), "id", F.xxhash64("id").alias("mark"))
    near = spark.range(n * crosspolytope.TABLES, numPartitions=8).select((F.col("id") % n).alias("id")).select(F.lit(b"q").alias("key"), F.array(pair).alias("near"))
    began = time.monotonic()
    got = crosspolytope.merged(near, 11).collect()
    assert time.monotonic() - began < 40
    assert [(x.id, x.d) for x in got[0].near] == [(i, i / 7) for i in range(11)] and len(got) == 1


def test_nearest_of_many_questions_at_once(spark, monkeypatch):
    """Ties beyond k, matrices of several pieces, very large and very small numbers."""
    monkeypatch.setattr(crosspolytope, "CELLS", 3000)
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e-100, 1e140, 1e200):
        for vectors in (rng.normal(size=(900, 5)), rng.integers(-1, 2, (900, 5)).astype(float)):
            vectors = vectors * scale
            with np.errstate(over="ignore"):
                squares = (vectors * vectors).sum(axis=1)
            who, at, exact = map(np.concatenate, zip(*crosspolytope.nearest(vectors[:30], vectors, squares, 4), strict=True))
            for q in range(30):
                every = [math.dist(vectors[q], v) for v in vectors]
                edge = sorted(every)[3] * (1 + 1e-12)
                assert sorted(at[who == q].tolist()) == [j for j, d in enumerate(every) if d <= edge]
                assert exact[who == q].tolist() == sorted(exact[who == q].tolist()) == pytest.approx([every[j] for j in at[who == q]], rel=1e-12)


def test_equally_near_vectors_of_one_id(spark):
    rows = [(0, [0.0, 1.0]), (5, [1.0, 0.0]), (5, [-1.0, 0.0]), (6, [0.0, -1.0])]
    got = crosspolytope.search(df := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 5, math.sqrt(2)), (2, 5, math.sqrt(2)), (3, 6, 2.0)]


def test_ids_that_are_no_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{'é' if k % 2 else 'z'}{k}", rng.integers(-1, 2, 3).astype(float).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in crosspolytope.search(df, df.filter("vec_id < 'z2'"), k=5).collect()}
    used = [(i, v) for i, v in rows if any(v)]
    want = {(i, rank, j, round(d, 9)) for i, v in used if i < "z2" for rank, (d, j) in enumerate(sorted((math.dist(v, w), j) for j, w in used if j != i)[:5], 1)}
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want) == 25
