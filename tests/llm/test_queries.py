"""Every opN_ query over the smallest tables, against its SQL or a plain version."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import bpe, queries
from tests.llm import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def same(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(same(r[k]) for k in at) for r in found.fetchall()), key=str) and got


def test_op5(spark, documents):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in documents:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.QUERIES["op5_byte_bpe"](spark, SF).collect())) == want


def test_op7(spark, documents):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in documents}
    tokens = {i: [*brute.words(brute.lower(t)), "\n"] for i, t in documents}
    counts = Counter(w for i, _ in documents if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.QUERIES["op7_lm_scoring"](spark, SF).collect()}
    assert len(got) == len(documents)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than the counts alone


def test_op8(spark, documents):
    fp = [brute.fingerprint(t) for _, t in documents]
    root = brute.components(len(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    want = [(i, f"{x:016x}", documents[r][0]) for (i, _), x, r in zip(documents, fp, root, strict=True)]
    assert sorted(map(tuple, queries.QUERIES["op8_simhash"](spark, SF).collect())) == want


def test_held_out_languages_are_right(spark, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = [r for r in queries.QUERIES["op9_language_id"](spark, SF).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(got) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)
