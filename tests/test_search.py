"""The ranked search against SQLite's own full-text index."""

from __future__ import annotations

import sqlite3

import pytest

from codeloom.operators import search

ROWS = [
    ("parse_file", "pkg.parse_file", "func parse_file(path)", "Parses a file. Café résumé"),
    ("ParseRequest", "net.ParseRequest", "func ParseRequest(r)", "parse request bodies foo bar"),
    ("FormatResponse", "net.FormatResponse", "func FormatResponse(w)", "format the file parse"),
    ("Handle", "net.Handle", "func (S) Handle()", "foo baz bar foo"),
    ("HandleFunc", "net.HandleFunc", "func HandleFunc()", "bar foo and or not x² zed"),
    ("zed", "zed", "", "the zed file parse"),
    ("empty", "", "", ""),
]
COLUMNS = ["name", "qualified_name", "signature", "summary"]
QUERIES = [
    "parse", "parse_file", "Parse*", "foo bar", '"parse file"', '"foo bar" OR zed', "foo NOT baz", "name:zed*", "^zed*", "foo AND bar NOT zed", "(foo OR zed) AND file", "handle", "cafe", "CAFÉ", "x²",
    '"file par" *', "{name summary} : zed", "- name : zed", "foo + bar", "zed OR file AND parse", "and", "foo or bar", "summary:(foo bar)", '"the zed" parse', "résum", "nothing_there", "foo NOT (bar OR zed)", "AND", "foo AND", "(foo", "foo-bar", "a.b", "it's", "*", "", "foo)", '"open',
    "unknown:foo", "-foo", "foo/bar", "foo NOT", "^ foo", "NOT foo", "\"\"",
]


@pytest.fixture(scope="module")
def both(spark):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5({', '.join(COLUMNS)})")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    df = spark.createDataFrame([(k + 1, *r) for k, r in enumerate(ROWS)], "id long, name string, qualified_name string, signature string, summary string")
    return db, df, search.build_index(df, "id", COLUMNS)


@pytest.mark.parametrize("q", QUERIES)
def test_parity(both, q):
    db, df, index = both
    text = search.normalize_query(q)
    try:
        want = {r: round(s, 6) for r, s in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (text,))}
    except sqlite3.OperationalError:
        want = None
    got = search.search(df, index, q, limit=50).collect()
    if want is None:
        like = {r for (r,) in db.execute("SELECT rowid FROM t WHERE name LIKE ? OR qualified_name LIKE ?", (f"%{q}%", f"%{q}%"))}
        assert {r.id for r in got} == like and all(r.rank is None for r in got)
    else:
        assert {r.id: round(r.rank, 6) for r in got} == want
        assert [r.rank for r in got] == sorted(r.rank for r in got)


def test_limits_and_filters(both):
    _, df, index = both
    assert search.search(df, index, "foo", limit=0).count() == 3
    assert search.search(df, index, "foo", limit=1, offset=1).count() == 1
    assert [r.id for r in search.search(df, index, "foo", filters={"name": "Handle", "signature": ""}).collect()] == [4]
    assert search.search(df.limit(0), search.build_index(df.limit(0), "id", COLUMNS), "foo").count() == 0


def test_written_index(both, spark, tmp_path):
    _, df, index = both
    index.write(f"file://{tmp_path}")
    again = search.read_index(spark, f"file://{tmp_path}", COLUMNS)
    assert search.search(df, again, "foo bar").collect() == search.search(df, index, "foo bar").collect()


@pytest.mark.parametrize(("q", "want"), [("", ""), ("foo", "foo*"), ("foo bar", "foo bar*"), ("a-b", "a-b"), ('"x', '"x'), ("a or b", "a or b"), ("x AND y", "x AND y"), ("android", "android*")])
def test_normalize(q, want):
    assert search.normalize_query(q) == want


def test_index_of_odd_texts(spark, monkeypatch):
    """Places of each term by a plain loop, over texts of which several are cut at once and one fills a group."""
    from collections import defaultdict

    monkeypatch.setattr(search, "GROUP", 64)
    texts = [None, "", " \n ", "a", "\na b\n\na", "Été été ETE x²", "the the of the", "-- the 😀 of\tthe\x00the", "b " * 500, " Ωmega ١٢ a_b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = defaultdict(list)
    for i, text in enumerate(texts):
        for k, w in enumerate(search.tokenize(text or "")):
            want[w, i, "text"].append(k)
    index = search.build_index(df, "id", ["text"])
    assert {(r.term, r.id, r.col): r.pos for r in index.postings.collect()} == want
    assert dict(map(tuple, index.lengths.collect())) == {i: len(search.tokenize(x or "")) for i, x in enumerate(texts)}
    found = {r.id for r in search.match(index, search.parse_query('"the of the"', ["text"])).collect()}
    assert found == {6} | ({7} if search.tokenize(texts[7])[:3] == ["the", "of", "the"] else set())


def test_postings_travel_once_and_hot_terms_are_spread(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "'the word the' AS text")
    index = search.build_index(df, "id", ["text"])
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.write(str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/postings").filter("term = 'the'").groupBy("_metadata.file_name").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 1
    plan = search.match(index, search.parse_query("the", ["text"]))._jdf.queryExecution().toString()
    assert "Generate" not in plan  # a place of a single word is not a row


def test_repeated_ids_count_once(spark):
    from codeloom.plans.queries import occurrences

    df = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a a"), (None, "b")], "id long, text string")
    assert sorted(map(tuple, occurrences(search.build_index(df, "id", ["text"])).collect())) == [("a", 2, 4), ("b", 1, 2)]
