from __future__ import annotations

import pytest

from codeloom.parsers.languages import register
from codeloom.parsers.parse import parse_file

SOURCES = {
    "go": 'package a\n\n// One is it.\nconst (\n\tOne = 1\n\tTwo = 2\n)\n\ntype M map[string]int\n\ntype I interface {\n\tDo(x int)\n}\n\nfunc (q *Q[T]) Get(a, b int) (x struct{ n int }, err error) {\n\tif f := call("(}"); f != nil {\n\t\tq.in.Do(1).Then(2)\n\t}\n\treturn\n}\n\nfunc bare()\n',
    "typescript": "// A is exported.\nexport class A<T> extends B {\n  private n = () => { go(); };\n  get size(): number { return this.n(); }\n  abstract none(): void;\n}\nexport type P = { a: string };\nexport interface Q { m(): void }\nexport async function f<T>(x: T): Promise<{ a: T }> {\n  return await g(`${x}`);\n}\nconst h = function k() {};\n",
    "javascript": "class A {\n  static async run(a, b) { return a?.go(b); }\n}\nfunction f() { // x\n  new A();\n}\n",
    "python": 'async def f(a, b=")"):\n    """Does it. More."""\n    class In:\n        @staticmethod\n        def m(): return g(a)(b)\n    return In\n',
    "rust": "/// Top.\n#[derive(Debug)]\npub struct S<T>(T);\nimpl<T: Fmt> Show for S<T> {\n    fn show<'a>(&'a self) -> char { let c = '{'; self.x.y(); Vec::<u8>::new(); c }\n}\npub(crate) const fn k() -> u8 { 1 }\nenum E { A, B }\ntrait T1 { fn d(&self) { e() } }\n",
    "java": '@Note("x")\npublic class A {\n  A() { init(); }\n  @Override public <T> List<T> get(Map<String, T> m) throws E { return new B(m).list("}"); }\n  enum K { X; void z() { y(); } }\n}\ninterface I { void none(); }\n',
}
EXPECTED = {
    "go": {("const", "p.One"), ("const", "p.Two"), ("type", "p.M"), ("interface", "p.I"), ("method", "p.Q.Get")},
    "typescript": {("class", "p.A"), ("method", "p.A.size"), ("type", "p.P"), ("interface", "p.Q"), ("function", "p.f")},
    "javascript": {("class", "p.A"), ("method", "p.A.run"), ("function", "p.f")},
    "python": {("function", "p.f"), ("class", "p.In"), ("method", "p.In.m")},
    "rust": {("type", "p.S"), ("method", "p.S.show"), ("function", "p.k"), ("type", "p.E"), ("interface", "p.T1")},
    "java": {("type", "p.A"), ("method", "p.A.get"), ("type", "p.K"), ("method", "p.A.z"), ("interface", "p.I")},
}


@pytest.mark.parametrize("language", SOURCES)
def test_symbols(language):
    rows = parse_file("p/f", language, SOURCES[language].encode())
    assert {(r["kind"], r["qualified_name"]) for r in rows if r["record"] == "symbol"} == EXPECTED[language]
    for r in rows:
        if r["record"] == "symbol":
            assert r["byte_start"] < r["byte_end"] and r["line_start"] <= r["line_end"] and len(r["id"]) == 8
        else:
            assert r["caller_id"] and r["raw_expression"].endswith(")")


def test_details():
    go = {r.get("name") or r["raw_expression"]: r for r in parse_file("p/f", "go", SOURCES["go"].encode())}
    assert go["One"]["summary"] == "One is it." and go["M"]["signature"] == "type M map_type"
    assert go["Get"]["signature"] == "func (Q) Get(a, b int)"
    assert 'call("(}")' in go and "q.in.Do(1).Then(2)" in go
    rust = {r.get("name"): r for r in parse_file("p/f", "rust", SOURCES["rust"].encode())}
    assert rust["S"]["summary"] == "/ Top." and rust["show"]["signature"] == "func (S) show(&'a self)"
    python = {r.get("name"): r for r in parse_file("p/f", "python", SOURCES["python"].encode())}
    assert python["f"]["summary"] == "Does it." and python["m"]["depth"] == 2


@pytest.mark.parametrize("language", SOURCES)
def test_empty_and_broken(language):
    assert parse_file("f", language, b"") == []
    for broken in (b"(((", b'"', b"func f( {", b"\xff\xfe{", b"class", b"/*"):
        parse_file("f", language, broken)


def test_code_in_template_literals():
    calls = lambda text: [r["raw_expression"] for r in parse_file("p/f", "javascript", text) if r["record"] == "edge"]
    assert calls(b"function g(x) { return `a${h(x)}b` }\n") == ["h(x)"]
    assert calls(b"function g(x) { return `a${h(`in ${k({a: '}'})}`)} no(1) ${'`'}` + z(2) }\n") == ["h(`in ${k({a: '}'})}`)", "k({a: '}'})", "z(2)"]
    assert calls(b"function g() { return `no(1) \\${no(2)} \\` no(3)` }\n") == []


def test_receivers_with_type_parameters():
    rows = parse_file("p/f", "go", b"func (p *Pair[K, V]) Get() int { return 1 }\nfunc (List[T]) Len() int { return 0 }\n")
    assert [(r["qualified_name"], r["signature"]) for r in rows] == [("p.Pair.Get", "func (Pair) Get()"), ("p.List.Len", "func (List) Len()")]


@pytest.mark.parametrize("language", SOURCES)
def test_time_grows_with_the_number_of_symbols(language):
    import time

    text = {"go": "func f%d(a int) int {\n\treturn g(h(a))\n}\n", "typescript": "export function f%d(a) { return `a${g(h(a))}`; }\n", "javascript": "class A%d { run(a) { return g(h(a)); } }\n", "python": "def f%d(a):\n    return g(h(a))\n", "rust": "#[inline]\nfn f%d(a: u8) -> u8 { g(h(a)) }\nimpl S%d { fn m(&self) { k() } }\n", "java": "class A%d { int m(int a) { return g(h(a)); } }\n"}[language]
    took = []
    for n in (400, 4000):
        source = "".join(text.replace("%d", str(k)) for k in range(n)).encode()
        began = time.process_time()
        rows = parse_file("p/f", language, source)
        took.append(time.process_time() - began)
        assert sum(r["record"] == "edge" for r in rows) >= 2 * n
    assert took[1] < 30 * max(took[0], 0.01)


def test_registry():
    with pytest.raises(ValueError):
        register("go", lambda data: None)
    assert parse_file("f", "cobol", b"x") == []


DAMAGED = {
    "go": ("func a() { f(1) }\n", ["func bad( {\n\tg(2)\n}\n", "func bad() {\n\tif x {\n", 'func bad() {\n\tx := "open\n}\n', "func bad() ) {}\n", "type T struct {\n", "var x = (1\n", "x := `open\n"], "func b() { h(3) }\n"),
    "typescript": ("function a() { f(1); }\n", ["function bad( {\n  g(2);\n}\n", "function bad() {\n  if (x) {\n", 'const s = "open\n', "class C {\n  m( { }\n}\n", "x = `open\n"], "function b() { h(3); }\n"),
    "javascript": ("function a() { f(1); }\n", ["function bad( {\n  g(2);\n}\n", "const s = 'open\n", "const r = /['\"]/;\n", ")}\n"], "function b() { h(3); }\n"),
    "rust": ("fn a() { f(1); }\n", ["fn bad( {\n  g(2);\n}\n", "fn bad() {\n  if x {\n", "impl S {\n", ")}\n", 'const S: &str = "open\n'], "fn b() { h(3); }\n"),
    "java": ("class A { void a() { f(1); } }\n", ["class Bad { void bad( {\n  g(2);\n} }\n", "class Bad {\n  void m() {\n", ")}\n", 'String s = """open\n'], "class B { void b() { h(3); } }\n"),
    "python": ("def a():\n    f(1)\n", ["def bad(:\n    g(2)\n", "x = (1\n", 's = "open\n', 's = """open\n', "if x\n    y()\n", "    bad indent\n", "x = 1 \\\n", "print 'old'\n", "\tx\n  y\n", "@\n", "\0\n"], "def b():\n    h(3)\n"),
}


@pytest.mark.parametrize("language", DAMAGED)
def test_what_is_not_damaged_is_found(language):
    before, damages, after = DAMAGED[language]
    for damage in damages:
        text = (before + damage + after).encode()
        rows = parse_file("p/f", language, text)
        names, calls = {r["name"] for r in rows if r["record"] == "symbol"}, {r["raw_expression"] for r in rows if r["record"] == "edge"}
        assert {"a", "b"} <= names and {"f(1)", "h(3)"} <= calls, damage
        own = next(r for r in rows if r.get("name") == "b")
        assert text[own["byte_start"] : own["byte_end"]].strip() in after.strip().encode()


def test_python_mended_equals_whole():
    """Statements around a damaged one give the rows that they give without it."""
    good = 'import os\n\n\n@deco(1)\ndef one(a, b=")"):\n    """One."""\n    return g(a)(b)\n\n\n# Two things.\nclass Two(Base):\n    x = f(1)\n\n    @property\n    def m(self):\n        if self.x:\n            return h("""\ndef no(): pass\n""")\n        else:\n            return k([\n1,\n])\n\n    async def n(self): await z()\n\n\nlast(1)\n'
    keep = ("kind", "name", "signature", "summary", "depth", "content_hash", "parent_id", "raw_expression", "caller_id")
    rows = lambda text: sorted(str([r.get(c) for c in keep]) for r in parse_file("p/f", "python", text.encode()) if r["record"] != "error")
    whole = rows(good)
    lines = good.splitlines(keepends=True)
    for at in (0, 3, 9, len(lines)):  # between statements
        for damage in ("def bad(:\n", "x = = 1\n", "else:\n", 's = "\n', "1 +\n"):
            assert rows("".join(lines[:at]) + damage + "".join(lines[at:])) == whole, (at, damage)
    inside = "".join(lines[:12]) + "\n    def bad(self:\n        pass\n" + "".join(lines[12:])
    assert {r["name"] for r in parse_file("p/f", "python", inside.encode()) if r["record"] == "symbol"} == {"one", "Two", "m", "n"}
    assert [r["name"] for r in parse_file("p/f", "python", b"class A:\n    class B:\n        def c(self):\n            x = = 1\n            def d(): pass\n") if r["record"] == "symbol"] == ["A", "B", "c", "d"]


def test_time_to_mend_grows_with_the_file():
    import time

    took = []
    for n in (300, 3000):
        source = ("# Note.\ndef f%d(a):\n    return g(h(a))\n\n\n" * n % tuple(range(n)) + "def bad(:\n" + 'x = "\n' * n).encode()
        began = time.process_time()
        rows = parse_file("p/f", "python", source)
        took.append(time.process_time() - began)
        assert sum(r["record"] == "symbol" for r in rows) == n
    assert took[1] < 30 * max(took[0], 0.01)


def test_keys_are_spread(spark, tmp_path, monkeypatch):
    """A table that is one row group is parsed by several tasks."""
    from pyspark.sql import functions as F

    from codeloom.plans import parser_queries

    monkeypatch.setattr(parser_queries, "KEYS", 100)
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        spark.range(1, 1001).toDF(key).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for made in (parser_queries.shape_sources(spark, str(tmp_path)), parser_queries.sources(spark, str(tmp_path), "go")):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1000 and len(sizes) >= 10 and max(sizes) <= 120


def test_parse_errors_takes_several_tasks(spark, tmp_path, monkeypatch):
    from codeloom.plans import parser_queries

    monkeypatch.setattr(parser_queries, "KEYS", 20)
    spark.range(1, 101).toDF("c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = parser_queries.parse_errors(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, found.collect())) == sorted((f"dir/{k}/f.py", True) for k in range(1, 101) if k % len(parser_queries.SHAPES) in (12, 13, 14, 16))


def test_parse_errors_makes_no_rows_of_symbols(spark, tmp_path):
    """Its tasks give the error rows of parse_files and nothing else."""
    from codeloom.parsers.parse import parse_errors, parse_files
    from codeloom.plans import parser_queries

    spark.range(0, 69).toDF("c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    plan = parser_queries.parse_errors(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "error" in plan and "content_hash" not in plan
    odd = [("a.py", "python", None), ("b.py", "python", b"x = (\n"), ("c.py", "python", b"a\x00b"), ("d.py", "python", b"(" * 500), ("e.c", "c", b"("), ("f.go", "go", b"func ("), ("g.py", None, b"("), ("h.py", "python", b"\xff")]
    files = parser_queries.shape_sources(spark, str(tmp_path)).unionByName(spark.createDataFrame(odd, "path string, language string, content binary"))
    found = sorted(map(repr, parse_errors(files).collect()))
    assert found == sorted(map(repr, parse_files(files).filter("record = 'error'").select("file", "error").collect())) and len(found) == 12 + 4
    assert parse_errors(files.limit(0)).collect() == []
