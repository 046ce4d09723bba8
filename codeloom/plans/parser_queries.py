"""The six parsers and the index over sources made from rows of ``supplier``, with SQL for the same symbols and calls.

A source is a list of pieces, ``{k}`` standing for the row's key; symbols are spans of pieces. The query parses the joined
pieces; the SQL adds up the bytes and lines of the pieces before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import graph
from codeloom.parsers import parse
from codeloom.parsers.parse import parse_files
from codeloom.plans.queries import query, t


@dataclass(frozen=True)
class Made:
    """kind, name, receiver, signature, summary; it spans the pieces [first, end)."""

    kind: str
    name: str
    receiver: str
    signature: str
    summary: str
    first: int
    end: int


@dataclass(frozen=True)
class Template:
    extension: str
    pieces: list[str]
    symbols: list[Made]
    #: (name of the caller's symbol, what is called)
    calls: list[tuple[str, str]]


TEMPLATES = {
    "go": Template(
        ".go",
        [
            "package p\n\n",
            "// Most{k} is the most. It has } in it.\n",
            "const Most{k} = 3",
            "\n\n",
            "type Pair{k}[K any, V any] struct {\n\tkey K\n\tval V\n}",
            "\n\n/* Get{k} gets a thing. */\n",
            'func (p *Pair{k}[K, V]) Get{k}(a int, b string) (x struct{ n int }, err error) {\n\tif f := call{k}("(}"); f != nil {\n\t\tp.in.Do(a).Then(`)`)\n\t}\n\treturn\n}',
            "\n\n",
            "var done{k} = false",
            "\n\n",
            "type Runner{k} interface {\n\tRun(x int)\n}",
            "\n\n",
            "func call{k}(s string) error { return nil }",
            "\n",
        ],
        [
            Made("const", "Most{k}", "", "", "Most{k} is the most.", 2, 3),
            Made("type", "Pair{k}", "", "type Pair{k} struct", "type Pair{k}", 4, 5),
            Made("method", "Get{k}", "Pair{k}", "func (Pair{k}) Get{k}(a int, b string)", "Get{k} gets a thing.", 6, 7),
            Made("var", "done{k}", "", "", "variable done{k}", 8, 9),
            Made("interface", "Runner{k}", "", "type Runner{k} interface", "interface Runner{k}", 10, 11),
            Made("function", "call{k}", "", "func call{k}(s string)", "function call{k} accepting s string", 12, 13),
        ],
        [("Get{k}", 'call{k}("(}")'), ("Get{k}", "p.in.Do(a)"), ("Get{k}", "p.in.Do(a).Then(`)`)")],
    ),
    "typescript": Template(
        ".ts",
        [
            "// Box{k} holds. More.\nexport ",
            "class Box{k}<T> extends Base {\n  ",
            "get size{k}(): number { return this.n(`{ ${count{k}(1)} }`); }",
            "\n  abstract none(): void;\n}",
            "\nexport ",
            "interface Shape{k} { area(): number }",
            "\nexport ",
            "async function load{k}<T>(x: T): Promise<{ a: T }> {\n  return await fetch{k}('}');\n}",
            "\n",
        ],
        [
            Made("class", "Box{k}", "", "type Box{k} class", "Box{k} holds.", 1, 4),
            Made("method", "size{k}", "Box{k}", "func (Box{k}) size{k}()", "method size{k}", 2, 3),
            Made("interface", "Shape{k}", "", "type Shape{k} interface", "interface Shape{k}", 5, 6),
            Made("function", "load{k}", "", "func load{k}(x: T)", "function load{k} accepting x: T", 7, 8),
        ],
        [("size{k}", "this.n(`{ ${count{k}(1)} }`)"), ("size{k}", "count{k}(1)"), ("load{k}", "fetch{k}('}')")],
    ),
    "javascript": Template(
        ".js",
        [
            "class Box{k} {\n  ",
            "static async run{k}(a, b) { return a?.go{k}(b); }",
            "\n}",
            "\n/** Makes one. */\n",
            'function make{k}() { // no(1)\n  new Box{k}();\n  const s = "no(2)";\n  return run{k}(s);\n}',
            "\n",
        ],
        [
            Made("class", "Box{k}", "", "type Box{k} class", "class Box{k}", 0, 3),
            Made("method", "run{k}", "Box{k}", "func (Box{k}) run{k}(a, b)", "method run{k} accepting a, b", 1, 2),
            Made("function", "make{k}", "", "func make{k}()", "Makes one.", 4, 5),
        ],
        [("run{k}", "a?.go{k}(b)"), ("make{k}", "run{k}(s)")],
    ),
    "python": Template(
        ".py",
        [
            "import os\n\n\n",
            "class Box{k}:\n    \"\"\"Box holds. More.\"\"\"\n\n    @property\n    ",
            "def size{k}(self, by=\")\"):\n        return len(self.items{k}(by))",
            "\n\n\n# Makes one.\n",
            "async def make{k}(n):\n    return Box{k}(n)",
            "\n",
        ],
        [
            Made("class", "Box{k}", "", "type Box{k} class", "Box holds.", 1, 3),
            Made("method", "size{k}", "Box{k}", "func (Box{k}) size{k}(self, by=\")\")", "method size{k} accepting self, by=\")\"", 2, 3),
            Made("function", "make{k}", "", "func make{k}(n)", "Makes one.", 4, 5),
        ],
        [("size{k}", "len(self.items{k}(by))"), ("size{k}", "self.items{k}(by)"), ("make{k}", "Box{k}(n)")],
    ),
    "rust": Template(
        ".rs",
        [
            "#[derive(Debug)]\n",
            "pub struct Cell{k}<T>(T);",
            "\n\nimpl<T: Fmt> Show for Cell{k}<T> {\n    ",
            "fn show{k}<'a>(&'a self) -> char { let c = '{'; self.x{k}.y(c); c }",
            "\n}\n\n",
            "pub(crate) const fn top{k}() -> u8 { low{k}(r#\"}\"#) }",
            "\n\n",
            "enum Side{k} { A, B }",
            "\n",
        ],
        [
            Made("type", "Cell{k}", "", "type Cell{k} struct", "type Cell{k}", 1, 2),
            Made("method", "show{k}", "Cell{k}", "func (Cell{k}) show{k}(&'a self)", "method show{k} accepting &'a self", 3, 4),
            Made("function", "top{k}", "", "func top{k}()", "function top{k}", 5, 6),
            Made("type", "Side{k}", "", "type Side{k} enum", "type Side{k}", 7, 8),
        ],
        [("show{k}", "self.x{k}.y(c)"), ("top{k}", 'low{k}(r#"}"#)')],
    ),
    "java": Template(
        ".java",
        [
            "package p;\n\n/** Holds. More. */\n",
            "public class Box{k} {\n  Box{k}() { init{k}(); }\n  ",
            "@Override public <T> List<T> get{k}(Map<String, T> m) throws Bad { return new Other(m).list{k}(\"}\"); }",
            "\n  ",
            "enum Side{k} { X; }",
            "\n}",
            "\n\n",
            "interface Shape{k} { void none(); }",
            "\n",
        ],
        [
            Made("type", "Box{k}", "", "type Box{k} class", "Holds.", 1, 6),
            Made("method", "get{k}", "Box{k}", "func (Box{k}) get{k}(Map<String, T> m)", "method get{k} accepting Map<String, T> m", 2, 3),
            Made("type", "Side{k}", "", "type Side{k} enum", "type Side{k}", 4, 5),
            Made("interface", "Shape{k}", "", "type Shape{k} interface", "interface Shape{k}", 7, 8),
        ],
        [("Box{k}", "init{k}()"), ("get{k}", 'new Other(m).list{k}("}")')],
    ),
}


#: Keys of a partition, each of which becomes a file that takes about half a millisecond to parse.
KEYS = 4096


def spread(keys: DataFrame) -> DataFrame:
    """The same keys, a bounded number to a partition: a table of short rows may be a single row group, which is one task."""
    return keys.repartition(max(1, math.ceil(keys.count() / KEYS)))


def sources(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, language, content): a file for each supplier."""
    made, key = TEMPLATES[language], F.col("s_suppkey").cast("string")
    whole = F.replace(F.lit("".join(made.pieces)), F.lit("{k}"), key)
    path = F.concat(F.lit("dir/"), key, F.lit(f"/f{made.extension}"))
    return spread(t(spark, sf_dir, "supplier").select("s_suppkey")).select(path.alias("path"), F.lit(language).alias("language"), F.encode(whole, "UTF-8").alias("content"))


def parsed(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    return named(parse_files(sources(spark, sf_dir, language)))


def named(rows: DataFrame) -> DataFrame:
    """Parsed rows under the columns that symbols and calls share."""
    what = F.coalesce("raw_expression", "qualified_name")
    return rows.select("record", "file", "kind", what.alias("what"), F.coalesce("caller_id", "id").alias("id"), "signature", "summary", "byte_start", "byte_end", "line_start", "line_end", "content_hash")


def _quoted(s: str) -> str:
    """A SQL string with the key put in."""
    body = s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
    return f"replace('{body}', '{{k}}', k)"


def symbols_sql_of(made: Template) -> str:
    """The rows of a template for each key in ``s``."""
    names, out = {}, []
    for s in made.symbols:
        dotted = f".{s.receiver + '.' if s.receiver else ''}{s.name}"
        names[s.name] = f"'dir/' || k || {_quoted(dotted)}"
        before, through = _quoted("".join(made.pieces[: s.first])), _quoted("".join(made.pieces[: s.end]))
        lines = lambda x: f"strlen({x}) - strlen(replace({x}, chr(10), '')) + 1"
        out.append(
            f"SELECT 'symbol' AS record, 'dir/' || k || '/f{made.extension}' AS file, '{s.kind}' AS kind, {names[s.name]} AS what, substr(sha256({names[s.name]}), 1, 8) AS id, {_quoted(s.signature)} AS signature, "
            f"{_quoted(s.summary)} AS summary, strlen({before})::INT AS byte_start, strlen({through})::INT AS byte_end, ({lines(before)})::INT AS line_start, ({lines(through)})::INT AS line_end, "
            f"substr(sha256({_quoted(''.join(made.pieces[s.first : s.end]))}), 1, 16) AS content_hash FROM s"
        )
    for caller, raw in made.calls:
        out.append(f"SELECT 'edge', 'dir/' || k || '/f{made.extension}', NULL, {_quoted(raw)}, substr(sha256({names[caller]}), 1, 8), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM s")
    return " UNION ALL ".join(out)


def symbols_sql(language: str) -> str:
    return "WITH s AS (SELECT s_suppkey::VARCHAR AS k FROM supplier) " + symbols_sql_of(TEMPLATES[language])


@query(symbols_sql("go"))
def parse_go(spark, sf_dir):
    return parsed(spark, sf_dir, "go")


@query(symbols_sql("typescript"))
def parse_typescript(spark, sf_dir):
    return parsed(spark, sf_dir, "typescript")


@query(symbols_sql("javascript"))
def parse_javascript(spark, sf_dir):
    return parsed(spark, sf_dir, "javascript")


@query(symbols_sql("python"))
def parse_python(spark, sf_dir):
    return parsed(spark, sf_dir, "python")


@query(symbols_sql("rust"))
def parse_rust(spark, sf_dir):
    return parsed(spark, sf_dir, "rust")


@query(symbols_sql("java"))
def parse_java(spark, sf_dir):
    return parsed(spark, sf_dir, "java")


@query(
    """
WITH s AS (SELECT s_suppkey::VARCHAR AS k FROM supplier)
SELECT substr(sha256('dir/' || k || '.Pair' || k || '.Get' || k), 1, 8) AS caller_id, CASE WHEN c = 'call' THEN substr(sha256('dir/' || k || '.call' || k), 1, 8) END AS callee_id, c AS called
FROM s, (VALUES ('call'), ('Do'), ('Then')) v(c)
"""
)
def index_calls(spark, sf_dir):
    """Sources to symbols and calls, every call resolved by the names that but one symbol has."""
    from codeloom.plans.config import Config
    from codeloom.plans.index import symbols_and_edges

    files = sources(spark, sf_dir, "go").withColumn("untracked", F.lit(False))
    symbols, edges, _ = symbols_and_edges(files, files, Config(), "now")
    name = text.callee_name(F.col("raw_expression"))
    return graph.resolve(edges, symbols, name).select("caller_id", "callee_id", F.regexp_replace(name, "[0-9]+$", "").alias("called"))


@query(
    """
WITH s AS (SELECT s_suppkey::VARCHAR AS k FROM supplier)
SELECT 'dir/' || k || '/f.go' AS file, kind, CASE WHEN kind IN ('const', 'var') AND k::INT % 2 = 0 THEN '[redacted]' END AS hidden, 'dir/' || k AS package_root
FROM s, (VALUES ('const'), ('type'), ('method'), ('var'), ('interface'), ('function')) v(kind)
"""
)
def index_symbols(spark, sf_dir):
    """What the index says of symbols beside what was parsed: packages, and secrets that are not shown."""
    from codeloom.plans.config import Config
    from codeloom.plans.index import symbols_and_edges

    files = sources(spark, sf_dir, "go").withColumn("untracked", F.lit(False))
    manifests = files.select(F.regexp_replace("path", "f[.]go$", "go.mod").alias("path"))
    symbols, _, _ = symbols_and_edges(files, files.select("path").unionByName(manifests), Config(extra_secret_patterns=["(Most|done)[0-9]*[02468] ="]), "now")
    hidden = F.when(F.col("byte_start").isNull() & F.col("content_hash").isNull() & F.array_contains("tags", "secret"), F.col("summary"))
    return symbols.select("file", "kind", hidden.alias("hidden"), "package_root")


def _function(name: str, params: str, first: int, end: int, receiver: str = "") -> Made:
    kind = "method" if receiver else "function"
    return Made(kind, name, receiver, f"func {f'({receiver}) ' if receiver else ''}{name}({params})", f"{kind} {name}" + (f" accepting {params}" if params else ""), first, end)


def _type(word: str, name: str, first: int, end: int, kind: str = "type") -> Made:
    return Made(kind, name, "", f"type {name} {word}", f"{kind} {name}", first, end)


#: Shapes of which a row picks one; those that are damaged keep the symbols before and after.
SHAPES: list[tuple[str, Template]] = [
    ("go", Template(".go", ["func a{k}() { f{k}(1) }", "\nfunc bad( {\n\tg(2)\n}\n", "func b{k}(n int) { h{k}(3) }", "\n"], [_function("a{k}", "", 0, 1), _function("b{k}", "n int", 2, 3)], [("a{k}", "f{k}(1)"), ("b{k}", "h{k}(3)")])),
    ("go", Template(".go", ['func a{k}() {\n\tx := "open\n}', "\n", "func b{k}() { h{k}(3) }", "\n"], [_function("a{k}", "", 0, 1), _function("b{k}", "", 2, 3)], [("b{k}", "h{k}(3)")])),
    ("go", Template(".go", ["type M{k} map[string]int", "\n\n", "type C{k} chan int", "\n\n", "type S{k} []byte", "\n\n", "type P{k} *int", "\n"], [_type("map_type", "M{k}", 0, 1), _type("channel_type", "C{k}", 2, 3), _type("slice_type", "S{k}", 4, 5), _type("pointer_type", "P{k}", 6, 7)], [])),
    ("go", Template(".go", ["const (\n\tOne{k} = 1\n\tTwo{k} = 2\n)", "\n\n", "var x{k}, y{k} = f(1), 2", "\n"], [Made("const", "One{k}", "", "", "constant One{k}", 0, 1), Made("const", "Two{k}", "", "", "constant Two{k}", 0, 1), Made("var", "x{k}", "", "", "variable x{k}", 2, 3), Made("var", "y{k}", "", "", "variable y{k}", 2, 3)], [("x{k}", "f(1)")])),
    ("go", Template(".go", ["func (T{k}) one() { two{k}(`a\n}`) }", "\n", "func (t *T{k}) two(xs ...int) {\n\tgo func() { t.one() }()\n}", "\n"], [_function("one", "", 0, 1, "T{k}"), _function("two", "xs ...int", 2, 3, "T{k}")], [("one", "two{k}(`a\n}`)"), ("two", "t.one()")])),
    ("typescript", Template(".ts", ["function a{k}() { f{k}(1); }", '\nconst s = "open\n', "function b{k}(n: number) { h{k}(3); }", "\n"], [_function("a{k}", "", 0, 1), _function("b{k}", "n: number", 2, 3)], [("a{k}", "f{k}(1)"), ("b{k}", "h{k}(3)")])),
    ("typescript", Template(".ts", ["export ", "type Pair{k} = { a: string };", "\n", "type Either{k} =\n  | A\n  | B;", "\n"], [_type("type", "Pair{k}", 1, 2), _type("type", "Either{k}", 3, 4)], [])),
    ("typescript", Template(".ts", ["abstract class Q{k} {\n  ", "constructor(private n: number) { this.init{k}(n); }", "\n  ", "static of(n: number): Q{k} { return n.match(make{k}(n)); }", "\n}", "\n"], [_type("class", "Q{k}", 0, 5, "class"), _function("constructor", "private n: number", 1, 2, "Q{k}"), _function("of", "n: number", 3, 4, "Q{k}")], [("constructor", "this.init{k}(n)"), ("of", "n.match(make{k}(n))"), ("of", "make{k}(n)")])),
    ("typescript", Template(".tsx", ["class C {\n  m( { }\n}\n", "function b{k}() { h{k}(3); }", "\n"], [_function("b{k}", "", 1, 2)], [("b{k}", "h{k}(3)")])),
    ("javascript", Template(".js", ["function a{k}() { f{k}(1); }", "\nfunction bad() {\n  if (x) {\n", "async function b{k}(n) { h{k}(3); }", "\n"], [_function("a{k}", "", 0, 1), _function("b{k}", "n", 2, 3)], [("a{k}", "f{k}(1)"), ("b{k}", "h{k}(3)")])),
    ("javascript", Template(".mjs", ["class A{k} extends B {\n  ", "get n() { return `${f{k}(1)} ${'}'}`; }", "\n  ", "set n(v) { this.v = g{k}(v); }", "\n}", "\n"], [_type("class", "A{k}", 0, 5, "class"), _function("n", "", 1, 2, "A{k}"), _function("n", "v", 3, 4, "A{k}")], [("n", "f{k}(1)"), ("n", "g{k}(v)")])),
    ("javascript", Template(".js", ["x = `open\n", "function b{k}() { h{k}(3); }", "\n"], [_function("b{k}", "", 1, 2)], [("b{k}", "h{k}(3)")])),
    ("python", Template(".py", ["def a{k}():\n    f{k}(1)", "\n\n\ndef bad(:\n    g(2)\n\n\n", "def b{k}(n):\n    h{k}(3)", "\n"], [_function("a{k}", "", 0, 1), _function("b{k}", "n", 2, 3)], [("a{k}", "f{k}(1)"), ("b{k}", "h{k}(3)")])),
    ("python", Template(".py", ["class C{k}:\n    ", "def m(self):\n        return f{k}(1)", "\n\n    def n(self:\n        k()\n\n    ", "async def o(self):\n        await h{k}(3)", "\n"], [_type("class", "C{k}", 0, 4, "class"), _function("m", "self", 1, 2, "C{k}"), _function("o", "self", 3, 4, "C{k}")], [("m", "f{k}(1)"), ("C{k}", "k()"), ("o", "h{k}(3)")])),
    ("python", Template(".py", ['s = """open\n', "def b{k}(x='}'):\n    h{k}(3)", "\n"], [_function("b{k}", "x='}'", 1, 2)], [("b{k}", "h{k}(3)")])),
    ("python", Template(".pyi", ["def a{k}(n):\n    ", "def deep{k}(x):\n        return f{k}(x)", "\n    return deep{k}(n)", "\n"], [_function("a{k}", "n", 0, 3), _function("deep{k}", "x", 1, 2)], [("deep{k}", "f{k}(x)"), ("a{k}", "deep{k}(n)")])),
    ("python", Template(".py", ["if x{k}:\n    ", "def a{k}(): pass", "\nelse\n    y()\nprint 'old'\n", "class D{k}(B): pass", "\n"], [_function("a{k}", "", 1, 2), _type("class", "D{k}", 3, 4, "class")], [])),
    ("rust", Template(".rs", ["fn a{k}() { f{k}(1); }", "\nfn bad( {\n  g(2);\n}\n", "pub async fn b{k}(n: u8) { h{k}(3); }", "\n"], [_function("a{k}", "", 0, 1), _function("b{k}", "n: u8", 2, 3)], [("a{k}", "f{k}(1)"), ("b{k}", "h{k}(3)")])),
    ("rust", Template(".rs", ["pub trait T{k} { fn d(&self); }", "\n", "pub const N{k}: u8 = 1;", "\n", "type L{k} = Vec<u8>;", "\n"], [_type("trait", "T{k}", 0, 1, "interface"), Made("const", "N{k}", "", "", "constant N{k}", 2, 3), _type("type", "L{k}", 4, 5)], [])),
    ("rust", Template(".rs", ["impl S{k} {\n", "fn b{k}(s: &'static str) { h{k}('\"', s); }", "\n"], [_function("b{k}", "s: &'static str", 1, 2)], [("b{k}", "h{k}('\"', s)")])),
    ("java", Template(".java", ["class A{k} {\n  ", "void a() { f{k}(1); }", "\n}", "\nclass Bad {\n  void m() {\n", "class B{k} {\n  ", "int[] b(int n) { return h{k}(3); }", "\n}", "\n"], [_type("class", "A{k}", 0, 3), _function("a", "", 1, 2, "A{k}"), _type("class", "B{k}", 4, 7), _function("b", "int n", 5, 6, "B{k}")], [("a", "f{k}(1)"), ("b", "h{k}(3)")])),
    ("java", Template(".java", ["enum K{k} {\n  X;\n  ", "void z() { y{k}(\"\"\"\n}\"\"\"); }", "\n}", "\n"], [_type("enum", "K{k}", 0, 3), Made("method", "z", "", "func z()", "method z", 1, 2)], [("z", "y{k}(\"\"\"\n}\"\"\")")])),
    ("java", Template(".java", ["class C{k} {\n  String s = \"open;\n  ", "void c() { h{k}('\"'); }", "\n}", "\n"], [_type("class", "C{k}", 0, 3), _function("c", "", 1, 2, "C{k}")], [("c", "h{k}('\"')")])),
]


def shape_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content): a file for each customer, of the shape that the key picks."""
    key = F.col("c_custkey").cast("string")
    made = F.array(*(F.struct(F.lit(language).alias("language"), F.lit(s.extension).alias("extension"), F.lit("".join(s.pieces)).alias("text")) for language, s in SHAPES))
    own = F.element_at(made, F.pmod("c_custkey", F.lit(len(SHAPES))).cast("int") + 1)
    rows = spread(t(spark, sf_dir, "customer").select("c_custkey")).select(key.alias("k"), own.alias("own"))
    path = F.concat(F.lit("dir/"), "k", F.lit("/f"), "own.extension")
    return rows.select(path.alias("path"), F.col("own.language").alias("language"), F.encode(F.replace("own.text", F.lit("{k}"), "k"), "UTF-8").alias("content"))


def _shapes_sql() -> str:
    parts = []
    for i, (_, made) in enumerate(SHAPES):
        picked = f"(SELECT c_custkey::VARCHAR AS k FROM customer WHERE c_custkey % {len(SHAPES)} = {i})"
        parts.append(symbols_sql_of(made).replace(" FROM s", f" FROM {picked} s"))
    return " UNION ALL ".join(parts)


@query(_shapes_sql())
def parse_shapes(spark, sf_dir):
    """Sources of many shapes in six languages, some of them damaged: what isn't damaged is found."""
    return named(parse_files(shape_sources(spark, sf_dir)).filter("record <> 'error'"))


@query(
    f"SELECT 'dir/' || c_custkey || '/f.py' AS file, true AS damaged FROM customer WHERE c_custkey % {len(SHAPES)} IN (12, 13, 14, 16)"
)
def parse_errors(spark, sf_dir):
    """Files of which a part couldn't be parsed."""
    return parse.parse_errors(shape_sources(spark, sf_dir)).select("file", F.col("error").startswith("SyntaxError").alias("damaged"))
