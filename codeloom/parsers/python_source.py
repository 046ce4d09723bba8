"""Symbols and calls of Python: the whole file by Python's own ``ast``, or, where that fails, as much as parses by itself.

A file that can't be parsed is cut at its statements; those that parse are taken. Of one that doesn't, the header of a function
or class is tried alone, and the lines inside are cut again. So damage costs the statement it is in, not the file. Strings are
blanked and brackets matched before, so that neither cuts a statement. Each level of indentation is parsed once more at most.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

from codeloom.parsers.scan import Found, Source, Symbol, func_signature, inside, squeeze

_LITERALS = [(b'"""', b'"""', True), (b"'''", b"'''", True), (b'"', b'"', True), (b"'", b"'", True)]
_FAILS = (SyntaxError, ValueError, RecursionError, MemoryError)
_HEAD = re.compile(rb"(?:async[ \t]+)?(?:def|class)\b")
_NAMED = re.compile(rb"class[ \t]+([^\W\d]\w*)")
#: Lines that go on with the statement before, at the same indentation.
_GOES_ON = re.compile(rb"(?:else|elif|except|finally)\b|([)\]}])")
_DOC = re.compile(rb"""(?:\s|#[^\n]*\n)*([rRuU]?(?:\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))""", re.S)


def _blanked(data: bytes) -> Source:
    return Source(data, _LITERALS, line=(b"#",), block=None, spanning=(b'"""', b"'''"))


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.out, self.starts = data, Found(), [0]
        for line in data.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.comments = [(m.start(), m.end()) for m in re.finditer(rb"(?m)^[ \t]*#[^\n]*$", data)]

    def comment(self, start: int) -> str:
        found, k = [], bisect_left(self.comments, (start, start)) - 1
        while k >= 0 and not self.data[self.comments[k][1] : start].strip():
            start, end = self.comments[k]
            found.append(self.data[start:end].decode("utf-8", "replace").strip().lstrip("#").strip())
            k -= 1
        return "\n".join(reversed(found))

    def visit(self, node: ast.AST, owner: str, shift: int = 0) -> None:
        """``shift``: lines of the file before the first one that was parsed."""
        data, out = self.data, self.out
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start, end = self.span(child, shift)
                self.symbol(child, owner, start, end)
                self.visit(child, child.name if isinstance(child, ast.ClassDef) else "", shift)
            else:
                if isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                    a, b = self.span(child, shift)
                    out.calls.append((a, data[a:b].decode("utf-8", "replace")))
                self.visit(child, owner, shift)

    def span(self, node: ast.AST, shift: int) -> tuple[int, int]:
        return self.starts[node.lineno - 1 + shift] + node.col_offset, self.starts[node.end_lineno - 1 + shift] + node.end_col_offset

    def symbol(self, node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, owner: str, start: int, end: int) -> None:
        doc = ast.get_docstring(node, clean=False) or self.comment(start)
        if isinstance(node, ast.ClassDef):
            self.out.symbols.append(Symbol("class", node.name, start, end, f"type {node.name} class", "", doc))
            return
        head = Source(self.data[start:end], [(b'"', b'"', True), (b"'", b"'", True)], line=(b"#",), block=None)
        paren = head.code.find(b"(")
        params = squeeze(head.text(paren + 1, head.match.get(paren, paren + 1)))
        self.out.symbols.append(Symbol("method" if owner else "function", node.name, start, end, func_signature(owner, node.name, params), owner, doc, params))


class _Mender(_Reader):
    """Reads what parses of a file that as a whole doesn't."""

    def __init__(self, data: bytes) -> None:
        super().__init__(data)
        self.src = _blanked(data)
        held = inside([(a + 1, b) for a, b in self.src.match.items() if a < b])
        continued, self.indents = False, []  # of lines that may begin a statement
        last: dict[int, bool] = {}  # by indentation, whether the last statement is a function or class
        for a, b in zip(self.starts, self.starts[1:], strict=False):
            line = self.src.code[a:b]
            own = line.lstrip(b" \t\f")
            at = a + len(line) - len(own)
            indent, joins, begins = len(line) - len(own), _GOES_ON.match(own), bool(_HEAD.match(own))
            if not own.strip() or (continued or held(at)) and not begins or joins and (joins[1] or last.get(indent) is False):
                self.indents.append(None)
            else:
                self.indents.append(indent)
                for deeper in [i for i in last if i > indent]:
                    del last[deeper]
                last[indent] = begins
            continued = line.rstrip(b"\r\n").endswith(b"\\")
        self.read(list(range(len(self.indents))), "")

    def read(self, lines: list[int], owner: str) -> None:
        """Cuts consecutive lines at their statements."""
        begun, decorated, edge = None, False, None
        for k in lines:
            indent = self.indents[k]
            if indent is None:
                continue
            if edge is None:
                edge = indent
            if indent > edge:
                continue
            if not decorated:
                if begun is not None:
                    self.statement(begun, k, owner)
                begun = k
            decorated = self.src.code[self.starts[k] + indent : self.starts[k] + indent + 1] == b"@"
        if begun is not None:
            self.statement(begun, lines[-1] + 1, owner)

    def statement(self, first: int, last: int, owner: str) -> None:
        """Lines [first, last)."""
        a, b = self.starts[first], self.starts[last]
        wrap = b"if 1:\n" if self.indents[first] else b""
        try:
            tree = ast.parse(wrap + self.data[a:b])
        except _FAILS:
            self.damaged(first, last, owner)
            return
        self.visit(tree, owner, first - bool(wrap))

    def damaged(self, first: int, last: int, owner: str) -> None:
        edge, code = self.indents[first], self.src.code
        head = next((k for k in range(first, last) if self.indents[k] is not None and code[self.starts[k] + self.indents[k] : self.starts[k] + self.indents[k] + 1] != b"@"), first)
        start = self.starts[head] + self.indents[head]
        inner = owner
        if _HEAD.match(code, start):
            named = _NAMED.match(code, start)
            inner = named[1].decode("utf-8", "replace") if named else ""
            node = self.header(start, self.starts[last])
            if node is not None:
                self.symbol(node, owner, start, start + len(code[start : self.starts[last]].rstrip()))
        runs: list[list[int]] = []
        for k in range(head + 1, last):
            indent = self.indents[k]
            if indent is not None and indent > edge:
                if runs and runs[-1][-1] == k - 1:
                    runs[-1].append(k)
                else:
                    runs.append([k])
            elif indent is None and runs and runs[-1][-1] == k - 1 and not self.closes(k, edge):
                runs[-1].append(k)
        for run in runs:
            self.read(run, inner)

    def closes(self, k: int, edge: int) -> bool:
        """Whether a line such as ``else:`` goes on with a statement of this indentation."""
        line = self.src.code[self.starts[k] : self.starts[k + 1]]
        own = line.lstrip(b" \t\f")
        return bool(own.strip()) and len(line) - len(own) <= edge

    def header(self, start: int, end: int) -> ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | None:
        """The node of a function or class without its body, if the header parses."""
        code, i = self.src.code, start
        while i < end and code[i] not in b":\n":
            i = self.src.match.get(i, i) + 1 if code[i] in b"([{" else i + 1
        if i >= end or code[i] != 58:
            return None
        doc = _DOC.match(self.data, i + 1, end)
        for body in ([doc[1]] if doc else []) + [b"pass"]:
            try:
                return ast.parse(self.data[start : i + 1] + b" " + body).body[0]
            except _FAILS:
                continue
        return None


def parse_python(data: bytes) -> Found:
    """All of a file that parses, else what parses of it, with ``error``."""
    try:
        tree = ast.parse(data)
    except _FAILS as e:
        out = _Mender(data).out
        out.error = f"{type(e).__name__}: {e}"[:500]
        return out
    reader = _Reader(data)
    reader.visit(tree, "")
    return reader.out
