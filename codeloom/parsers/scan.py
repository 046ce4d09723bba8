"""What the brace languages share: masking of strings and comments, bracket matching, call expressions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

OPEN, CLOSE = b"([{", b")]}"
IDENT = rb"[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*"


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    signature: str = ""
    receiver: str = ""
    comment: str = ""
    params: str = ""
    summary: str = ""


@dataclass
class Found:
    symbols: list[Symbol] = field(default_factory=list)
    calls: list[tuple[int, str]] = field(default_factory=list)
    #: Why a part of the file is missing.
    error: str = ""


def squeeze(text: str) -> str:
    return " ".join(text.split())


def first_sentence(comment: str) -> str:
    lines = []
    for line in comment.split("\n"):
        line = line.strip().removeprefix("//").removeprefix("/*").removesuffix("*/").removeprefix("*").strip()
        if line:
            lines.append(line)
    m = re.match(r"[^.!?]*[.!?]?", " ".join(lines), re.S)
    return m[0] if m else ""


def template(kind: str, name: str, params: str) -> str:
    if kind in ("function", "method"):
        return f"{kind} {name} accepting {params}" if params else f"{kind} {name}"
    return {"const": "constant", "var": "variable"}.get(kind, kind) + " " + name


def func_signature(receiver: str, name: str, params: str) -> str:
    return f"func {f'({receiver}) ' if receiver else ''}{name}({params})"


def inside(spans: list[tuple[int, int]]) -> Callable[[int], bool]:
    """Whether a place lies in one of the spans [start, end)."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return lambda at: (k := bisect_right(starts, at)) > 0 and at < ends[k - 1]


class Around:
    """The nested spans (start, end, ...) that hold a place, outermost first, for places in ascending order."""

    def __init__(self, spans: list[tuple]) -> None:
        self.spans, self.at, self.open = sorted(spans, key=lambda s: (s[0], -s[1])), 0, []

    def __call__(self, place: int) -> list[tuple]:
        while self.at < len(self.spans) and self.spans[self.at][0] < place:
            while self.open and self.open[-1][1] <= self.spans[self.at][0]:
                self.open.pop()
            self.open.append(self.spans[self.at])
            self.at += 1
        while self.open and self.open[-1][1] <= place:
            self.open.pop()
        return self.open


@cache
def _openers(openers: tuple[bytes, ...]) -> tuple[re.Pattern, re.Pattern]:
    """What begins a comment or literal, and the same or a brace."""
    longest_first = sorted(map(re.escape, openers), key=len, reverse=True)
    return re.compile(b"|".join(longest_first)), re.compile(b"|".join([*longest_first, rb"[{}]"]))


class Source:
    """A file with its strings and comments blanked, byte for byte."""

    def __init__(
        self,
        data: bytes,
        literals: list[tuple[bytes, bytes, bool]],
        line: tuple[bytes, ...] = (b"//",),
        block: tuple[bytes, bytes] | None = (b"/*", b"*/"),
        nested: bool = False,
        char: bool = False,
        template: bytes = b"",
        spanning: tuple[bytes, ...] = (),
    ) -> None:
        """``literals``: opening, closing, whether a backslash escapes. ``char``: a quote may also begin a lifetime.
        ``template``: the quote of strings whose ``${...}`` hold code, which stays. ``spanning``: closing quotes of literals that
        may go over several lines. A literal that isn't closed ends with its line, so that it doesn't hide what follows."""
        self.data, self.literals, self.line, self.block, self.nested, self.template, self.spanning = data, literals, line, block, nested, template, set(spanning)
        self.bytes, self.comments = bytearray(data), []
        self.find, self.find_within = _openers((*line, *(block or ())[:1], *(a for a, _, _ in literals), *((b"'",) if char else ()), *((template,) if template else ())))
        self._blank_all(char)
        self.code = bytes(self.bytes)
        self.match = self._brackets()

    def _blank(self, a: int, b: int) -> None:
        self.bytes[a:b] = re.sub(rb"[^\n]", b" ", self.data[a:b])

    def _blank_all(self, char: bool) -> None:
        data, i, n = self.data, 0, len(self.data)
        depths: list[int] = []  # of braces, for each ``${`` that is open
        while (m := (self.find_within if depths else self.find).search(data, i)) is not None:
            at, what = m.start(), m[0]
            if depths and what in (b"{", b"}"):
                depths[-1] += 1 if what == b"{" else -1
                i = at + 1
                if depths[-1] < 0:  # the rest of the template
                    depths.pop()
                    i = self._template(at, i, depths)
                continue
            if what in self.line:
                end = data.find(b"\n", at)
                end = n if end < 0 else end
                self.comments.append((at, end))
            elif self.block and what == self.block[0]:
                end = self._block_end(data, m.end(), self.block, self.nested)
                self.comments.append((at, end))
            elif what == self.template:
                i = self._template(at, m.end(), depths)
                continue
            elif char and what == b"'":
                c = re.compile(rb"'(?:\\(?:u\{[^}]*\}|x[0-9A-Fa-f]{2}|.)|[^'\\\n\x80-\xff]|[\xc0-\xff][\x80-\xbf]+)'", re.S).match(data, at)
                if not c:
                    i = at + 1
                    continue
                end = c.end()
            else:
                close, escapes = next((b, e) for a, b, e in self.literals if a == what)
                end = self._literal_end(m.end(), close, escapes)
                if not data.startswith(close, max(end - len(close), m.end())):
                    self._blank(at, end)
                    self.bytes[end - 1] = 59  # what follows is a statement of its own
                    i = end
                    continue
            self._blank(at, end)
            i = max(end, at + 1)

    def _template(self, at: int, i: int, depths: list[int]) -> int:
        """Blanks a template's text from ``at`` up to its end or the next code in it; what is read next begins there.
        The borders of code become commas."""
        for m in re.compile(rb"\\.|\$\{|" + re.escape(self.template), re.S).finditer(self.data, i):
            if m[0] == b"${":
                depths.append(0)
                self._blank(at, m.end())
                self.bytes[m.start()] = 44
                break
            if m[0] == self.template:
                self._blank(at, m.end())
                break
        else:
            end = self._line_end(i)
            self._blank(at, end)
            self.bytes[end - 1] = 59
            return end
        if self.data[at] == 125:
            self.bytes[at] = 44
        return m.end()

    @staticmethod
    def _block_end(data: bytes, i: int, block: tuple[bytes, bytes], nested: bool) -> int:
        depth = 1
        for m in re.compile(re.escape(block[0]) + b"|" + re.escape(block[1])).finditer(data, i):
            if m[0] == block[1]:
                depth -= 1
            elif nested:
                depth += 1
            if not depth:
                return m.end()
        return len(data)

    def _line_end(self, i: int) -> int:
        end = self.data.find(b"\n", i)
        return len(self.data) if end < 0 else end

    def _literal_end(self, i: int, close: bytes, escapes: bool) -> int:
        data, start = self.data, i
        while i < len(data):
            if escapes and data[i] == 92:
                i += 2
            elif data.startswith(close, i):
                return i + len(close)
            elif data[i] == 10 and close not in self.spanning:
                return i
            else:
                i += 1
        self.spanning.discard(close)  # no other one need be looked for to the end of the file
        return self._line_end(start)

    def _brackets(self) -> dict[int, int]:
        """Each bracket's partner, both ways."""
        out: dict[int, int] = {}
        stack: list[tuple[int, int]] = []
        for m in re.finditer(rb"[()\[\]{}]", self.code):
            c, at = m[0][0], m.start()
            if c in OPEN:
                stack.append((c, at))
            elif stack and OPEN.index(stack[-1][0]) == CLOSE.index(c):
                _, a = stack.pop()
                out[a], out[at] = at, a
        return out

    def text(self, a: int, b: int) -> str:
        return self.data[a:b].decode("utf-8", "replace")

    def skip(self, i: int) -> int:
        while i < len(self.code) and self.code[i] in b" \t\r\n":
            i += 1
        return i

    def before(self, at: int, window: int = 256) -> bytes:
        """The code before a place, without white space at its end, as far back as a look at single words needs."""
        return self.code[max(0, at - window) : at].rstrip()

    def comment_before(self, at: int) -> str:
        """The comments that stand directly before, joined by line ends."""
        found, k = [], bisect_left(self.comments, (at, 0)) - 1
        while k >= 0 and not self.data[self.comments[k][1] : at].strip():
            a, b = self.comments[k]
            found.append(self.text(a, b))
            at, k = a, k - 1
        return "\n".join(reversed(found))

    def statement_end(self, i: int, stops: bytes = b";\n") -> int:
        """The first stop outside brackets."""
        while i < len(self.code):
            c = self.code[i]
            if c in OPEN and i in self.match:
                i = self.match[i]
            elif c in stops or c in CLOSE:
                return i
            i += 1
        return len(self.code)

    def expression_start(self, i: int) -> int:
        """Where the operand chain that ends before ``i`` begins: names, calls and indexes joined by ``.``, ``::`` or ``?.``."""
        code = self.code
        while True:
            j = i
            while j > 0 and (chr(code[j - 1]).isalnum() or code[j - 1] in b"_$" or code[j - 1] >= 128):
                j -= 1
            i = j
            k = i
            for joint in (b"?.", b"::", b"."):
                if code.endswith(joint, 0, k):
                    k -= len(joint)
                    break
            else:
                return i
            while k > 0 and code[k - 1] in b" \t\r\n":
                k -= 1
            while k > 0 and code[k - 1] in b")]" and (k - 1) in self.match:
                k = self.match[k - 1]
            if k > 0 and code[k - 1] == 62 and (lt := code.rfind(b"<", 0, k)) > 0 and code.endswith(b"::", 0, lt):
                k = lt - 2
            i = k

    def calls(self, keywords: frozenset[bytes], declared: set[int], macro: bool = False) -> list[tuple[int, str]]:
        """(offset, text) of each call of a name; ``declared``: parentheses of declarations."""
        out = []
        for m in re.finditer(rb"(" + IDENT + rb")\s*(?:::\s*<[^<>()]*>\s*)?\(", self.code):
            paren = m.end() - 1
            if paren in declared or m[1] in keywords and self.code[m.start() - 1 : m.start()] != b"." or paren not in self.match:  # a member may be named like a keyword
                continue
            begin = self.expression_start(m.end(1))
            before = self.before(begin)
            if re.search(rb"\bnew$", before):
                if b"(" not in self.code[begin : m.start(1)]:  # a constructor
                    continue
                begin = self.code.rindex(b"new", 0, begin)  # a call on what was made
            elif re.search(rb"\b(?:func|function|fn|class)$", before):
                continue
            out.append((begin, self.text(begin, self.match[paren] + 1)))
        return out
