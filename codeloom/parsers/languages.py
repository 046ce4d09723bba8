"""Symbols and calls of six languages, without a grammar library: blanked sources and bracket matching; for Python see ``python_source``."""

from __future__ import annotations

import re
from collections.abc import Callable

from codeloom.parsers.python_source import parse_python
from codeloom.parsers.scan import IDENT, Around, Found, Source, Symbol, func_signature, inside, squeeze

_KEYWORDS = frozenset(
    b"if for while switch catch return func function fn match else elif do try with typeof await yield super throw case in of select go defer range synchronized assert import require impl where as loop unsafe move new delete void instanceof sizeof".split()
)
#: What stands before a parenthesis and a brace in a class body that isn't closed where it should be.
_STATEMENTS = frozenset(b"if for while switch catch function return with".split())
_GO_KEYWORDS = frozenset(b"if for switch return func else case select go defer range var const type struct interface map chan package import".split())


def _strip_type(text: str) -> str:
    return text.split("<", 1)[0].strip()


# --- Go


def _go_type_word(code: bytes, at: int) -> str:
    """What stands for the kind of a named type in its signature."""
    for pattern, word in (
        (rb"struct\b", "struct"),
        (rb"interface\b", "interface"),
        (rb"map\s*\[", "map_type"),
        (rb"func\b", "function_type"),
        (rb"(?:<-\s*)?chan\b", "channel_type"),
        (rb"\[\s*\]", "slice_type"),
        (rb"\[", "array_type"),
        (rb"\*", "pointer_type"),
        (IDENT + rb"\." + IDENT, "qualified_type"),
        (IDENT + rb"\[", "generic_type"),
        (rb"\(", "parenthesized_type"),
    ):
        if re.compile(pattern).match(code, at):
            return word
    return "type_identifier"


def _go_receiver(text: str) -> str:
    inner = squeeze(text.strip()[1:-1].split("[", 1)[0])
    return inner.split(" ")[-1].lstrip("*") if inner else ""


def _go_body(src: Source, i: int) -> int | None:
    """The brace that opens a function's body after its parameters, past its results."""
    code = src.code
    while i < len(code):
        c = code[i]
        if c in b"([" and i in src.match:
            i = src.match[i]
        elif c == 123:
            if re.search(rb"\b(?:struct|interface)\s*$", code[max(0, i - 16) : i]) and i in src.match:
                i = src.match[i]
            else:
                return i if i in src.match else None
        elif c in b"\n;":
            return None
        i += 1
    return None


def parse_go(data: bytes) -> Found:
    src = Source(data, [(b'"', b'"', True), (b"`", b"`", False), (b"'", b"'", True)], spanning=(b"`",))
    out, code, declared = Found(), src.code, set()
    for m in re.finditer(rb"(?m)^func\b[ \t]*", code):
        i, receiver = m.end(), ""
        if code[i : i + 1] == b"(" and i in src.match:
            receiver = _go_receiver(src.text(i, src.match[i] + 1))
            i = src.skip(src.match[i] + 1)
        name = re.compile(IDENT).match(code, i)
        if not name:
            continue
        i = src.skip(name.end())
        if code[i : i + 1] == b"[" and i in src.match:
            i = src.skip(src.match[i] + 1)
        if code[i : i + 1] != b"(" or i not in src.match:
            continue
        declared.add(i)
        body = _go_body(src, src.match[i] + 1)
        if body is None:
            continue
        params = squeeze(src.text(i + 1, src.match[i]))
        word = name[0].decode("utf-8", "replace")
        out.symbols.append(Symbol("method" if receiver else "function", word, m.start(), src.match[body] + 1, func_signature(receiver, word, params), receiver, src.comment_before(m.start()), params))
    for m in re.finditer(rb"(?m)(?<![\w.])type[ \t]+(?=[A-Za-z_(\x80-\xff])", code):
        group = code[m.end() : m.end() + 1] == b"("
        outer = src.match.get(m.end()) if group else None
        if group and outer is None:
            continue
        i = src.skip(m.end() + 1) if group else m.end()
        while True:
            name = re.compile(IDENT).match(code, i)
            if not name:
                break
            at = src.skip(name.end())
            if code[at : at + 1] == b"[" and at in src.match and re.match(rb"\s*" + IDENT + rb"\s+[A-Za-z~*\[(]", code[at + 1 : src.match[at]]):
                at = src.skip(src.match[at] + 1)  # type parameters
            end = src.statement_end(at)
            if code[at : at + 1] != b"=":
                word, kind = name[0].decode("utf-8", "replace"), _go_type_word(code, at)
                stop = outer + 1 if group else len(code[:end].rstrip())
                own = m.start()
                out.symbols.append(Symbol("interface" if kind == "interface" else "type", word, own, stop, f"type {word} {kind}", "", src.comment_before(own)))
            if not group:
                break
            i = src.skip(end + 1)
            if i >= outer:
                break
    for m in re.finditer(rb"(?m)^(const|var)[ \t]+", code):
        kind = m[1].decode()
        if code[m.end() : m.end() + 1] == b"(":
            if m.end() not in src.match:
                continue
            stop, i, last = src.match[m.end()] + 1, src.skip(m.end() + 1), src.match[m.end()]
        else:
            i, last = m.end(), src.statement_end(m.end())
            stop = len(code[:last].rstrip())
        while i < last:
            names = re.compile(IDENT + rb"(?:\s*,\s*" + IDENT + rb")*").match(code, i)
            if names:
                for name in re.findall(IDENT, names[0]):
                    out.symbols.append(Symbol(kind, name.decode("utf-8", "replace"), m.start(), stop, "", "", src.comment_before(m.start())))
            i = src.skip(src.statement_end(i) + 1)
    in_spec = inside([(m.end(), src.match.get(m.end() - 1, 0)) for m in re.finditer(rb"\binterface\s*\{", code)])
    out.calls = [c for c in src.calls(_GO_KEYWORDS, declared) if not in_spec(c[0])]
    return out


# --- TypeScript and JavaScript


def _body_after(src: Source, i: int) -> int | None:
    """The brace of a body after parameters, past a result type."""
    code = src.code
    i = src.skip(i)
    if code[i : i + 1] == b":":
        i = src.skip(i + 1)
        if code[i : i + 1] == b"{" and i in src.match:  # an object type
            i = src.skip(src.match[i] + 1)
    while i < len(code):
        c = code[i]
        if c in b"([" and i in src.match:
            i = src.match[i]
        elif c == 60:  # type arguments
            depth, k = 1, i + 1
            while k < len(code) and depth and code[k] not in b";":
                depth += (code[k] == 60) - (code[k] == 62 and code[k - 1] != 61)
                k += 1
            i = k - 1
        elif c == 123 and src.before(i)[-1:] in (b"|", b"&") and i in src.match:  # an object type
            i = src.match[i]
        elif c == 123:
            return i if i in src.match else None
        elif c in b";=}" and code[i : i + 2] != b"=>":
            return None
        i += 1
    return None


def _params(src: Source, i: int) -> int | None:
    """The parenthesis of the parameters, past type parameters."""
    i = src.skip(i)
    if src.code[i : i + 1] == b"<":
        depth = 0
        while i < len(src.code):
            depth += (src.code[i] == 60) - (src.code[i] == 62 and src.code[i - 1] != 61)
            i += 1
            if not depth:
                break
        i = src.skip(i)
    return i if src.code[i : i + 1] == b"(" and i in src.match else None


def _script(data: bytes, typed: bool) -> Found:
    src = Source(data, [(b'"', b'"', True), (b"'", b"'", True)], template=b"`")
    out, code, declared = Found(), src.code, set()

    def comment(at: int) -> str:
        window = max(0, at - 256)
        lead = re.search(rb"(?:\b(?:export|default|declare|abstract)\s+)+$", code[window:at])
        return src.comment_before(window + lead.start() if lead else at)

    for m in re.finditer(rb"(?<![\w$.])(?:async\s+)?function\s+(" + IDENT + rb")", code):
        before = src.before(m.start())
        paren = _params(src, m.end())
        if paren is None:
            continue
        declared.add(paren)
        if before[-1:] in (b"=", b"(", b",", b":", b"?", b"!", b"&", b"|") or re.search(rb"\b(?:return|new|typeof|await)$", before):
            continue
        body = _body_after(src, src.match[paren] + 1)
        if body is not None:
            name, params = m[1].decode("utf-8", "replace"), squeeze(src.text(paren + 1, src.match[paren]))
            out.symbols.append(Symbol("function", name, m.start(), src.match[body] + 1, func_signature("", name, params), "", comment(m.start()), params))
    for m in re.finditer(rb"(?<![\w$.])(?:abstract\s+)?class\s+(" + IDENT + rb")", code):
        body = code.find(b"{", m.end())
        before = src.before(m.start())
        if body < 0 or body not in src.match or before[-1:] in (b"=", b"(", b","):
            continue
        name, end = m[1].decode("utf-8", "replace"), src.match[body]
        out.symbols.append(Symbol("class", name, m.start(), end + 1, f"type {name} class", "", comment(m.start())))
        i = body + 1
        member = re.compile(rb"((?:(?:static|async|public|private|protected|readonly|override|abstract|get|set)\s+|\*\s*)*)(" + IDENT + rb")(?=\s*[<(])")
        while i < end:
            i = src.skip(i)
            found = member.match(code, i)
            paren = _params(src, found.end()) if found else None
            inner = _body_after(src, src.match[paren] + 1) if paren is not None else None
            if paren is not None:
                declared.add(paren)
            if inner is not None and inner < end and found[2] not in _STATEMENTS:
                word, params = found[2].decode("utf-8", "replace"), squeeze(src.text(paren + 1, src.match[paren]))
                out.symbols.append(Symbol("method", word, i, src.match[inner] + 1, func_signature(name, word, params), name, src.comment_before(i), params))
                i = src.match[inner] + 1
            elif i < end:
                stop = src.statement_end(i)
                i = max(stop, i) + 1
    if typed:
        for m in re.finditer(rb"(?<![\w$.])interface\s+(" + IDENT + rb")[^{};()]*\{", code):
            if m.end() - 1 in src.match:
                name = m[1].decode("utf-8", "replace")
                out.symbols.append(Symbol("interface", name, m.start(), src.match[m.end() - 1] + 1, f"type {name} interface", "", comment(m.start())))
        for m in re.finditer(rb"(?m)(?<![\w$.])type\s+(" + IDENT + rb")\s*(?:<[^=;{}()]*>)?\s*=(?![=>])", code):
            end = src.statement_end(src.skip(m.end()), b";")
            line = src.statement_end(src.skip(m.end()), b"\n;")
            if not re.match(rb"\s*[|&]", code[line : line + 80]):
                end = min(end, line)
            end += code[end : end + 1] == b";"
            name = m[1].decode("utf-8", "replace")
            out.symbols.append(Symbol("type", name, m.start(), end, f"type {name} type", "", comment(m.start())))
    in_shape = inside([(s.start, s.end) for s in out.symbols if s.kind in ("interface", "type")])
    out.calls = [c for c in src.calls(_KEYWORDS, declared) if not in_shape(c[0])]
    return out


def parse_typescript(data: bytes) -> Found:
    return _script(data, True)


def parse_javascript(data: bytes) -> Found:
    return _script(data, False)


# --- Rust


def parse_rust(data: bytes) -> Found:
    raw = [(b'r' + b"#" * k + b'"', b'"' + b"#" * k, False) for k in range(3)]
    src = Source(data, [*raw, (b'"', b'"', True)], nested=True, char=True, spanning=(b'"', *(b for _, b, _ in raw)))
    out, code, declared = Found(), src.code, set()

    def comment(at: int) -> str:
        while (a := re.search(rb"#!?\[[^\]\n]*\]\s*$", code[(window := max(0, at - 4096)) : at])) is not None:
            at = window + a.start()
        return src.comment_before(at)

    homes: list[tuple[int, int, str]] = []
    for m in re.finditer(rb"(?m)(?<![\w.])(impl|trait)\b", code):
        body = code.find(b"{", m.end())
        if body < 0 or body not in src.match or b";" in code[m.end() : body]:
            continue
        head = code[m.end() : body].decode("utf-8", "replace")
        if m[1] == b"impl":
            head = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", head).split(" where ")[0]
            target = _strip_type(head.split(" for ")[-1])
            homes.append((body, src.match[body], re.sub(r"^&?(?:'\w+\s+)?(?:mut\s+)?", "", target).strip()))
        else:
            homes.append((body, src.match[body], ""))
    around = Around(homes)
    lead = rb"((?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*)"
    for m in re.finditer(rb"(?<![\w.])" + lead + rb"fn\s+(" + IDENT + rb")", code):
        paren = _params(src, m.end())
        if paren is None:
            continue
        declared.add(paren)
        body = code.find(b"{", src.match[paren])
        semi = code.find(b";", src.match[paren])
        if body < 0 or 0 <= semi < body or body not in src.match:
            continue
        home = (around(m.start()) or [None])[-1]
        receiver, start = home[2] if home else "", m.start()
        name, params = m[2].decode("utf-8", "replace"), squeeze(src.text(paren + 1, src.match[paren]))
        if home and not receiver:  # a default method of a trait
            continue
        out.symbols.append(Symbol("method" if receiver else "function", name, start, src.match[body] + 1, func_signature(receiver, name, params), receiver, comment(start), params))
    in_home = inside([(a + 1, b) for a, b, _ in homes])
    for m in re.finditer(rb"(?m)^[ \t]*((?:pub(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+)?)(struct|enum|trait|type|const)\s+(" + IDENT + rb")", code):
        start = m.start(1) if m[1] else m.start(2)
        word, name = m[2].decode(), m[3].decode("utf-8", "replace")
        if in_home(start) or m[3] == b"fn":
            continue
        stop = src.statement_end(m.end(), b";")
        brace = code.find(b"{", m.end())
        if word in ("struct", "enum", "trait") and 0 <= brace <= stop and brace in src.match:
            end = src.match[brace] + 1
        else:
            end = stop + 1
        kind = {"trait": "interface", "const": "const"}.get(word, "type")
        out.symbols.append(Symbol(kind, name, start, end, "" if word == "const" else f"type {name} {word}", "", comment(start)))
    out.calls = src.calls(_KEYWORDS | {b"pub"}, declared)
    return out


# --- Java

_ARGUMENTS, _MEMBER = re.compile(rb"\s*\("), re.compile(rb"[\w.]")


def parse_java(data: bytes) -> Found:
    src = Source(data, [(b'"""', b'"""', True), (b'"', b'"', True), (b"'", b"'", True)], spanning=(b'"""',))
    out, code, declared = Found(), src.code, set()
    modifiers = rb"((?:(?:public|private|protected|static|final|abstract|sealed|strictfp|synchronized|native|default)\s+|@" + IDENT + rb"(?:\s*\([^()]*\))?\s+)*)"
    homes: list[tuple[int, int, str, str]] = []
    for m in re.finditer(modifiers + rb"(?<![\w.@])(class|interface|enum)\s+(" + IDENT + rb")", code):
        body = code.find(b"{", m.end())
        if body < 0 or body not in src.match:
            continue
        word, name, start = m[2].decode(), m[3].decode("utf-8", "replace"), m.start(1) if m[1] else m.start(2)
        homes.append((body, src.match[body], name, word))
        out.symbols.append(Symbol("interface" if word == "interface" else "type", name, start, src.match[body] + 1, f"type {name} {word}", "", src.comment_before(start)))
    member = re.compile(modifiers + rb"(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>\s*)?([A-Za-z_$][\w$.]*(?:\s*<[^;(){}]*>)?(?:\s*\[\s*\])*)\s+(" + IDENT + rb")\s*\(")
    homes_around = Around(homes)
    for m in member.finditer(code):
        paren = m.end() - 1
        kind = m[2].split(b"<")[0].split()[0]
        if paren not in src.match or kind in (b"new", b"return", b"throw", b"else", b"case", b"assert", b"instanceof") or m[3] in _KEYWORDS:
            continue
        after = src.skip(src.match[paren] + 1)
        throws = re.compile(rb"throws\s+[\w.,\s$]+").match(code, after)
        after = src.skip(throws.end()) if throws else after
        around = list(homes_around(m.start()))
        if not around:
            continue
        if code[after : after + 1] == b";" and around[-1][3] == "interface":
            declared.add(paren)
        if code[after : after + 1] != b"{" or after not in src.match:
            continue
        declared.add(paren)
        if m[2].split()[-1] in (b"public", b"private", b"protected"):  # a constructor
            continue
        start = m.start(1) if m[1] else m.start(2)
        classes = [h for h in around if h[3] == "class"]
        receiver = classes[-1][2] if classes else ""
        name, params = m[3].decode("utf-8", "replace"), squeeze(src.text(paren + 1, src.match[paren]))
        out.symbols.append(Symbol("method", name, start, src.match[after] + 1, func_signature(receiver, name, params), receiver, src.comment_before(start), params))
    for body, end, name, _ in homes:  # constructors are no calls
        word = name.encode()
        at = code.find(word, body, end)
        while at >= 0:  # by no pattern of the name, which would be compiled for each
            if (m := _ARGUMENTS.match(code, at + len(word), end)) and not _MEMBER.match(code, at - 1):
                declared.add(m.end() - 1)
            at = code.find(word, at + 1, end)
    out.calls = src.calls(_KEYWORDS, declared)
    return out


PARSERS: dict[str, Callable[[bytes], Found]] = {
    "go": parse_go,
    "typescript": parse_typescript,
    "javascript": parse_javascript,
    "python": parse_python,
    "rust": parse_rust,
    "java": parse_java,
}


def register(language: str, parser: Callable[[bytes], Found]) -> None:
    """Adds a parser; a language can have but one."""
    if language in PARSERS:
        raise ValueError(f"a parser for {language} is registered already")
    PARSERS[language] = parser
