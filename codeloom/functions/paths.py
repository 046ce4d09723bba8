"""Paths: languages, globs, exclusions, ignore rules, package roots, scopes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension, names that mark a package, what is never indexed.
EXTENSIONS = {
    ".go": "go",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".py": "python",
    ".pyi": "python",
    ".rs": "rust",
    ".java": "java",
}
MANIFESTS = ["go.mod", "package.json", "pyproject.toml", "Cargo.toml", "pom.xml", "build.gradle", "setup.py", "setup.cfg"]
EXCLUSIONS = ["node_modules/", "vendor/", ".git/", "__pycache__/", "target/", "dist/", "build/", "*.min.js", "*.min.css", "*.lock", "*.map", "*.wasm"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The directory of a path, empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Null for an extension that isn't known."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.element_at(known, extension(path))


def top_level(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, from the root (empty) down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def in_scope(path: Column, scope: str) -> Column:
    scope = clean_scope(scope)
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def clean_scope(scope: str) -> str:
    import posixpath

    out = posixpath.normpath(scope.replace("\\", "/")) if scope else ""
    return "" if out == "." else out


def _glob(pattern: str, deep: bool) -> str:
    """A regular expression for a glob; ``deep``: ``**`` crosses directories."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if deep and pattern.startswith("**/", i):
            out, i = out + "(?:.+/)?", i + 3
        elif deep and pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and (end := pattern.find("]", i)) > 0:
            out, i = out + pattern[i : end + 1], end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def glob_regex(pattern: str) -> str:
    """For a base name: the whole of it."""
    return "^" + _glob(pattern, False) + "$"


def is_excluded(path: Column, extra: Sequence[str] = ()) -> Column:
    """``name/`` fits any part of the path; other patterns fit the base name."""
    name, parts, out = basename(path), F.split(path, "/"), F.lit(False)
    for p in [*EXCLUSIONS, *extra]:
        out = out | (F.array_contains(parts, p[:-1]) if p.endswith("/") else name.rlike(glob_regex(p)))
    return out


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file; ``directory`` is where the file lies."""

    directory: str
    ordinal: int
    regex: str
    negate: bool
    dir_only: bool
    pattern: str = ""


def parse_ignore_line(line: str, directory: str = "", ordinal: int = 0) -> IgnoreRule | None:
    """Null for blanks and comments. A backslash takes the meaning from a first ``#`` or ``!``."""
    line = line.rstrip(" \t\r\n")
    if not line or line.startswith("#"):
        return None
    escaped = line.startswith("\\")
    line = line[1:] if escaped else line
    negate = line.startswith("!") and not escaped
    line = line[1:] if negate else line
    dir_only = line.endswith("/")
    line = line[:-1] if dir_only else line
    if not line:
        return None
    anchored = "/" in line
    body = _glob(line.removeprefix("/"), True)
    regex = ("^" if anchored else "(?:^|/)") + body + "(?:/.*)?$"
    try:
        re.compile(regex)
    except re.error:
        return None
    return IgnoreRule(directory, ordinal, regex, negate, dir_only, line)


def ignore_rules(lines: Iterable[str], directory: str = "") -> list[IgnoreRule]:
    found = (parse_ignore_line(line, directory, k) for k, line in enumerate(lines))
    return [r for r in found if r]


def _some_directory(path: Column, regex: str) -> Column:
    """Whether a directory above the path fits."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return (F.size(parts) > 1) & F.exists(above, lambda d: d.rlike(regex))


def is_ignored(path: Column, rules: Sequence[IgnoreRule], is_dir: bool = False) -> Column:
    """The last rule that fits decides, from the root's file down to the nearest.

    A rule for directories fits a file below such a directory: it is tried on every directory above the path.
    """
    ordered = sorted(rules, key=lambda r: (r.directory.count("/") + bool(r.directory), r.ordinal))
    out = F.lit(False)
    for r in ordered:  # later ones outside
        own = path if not r.directory else F.when(path.startswith(r.directory + "/"), F.substr(path, F.lit(len(r.directory) + 2)))
        if r.dir_only and not is_dir:
            fits = _some_directory(own, r.regex)
        else:
            fits = own.rlike(r.regex)
        out = F.when(F.coalesce(fits, F.lit(False)), F.lit(not r.negate)).otherwise(out)
    return out


def with_package_root(files: DataFrame, path: str = "path", manifests: Sequence[str] = MANIFESTS) -> DataFrame:
    """Adds ``package_root``: the nearest directory above with a manifest, ``.`` for the root, empty if there is none.

    The directories above each file are one row each, matched to the manifests' directories and reduced again by path.
    """
    homes = files.filter(basename(F.col(path)).isin(list(manifests))).select(directory(F.col(path)).alias("home")).distinct()
    above = files.select(F.col(path).alias("p_")).distinct().withColumn("home", F.explode(ancestors(F.col("p_"))))
    best = above.join(homes, "home").groupBy("p_").agg(F.max_by("home", F.length("home")).alias("home"))
    root = F.when(F.col("home").isNull(), F.lit("")).when(F.col("home") == "", F.lit(".")).otherwise(F.col("home"))
    return files.join(best, F.col(path) == F.col("p_"), "left").withColumn("package_root", root).drop("p_", "home")
