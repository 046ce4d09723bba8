"""Security: tiers of paths, secrets in values, placeholders, binary content, safe paths."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.paths import basename, glob_regex

NORMAL, REDACTED, IGNORED = 0, 1, 2

# Names of files whose values are redacted, patterns of secrets and of placeholders.
REDACTED_NAMES = [".env", "*.env.*", "*.pem", "*.key", "*.p12", "id_rsa*", "credentials.*", ".netrc"]
SECRET_PATTERNS = [
    r"""(?i)api[_-]?key\s*[:=]\s*["']?[A-Za-z0-9_\-]{20,}""",
    r"""(?i)secret\s*[:=]\s*["']?[A-Za-z0-9_\-]{20,}""",
    r"""(?i)password\s*[:=]\s*["']?[^\s"']{8,}""",
    r"""(?i)token\s*[:=]\s*["']?[A-Za-z0-9_\-]{20,}""",
    r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----",
    r"(?i)(postgres|mysql|mongodb|redis)://[^\s]+",
]
PLACEHOLDER_PATTERNS = [
    r"(?i)^x+$",
    r"(?i)^YOUR_",
    r"^<[^>]+>$",
    r"(?i)^TODO$",
    r"(?i)^changeme$",
    r"(?i)^dummy",
    r"(?i)^fake",
    r"(?i)^example",
    r"^0+$",
    r"^\*+$",
    r"(?i)^REPLACE_",
]
SECRET_HINT = r"(?i)(API_?KEY|SECRET|PASSW|TOKEN|PRIVATE_KEY)"

BINARY_BYTES = 8192
NULL_SHARE = 0.001


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _named(name: Column, patterns: Sequence[str]) -> Column:
    return _any([name.rlike(glob_regex(p)) for p in patterns])


def tier(path: Column, ignored: Sequence[str] = (), redacted: Sequence[str] = ()) -> Column:
    """2 for ignored names, else 1 for redacted ones, else 0."""
    name = basename(path)
    return F.when(_named(name, ignored), F.lit(IGNORED)).when(_named(name, [*REDACTED_NAMES, *redacted]), F.lit(REDACTED)).otherwise(F.lit(NORMAL))


def is_secret(value: Column, extra: Sequence[str] = ()) -> Column:
    return _any([value.rlike(p) for p in [*SECRET_PATTERNS, *extra]])


def is_placeholder(value: Column) -> Column:
    return _any([value.rlike(p) for p in PLACEHOLDER_PATTERNS])


def has_secret_hint(name: Column) -> Column:
    return name.rlike(SECRET_HINT)


def is_binary(content: Column) -> Column:
    """More than one byte in a thousand of the first 8192 is zero. The zeros are counted in the JVM, on hex digits."""
    head = F.substring(content.cast("binary"), 1, BINARY_BYTES)
    text = F.decode(head, "ISO-8859-1")
    zeros = F.length(text) - F.length(F.translate(text, "\0", ""))
    return F.coalesce(zeros > NULL_SHARE * F.octet_length(head), F.lit(False))


def safe_path(root: str, path: str) -> bool:
    """An existing path that stays under the root once links are resolved."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return os.path.exists(full) and (full == base or full.startswith(base + os.sep))
