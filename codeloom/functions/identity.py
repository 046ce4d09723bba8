"""Identities: hashes that must be bit-exact, and qualified names."""

from __future__ import annotations

import hashlib
import os
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_id(qualified_name: Column) -> Column:
    """First four bytes of SHA-256, as hex."""
    return F.substring(F.sha2(qualified_name.cast("binary"), 256), 1, 8)


def blob_sha(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of binary content."""
    return F.substring(content.cast("binary"), start + 1, end - start)


def content_hash(content: Column, start: Column, end: Column) -> Column:
    """First eight bytes of SHA-256 of a byte slice, as hex."""
    return F.substring(F.sha2(byte_slice(content, start, end), 256), 1, 16)


def valid_range(content: Column, start: Column, end: Column) -> Column:
    return (start >= 0) & (end <= F.octet_length(content)) & (start <= end)


def qualified_name(directory: Column, receiver: Column, name: Column) -> Column:
    """``directory.receiver.name``; the receiver is left out if null or empty, the directory is not."""
    dotted = F.when(F.coalesce(receiver, F.lit("")) != "", F.concat(receiver, F.lit("."))).otherwise(F.lit(""))
    return F.concat(F.coalesce(directory, F.lit("")), F.lit("."), dotted, name)


def repo_hash(path: str) -> str:
    """First six bytes of SHA-256 of the cleaned absolute path, as hex."""
    return hashlib.sha256(os.path.abspath(path).encode()).hexdigest()[:12]


def session_id() -> str:
    return "s_" + secrets.token_hex(4)
