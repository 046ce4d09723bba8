"""Schemas of the persistent relations."""

from __future__ import annotations

FILES = "path string, blob_sha string, mtime string, size long, last_indexed string"
SYMBOLS = (
    "id string, kind string, name string, qualified_name string, language string, file string, package_root string, signature string, "
    "summary string, content_hash string, byte_start int, byte_end int, line_start int, line_end int, parent_id string, depth int, "
    "children array<string>, tags array<string>, imports array<string>, possible_unresolved boolean, untracked boolean, indexed_at string"
)
EDGES = "caller_id string, callee_id string, raw_expression string, confidence string"
CALLS = f"file string, {EDGES}"
SAVINGS = "session_id string, tool_name string, call_at timestamp, timing_ms double, tokens_saved long"
CONTENTS = "blob_sha string, content binary"
PARSED = (
    "record string, file string, ordinal int, id string, kind string, name string, qualified_name string, signature string, summary string, "
    "byte_start int, byte_end int, line_start int, line_end int, parent_id string, depth int, caller_id string, raw_expression string, "
    "confidence string, error string, content_hash string, secret boolean"
)

VERSION = 2
KINDS = ["function", "class", "method", "interface", "type", "const", "var"]
CONFIDENCES = ["static", "inferred", "dynamic"]
ENV_STATES = ["set", "empty", "placeholder", "unset", "missing"]


def names(schema: str) -> list[str]:
    depth, out, field = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(field.split()[0])
            field = ""
        else:
            field += c
    return out
