"""Files to symbols and call edges, in parallel: one pass over (path, language, content)."""

from __future__ import annotations

import hashlib
import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.parsers.languages import PARSERS
from codeloom.parsers.scan import Found, first_sentence, template
from codeloom.schemas import PARSED, names

COLUMNS = names(PARSED)
KINDS = {"ordinal": pa.int32(), "byte_start": pa.int32(), "byte_end": pa.int32(), "line_start": pa.int32(), "line_end": pa.int32(), "depth": pa.int32(), "secret": pa.bool_()}


def symbol_id(qualified_name: str) -> str:
    return hashlib.sha256(qualified_name.encode()).hexdigest()[:8]


def smallest_around(rows: list[dict], places: list[int]) -> list[int | None]:
    """For each place the smallest of the rows, sorted by ``byte_start``, that holds it, the first of equal ones: one sweep."""
    out: list[int | None] = [None] * len(places)
    heap: list[tuple[int, int]] = []
    at = 0
    for i in sorted(range(len(places)), key=places.__getitem__):
        while at < len(rows) and rows[at]["byte_start"] <= places[i]:
            heappush(heap, (rows[at]["byte_end"] - rows[at]["byte_start"], at))
            at += 1
        while heap and rows[heap[0][1]]["byte_end"] <= places[i]:  # holds none of the places to come
            heappop(heap)
        if heap:
            out[i] = heap[0][1]
    return out


def found_in(language: str, data: bytes) -> Found:
    """What the parser of the language finds; of a source that it gives up on there is but the error."""
    try:
        return PARSERS[language](data)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return Found(error=f"{type(e).__name__}: {e}"[:500])


def parse_file(path: str, language: str, data: bytes, secrets: Sequence[re.Pattern] = ()) -> list[dict]:
    """Rows of :data:`PARSED`: symbols in order, then edges, and an error row for a source of which a part can't be parsed.

    A constant or variable in whose source one of ``secrets`` is found is marked.
    """
    if language not in PARSERS:
        return []
    found = found_in(language, data)
    folder = posixpath.dirname(path)
    lines = [0]
    for line in data.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    symbols = sorted(found.symbols, key=lambda s: (s.start, -s.end))
    rows, stack = [], []
    for k, s in enumerate(symbols):
        while stack and stack[-1][1] <= s.start:
            stack.pop()
        qualified = f"{folder}.{s.receiver + '.' if s.receiver else ''}{s.name}"
        around = [x for x in stack if x[0] < s.start or x[1] > s.end]
        row = {
            "record": "symbol",
            "file": path,
            "ordinal": k,
            "id": symbol_id(qualified),
            "kind": s.kind,
            "name": s.name,
            "qualified_name": qualified,
            "signature": s.signature,
            "summary": first_sentence(s.comment) or template(s.kind, s.name, s.params),
            "byte_start": s.start,
            "byte_end": s.end,
            "line_start": bisect_right(lines, s.start),
            "line_end": bisect_right(lines, max(s.end - 1, s.start)),
            "parent_id": around[-1][2] if around else (symbol_id(f"{folder}.{s.receiver}") if s.receiver else None),
            "depth": len(around),
            "content_hash": hashlib.sha256(data[s.start : s.end]).hexdigest()[:16],
            "secret": s.kind in ("const", "var") and any(p.search(data[s.start : s.end].decode("latin-1")) for p in secrets),
        }
        rows.append(row)
        stack.append((s.start, s.end, row["id"]))
    callers, seen = smallest_around(rows, [at for at, _ in found.calls]), set()
    for (_, raw), k in zip(found.calls, callers, strict=True):
        if k is not None and (rows[k]["id"], raw) not in seen:
            seen.add((rows[k]["id"], raw))
            rows.append({"record": "edge", "file": path, "ordinal": len(rows), "caller_id": rows[k]["id"], "raw_expression": raw, "confidence": "dynamic"})
    if found.error:
        rows.append({"record": "error", "file": path, "error": found.error})
    return rows


def parse_files(files: DataFrame, secret_patterns: Sequence[str] = ()) -> DataFrame:
    """:data:`PARSED` rows of files (path, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secrets = [re.compile(p, re.ASCII) for p in secret_patterns]
        for batch in batches:
            rows = []
            for path, language, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows += parse_file(path, language, data or b"", secrets)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], KINDS.get(c, pa.string())) for c in COLUMNS], names=COLUMNS)

    return _usable(files).mapInArrow(run, PARSED)


def parse_errors(files: DataFrame) -> DataFrame:
    """(file, error): the error rows of :func:`parse_files`. Every file is parsed, but of symbols and edges no rows are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(3))
            rows = [(path, error) for path, language, data in zip(*columns, strict=True) if (error := found_in(language, data or b"").error)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["file", "error"])

    return _usable(files).mapInArrow(run, "file string, error string")


def _usable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language").isin(sorted(PARSERS))).select("path", "language", F.col("content").cast("binary").alias("content"))
