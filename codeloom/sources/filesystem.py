"""Files of a folder: listed with ignore rules on the driver, read on the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths

IGNORE_FILES = (".gitignore", ".loomignore")
LISTING = "path string, mtime string, size long"


def read_lines(path: str) -> list[str]:
    """Lines of an ignore file, right-trimmed; none if there is no such file."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return [line.rstrip(" \t\r\n") for line in f]
    except OSError:
        return []


def load_rules(root: str, folder: str, names: Sequence[str] = IGNORE_FILES) -> list[paths.IgnoreRule]:
    lines = [line for name in names for line in read_lines(os.path.join(root, folder, name))]
    return paths.ignore_rules(lines, folder)


def _excluded(path: str, extra: Sequence[str]) -> bool:
    import re

    name, parts = path.rsplit("/", 1)[-1], path.split("/")
    return any(p[:-1] in parts if p.endswith("/") else re.match(paths.glob_regex(p), name) for p in [*paths.EXCLUSIONS, *extra])


def _ignored(path: str, rules: Sequence[paths.IgnoreRule], is_dir: bool) -> bool:
    import re

    out = False
    for r in rules:
        own = path[len(r.directory) + 1 :] if r.directory else path
        if r.directory and not path.startswith(r.directory + "/") or r.dir_only and not is_dir:
            continue
        if re.search(r.regex, own):
            out = not r.negate
    return out


def walk(root: str, extra: Sequence[str] = (), names: Sequence[str] = IGNORE_FILES) -> Iterator[tuple[str, str, int]]:
    """(path, mtime, size) of the files that are neither excluded nor ignored; excluded folders aren't entered."""
    rules: dict[str, list[paths.IgnoreRule]] = {}
    for folder, dirs, found in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        rules[rel] = [*(rules[rel.rpartition("/")[0]] if rel else []), *load_rules(root, rel, names)]
        under = lambda n: f"{rel}/{n}" if rel else n  # noqa: B023, E731
        dirs[:] = sorted(d for d in dirs if not _excluded(under(d), extra) and not _ignored(under(d), rules[rel], True))
        for name in sorted(found):
            if _excluded(under(name), extra) or _ignored(under(name), rules[rel], False):
                continue
            try:
                info = os.stat(os.path.join(folder, name))
            except OSError:
                continue
            yield under(name), datetime.fromtimestamp(int(info.st_mtime), UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), info.st_size


def listing(spark: SparkSession, root: str, extra: Sequence[str] = (), names: Sequence[str] = IGNORE_FILES) -> DataFrame:
    return spark.createDataFrame(list(walk(root, extra, names)), LISTING)


def contents(files: DataFrame, root: str, max_bytes: int | None = None) -> DataFrame:
    """``files`` (column path) with ``content``, read where the task runs; null if unreadable, too large or outside the root.

    The folder must be seen by all executors. Spark's own reader for binary files would leave out names that begin with
    a dot or an underscore.
    """
    base = os.path.realpath(root)
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                full = os.path.realpath(os.path.join(base, path))
                try:
                    if not full.startswith(base + os.sep) or max_bytes is not None and os.path.getsize(full) > max_bytes:
                        out.append(None)
                        continue
                    with open(full, "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "content"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields), "content binary"])
    return files.mapInArrow(run, schema)


def store_contents(spark: SparkSession, url: str) -> DataFrame:
    """(path, mtime, size, content) below a URL that only Spark reads. Names with a leading dot or underscore are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    relative = F.when(F.locate(url.rstrip("/") + "/", "path") > 0, F.substring_index("path", url.rstrip("/") + "/", -1)).otherwise(F.col("path"))
    return raw.select(relative.alias("path"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime"), F.col("length").alias("size"), "content")


def env_lines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(path, exists) of the environment files looked for, and (file_rank, line_no, line) of those that exist."""
    from codeloom.functions.env import CANDIDATES

    found, rows = [], []
    for rank, name in enumerate(CANDIDATES):
        full = os.path.join(root, name)
        found.append((name, os.path.isfile(full)))
        if found[-1][1]:
            rows += [(rank, k, line) for k, line in enumerate(read_lines(full))]
    return spark.createDataFrame(found, "path string, exists boolean"), spark.createDataFrame(rows, "file_rank int, line_no int, line string")
