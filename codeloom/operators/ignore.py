"""Ignore rules as a relation: any number of rules, from any number of directories, in one plan.

A rule concerns the paths below its directory, and the last one that fits decides: the deepest directory first, then the
order in its files. Rules aren't tried on all paths. Each has a key that every path has which it can fit: the literal
beginning of an anchored pattern, a literal name, or the extension that a pattern ends with; paths meet the rules of the
directories above them by such keys in an equi-join, and only those pairs are tried. A pattern without a literal part
(``*~``, ``tmp?``) has none of these and meets all paths below its directory: there is no way but to try it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths

RULES = "directory string, ordinal int, regex string, negate boolean, dir_only boolean, kind string, key string"
_GLOB = re.compile(r"[*?\[\]]")


def rule_key(line: str) -> tuple[str, str]:
    """(kind, key) of a pattern, its ``!`` and its last ``/`` taken off: what each path has that it fits."""
    last = line.rpartition("/")[2]
    if not _GLOB.search(line):
        return ("path", line.removeprefix("/")) if "/" in line else ("name", line)
    if "/" in line:
        lead = []
        for part in line.removeprefix("/").split("/"):
            if _GLOB.search(part):
                break
            lead.append(part)
        if lead:
            return "path", "/".join(lead)
    if not _GLOB.search(last):
        return "name", last
    tail = re.split(_GLOB, last)[-1]
    return ("extension", "." + tail.rpartition(".")[2]) if "." in tail else ("any", "")


def _rows(lines: Iterable[tuple[str | None, int, str | None]]) -> list[tuple]:
    found = (paths.parse_ignore_line(line or "", directory or "", ordinal) for directory, ordinal, line in lines)
    return [(r.directory, r.ordinal, r.regex, r.negate, r.dir_only, *rule_key(r.pattern)) for r in found if r]


def rules_table(spark: SparkSession, lines: Iterable[tuple[str, int, str]]) -> DataFrame:
    """:data:`RULES` of lines (directory, ordinal, line) of ignore files; blanks, comments and broken patterns give none."""
    return spark.createDataFrame(_rows(lines), RULES)


def parse_rules(lines: DataFrame) -> DataFrame:
    """:func:`rules_table` for a table of lines (directory, ordinal, line): read from many ignore files by the executors."""
    columns = [c.split(" ")[0] for c in RULES.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = _rows(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=columns)

    return lines.select("directory", F.col("ordinal").cast("int"), "line").mapInArrow(run, RULES)


def decided(files: DataFrame, rules: DataFrame, path: str = "path", is_dir: str | None = None) -> DataFrame:
    """(path, ignored) of the distinct paths that some rule fits; the others aren't ignored.

    ``is_dir`` names a boolean column: a rule for directories fits a directory itself, of a file only those above it. A null
    path fits nothing.
    """
    rules = rules.withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/"))))
    folder = F.coalesce(F.col(is_dir), F.lit(False)) if is_dir else F.lit(False)
    rows = files.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), folder.alias("is_dir")).distinct()
    below = rows.withColumn("directory", F.explode(paths.ancestors(F.col("path"))))
    below = below.join(rules.select("directory").distinct(), "directory", "left_semi")
    below = below.withColumn("own", F.when(F.col("directory") == "", F.col("path")).otherwise(F.substr("path", F.length("directory") + 2)))
    parts = F.split("own", "/")
    dotted = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"(\.[^.]*)$", 1)), lambda e: e != "")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    keys = lambda kind, found: F.transform(F.array_distinct(found), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    all_keys = F.concat(keys("path", leads), keys("name", parts), keys("extension", dotted), F.array(F.struct(F.lit("any").alias("kind"), F.lit("").alias("key"))))
    asked = below.select("path", "is_dir", "directory", "own", F.explode(all_keys).alias("k")).select("path", "is_dir", "directory", "own", "k.kind", "k.key")
    met = asked.join(rules, ["directory", "kind", "key"])
    # a pattern fits what lies below a directory that it fits, so of the directories above a file the nearest is enough
    tried = F.when(F.col("dir_only") & ~F.col("is_dir"), F.when(F.col("own").contains("/"), F.regexp_replace("own", r"/[^/]*$", ""))).otherwise(F.col("own"))
    fits = met.filter(F.rlike(tried, F.col("regex")))
    last = fits.groupBy("path", "is_dir").agg(F.max_by("negate", F.struct("depth", "ordinal")).alias("negate"))
    return last.select("path", "is_dir", (~F.col("negate")).alias("ignored"))


def with_ignored(files: DataFrame, rules: DataFrame, path: str = "path", is_dir: str | None = None) -> DataFrame:
    """Adds ``ignored`` to all rows of ``files``."""
    own = decided(files, rules, path, is_dir).select(F.col("path").alias("path_"), F.col("is_dir").alias("is_dir_"), "ignored")
    folder = F.coalesce(F.col(is_dir), F.lit(False)) if is_dir else F.lit(False)
    joined = files.withColumn("folder_", folder).join(own, (F.col(path) == F.col("path_")) & (F.col("folder_") == F.col("is_dir_")), "left")
    return joined.withColumn("ignored", F.coalesce("ignored", F.lit(False))).drop("path_", "is_dir_", "folder_")
