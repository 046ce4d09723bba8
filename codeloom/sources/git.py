"""Files of a git work tree: what git lists, parsed in the engine."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run(root: str, *args: str) -> str:
    """Output of git; an error of git is raised."""
    return subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *args], check=True, capture_output=True, text=True).stdout


def version() -> tuple[int, int] | None:
    """Null if there is no git."""
    try:
        said = subprocess.run(["git", "--version"], check=True, capture_output=True, text=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None
    m = re.search(r"(\d+)\.(\d+)", said)
    return (int(m[1]), int(m[2])) if m else None


def root_of(path: str) -> str | None:
    try:
        return run(path, "rev-parse", "--show-toplevel").strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def head(root: str) -> str | None:
    try:
        return run(root, "rev-parse", "HEAD").strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def reachable(root: str, commit: str) -> bool:
    """Whether the commit is an ancestor of the head, or the head."""
    if not commit or commit.startswith("-"):
        return False
    return subprocess.run(["git", "-C", root, "merge-base", "--is-ancestor", commit, "HEAD"], capture_output=True).returncode == 0


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in text.split("\n") if line], "value string")


def parse_format(lines: DataFrame) -> DataFrame:
    """(path, blob_sha) of lines ``sha path``, split at the first space."""
    parts = F.split("value", " ", 2)
    return lines.filter(F.size(parts) == 2).select(F.element_at(parts, 2).alias("path"), F.element_at(parts, 1).alias("blob_sha"))


def parse_stage(lines: DataFrame) -> DataFrame:
    """(path, blob_sha) of lines ``mode sha stage<tab>path``."""
    head_, path = F.substring_index("value", "\t", 1), F.regexp_extract("value", r"^[^\t]*\t(.*)$", 1)
    fields = F.split(head_, " ")
    return lines.filter(F.col("value").contains("\t") & (F.size(fields) >= 2)).select(path.alias("path"), F.element_at(fields, 2).alias("blob_sha")).dropDuplicates(["path"])


def parse_untracked(lines: DataFrame) -> DataFrame:
    """(path, blob_sha) of lines that are paths; git has no hash for them."""
    return lines.filter(F.col("value") != "").select(F.col("value").alias("path"), F.lit(None).cast("string").alias("blob_sha"))


def merged(known: DataFrame, others: DataFrame) -> DataFrame:
    """(path, blob_sha, untracked) of both lists."""
    return known.withColumn("untracked", F.lit(False)).unionByName(others.withColumn("untracked", F.lit(True)))


def tracked(spark: SparkSession, root: str) -> DataFrame:
    if (version() or (0, 0)) >= (2, 38):
        return parse_format(_lines(spark, run(root, "ls-files", "--format=%(objectname) %(path)")))
    return parse_stage(_lines(spark, run(root, "ls-files", "--stage")))


def untracked(spark: SparkSession, root: str) -> DataFrame:
    """Files that git doesn't know and doesn't ignore; none if git can't tell."""
    try:
        said = run(root, "ls-files", "--others", "--exclude-standard")
    except (OSError, subprocess.CalledProcessError):
        said = ""
    return parse_untracked(_lines(spark, said))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, blob_sha, untracked)."""
    return merged(tracked(spark, root), untracked(spark, root))


def name_status(spark: SparkSession, root: str, since: str) -> DataFrame:
    """Lines of status and paths since a revision; an unknown revision is an error."""
    if since.startswith("-"):
        raise ValueError(f"not a revision: {since!r}")
    return _lines(spark, run(root, "diff", "--name-status", since))


def staged(root: str) -> list[str]:
    return [x for x in run(root, "diff", "--cached", "--name-only").split("\n") if x]
