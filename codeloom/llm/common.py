"""What the operators of this subpackage share: column choice, the shared folder, Arrow maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import session

#: A word: a run of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text, as ids may be null or repeat."""
    own = F.coalesce(F.concat(F.lit("+"), doc_id.cast("string")), F.lit("-"))
    whole = F.concat(own, F.lit("\0"), F.coalesce(F.concat(F.lit("+"), text), F.lit("-")))
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def fresh(taken: Sequence[str], name: str) -> str:
    """A column name like ``name`` that isn't taken, whatever the case of its letters."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that driver and executors share (see :func:`codeloom.session.shared_root`)."""
    path = session.shared_folder(spark, purpose)
    for made in _OPEN:
        made.append(path)
    return path


#: The folders made within each block of :func:`passing` that is open.
_OPEN: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Folders that are made within this block are deleted after it: for steps whose result is written elsewhere."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder (smaller than a checkpoint)."""
    return written_to(df, shared_folder(df.sparkSession, purpose))


def written_to(df: DataFrame, folder: str) -> DataFrame:
    """The same rows as a table in this folder."""
    df.write.parquet(f"{folder}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
