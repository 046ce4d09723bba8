"""Where snapshots are kept: a folder of this machine, or any file system that Spark knows, by one set of operations.

Names are relative to the root. A text is replaced as a whole by a rename, so that readers see the old or the new one.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


class LocalStorage:
    """A folder of this machine; good for a cluster only if all its machines see it under this path."""

    def __init__(self, root: str) -> None:
        self.root = Path(root.removeprefix("file://"))

    def url(self, name: str = "") -> str:
        return f"file://{os.path.abspath(self.root / name)}"

    def exists(self, name: str) -> bool:
        return (self.root / name).exists()

    def make(self, name: str) -> None:
        (self.root / name).mkdir(mode=0o700, parents=True, exist_ok=True)

    def read_text(self, name: str) -> str:
        return (self.root / name).read_text()

    def write_text(self, name: str, text: str) -> None:
        fd, temporary = tempfile.mkstemp(dir=(self.root / name).parent)
        with os.fdopen(fd, "w") as f:
            f.write(text)
        os.replace(temporary, self.root / name)

    def create_text(self, name: str, text: str) -> bool:
        """A new text, whole at once; False if the name is taken."""
        fd, temporary = tempfile.mkstemp(dir=(self.root / name).parent)
        with os.fdopen(fd, "w") as f:
            f.write(text)
        try:
            os.link(temporary, self.root / name)
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
        return True

    def delete(self, name: str) -> None:
        if (self.root / name).is_file():
            (self.root / name).unlink(missing_ok=True)
        else:
            shutil.rmtree(self.root / name, ignore_errors=True)

    def children(self, name: str) -> list[str]:
        return sorted(p.name for p in (self.root / name).iterdir()) if self.exists(name) else []

    def size(self, name: str) -> int:
        """Bytes of all files below."""
        return sum(p.stat().st_size for p in (self.root / name).rglob("*") if p.is_file()) if self.exists(name) else 0

    def modified(self, name: str) -> float:
        return (self.root / name).stat().st_mtime


class HadoopStorage:
    """A folder of any file system that Spark is set up for, as ``hdfs://...`` or ``s3a://...``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, context = root.rstrip("/"), spark.sparkContext
        self.jvm, self.gateway, self.conf = context._jvm, context._gateway, context._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def url(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.url(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _renamed(self, name: str, text: str, overwrite: bool) -> None:
        temporary = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(temporary))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if overwrite else kind.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf).rename(self._path(temporary), self._path(name), how)
        except Exception:
            self.fs.delete(self._path(temporary), False)
            raise

    def write_text(self, name: str, text: str) -> None:
        self._renamed(name, text, True)

    def create_text(self, name: str, text: str) -> bool:
        """A new text, by a rename that doesn't overwrite; False if the name is taken."""
        try:
            self._renamed(name, text, False)
        except Exception:
            if self.exists(name):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def children(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return int(self.fs.getContentSummary(self._path(name)).getLength()) if self.exists(name) else 0

    def modified(self, name: str) -> float:
        return self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file://")


def storage(root: str, spark: SparkSession | None = None) -> LocalStorage | HadoopStorage:
    """The storage at a path or URL; one that isn't local needs a session."""
    if is_local(root):
        return LocalStorage(root)
    if spark is None and (spark := SparkSession.getActiveSession()) is None:
        raise ValueError(f"{root} needs a Spark session")
    return HadoopStorage(spark, root)
