"""A log of immutable segments: tables whose changes cost what changed, not what is there.

A change of a table is a segment of new rows and a set of keys whose older rows no longer count. Both are Parquet folders
that are never written again. A manifest is a small text that names the segments and key sets of all tables, with the
number of the change they came with, their rows and the range of their keys; manifests are numbered, and the last one is the
present state. A row counts unless its key is in a set of a later number. Sets whose range doesn't meet that of a segment
aren't looked at for it, and a segment that none concerns is read as it is.

Manifests are committed by creating the next number, which only one writer can do; the other gets :class:`ConflictError`
and starts again from the state that it lost to. Segments are merged by size, ``FANOUT`` of about one size becoming one of
the next, so that a row is written again a few times at most as the table grows; key sets go when no older rows are left.
What the last ``KEEP`` manifests name stays for readers that have opened it.

Exclusive creation is a rename that doesn't overwrite, which HDFS and local file systems do at once; on a store where it isn't
one step, two writers at the very same moment need a lock of their own.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.storage import HadoopStorage, LocalStorage

#: Segments of about one size that are merged.
FANOUT = 4
#: Key sets of a table that are kept before the segments they concern are written without the rows they name.
SETS = 8
#: Manifests, and what they name, that are kept.
KEEP = 4


class ConflictError(RuntimeError):
    """Another writer has committed first."""


@dataclass(frozen=True)
class Table:
    """How a table is kept: its schema, the key that changes name (an expression), and what its files are sorted by. Rows are dealt to
    files by ranges of that, which computes them twice, or by the hash of the expressions ``dealt_by``."""

    schema: str
    key: str
    sorted_by: str
    dealt_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Segment:
    """A folder of rows, or of keys."""

    folder: str
    number: int
    rows: int
    low: str | None
    high: str | None

    def meets(self, other: Segment) -> bool:
        """Whether the ranges of keys overlap; null keys aren't in a range."""
        if None in (self.low, self.high, other.low, other.high):
            return True
        return self.low <= other.high and other.low <= self.high


@dataclass
class Manifest:
    """The segments and key sets of each table, as of one number."""

    number: int = 0
    segments: dict[str, list[Segment]] = field(default_factory=dict)
    gone: dict[str, list[Segment]] = field(default_factory=dict)

    def text(self) -> str:
        kinds = {"segments": self.segments, "gone": self.gone}
        return json.dumps({"number": self.number} | {k: {t: [vars(s) for s in found] for t, found in v.items()} for k, v in kinds.items()}, indent=1)

    @classmethod
    def parse(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls(found["number"], *({t: [Segment(**s) for s in v] for t, v in found[k].items()} for k in ("segments", "gone")))

    def folders(self) -> set[str]:
        return {s.folder for kind in (self.segments, self.gone) for found in kind.values() for s in found}


@dataclass
class Change:
    """New rows of a table, and the keys (one column) whose older rows go."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Log:
    """Tables below a folder of a storage."""

    def __init__(self, spark: SparkSession, at: LocalStorage | HadoopStorage, base: str, tables: dict[str, Table]) -> None:
        self.spark, self.storage, self.base, self.tables = spark, at, base, tables

    def _manifest(self, number: int) -> str:
        return f"{self.base}/manifests/{number:012d}.json"

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.storage.children(f"{self.base}/manifests") if n.removesuffix(".json").isdigit())

    def current(self) -> Manifest:
        numbers = self.numbers()
        return Manifest.parse(self.storage.read_text(self._manifest(numbers[-1]))) if numbers else Manifest()

    # --- reading

    def _parquet(self, schema: str, segments: Sequence[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.storage.url(f"{self.base}/{s.folder}") for s in segments))

    def _numbered(self, schema: str, segments: Sequence[Segment]) -> DataFrame:
        by_number: dict[int, list[Segment]] = {}
        for s in segments:
            by_number.setdefault(s.number, []).append(s)
        frames = [self._parquet(schema, own).withColumn("number_", F.lit(n).cast("bigint")) for n, own in sorted(by_number.items())]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def read(self, table: str, manifest: Manifest | None = None, segments: Sequence[Segment] | None = None) -> DataFrame:
        """The rows that count, of all segments or of these."""
        manifest, own = manifest or self.current(), self.tables[table]
        segments = manifest.segments.get(table, []) if segments is None else segments
        sets = manifest.gone.get(table, [])
        concerned = [s for s in segments if any(g.number > s.number and g.meets(s) for g in sets)]
        whole = self._parquet(own.schema, [s for s in segments if s not in concerned])
        if not concerned:
            return whole
        used = [g for g in sets if any(g.number > s.number and g.meets(s) for s in concerned)]
        gone = self._numbered("key_ string", used).withColumnRenamed("number_", "gone_")
        rows = self._numbered(own.schema, concerned)
        kept = rows.join(gone, F.expr(own.key).eqNullSafe(F.col("key_")) & (F.col("gone_") > F.col("number_")), "left_anti").drop("number_")
        return kept if len(concerned) == len(segments) else whole.unionByName(kept)

    # --- writing

    def _written(self, df: DataFrame, table: str, kind: str, number: int, key: Column) -> Segment | None:
        """A new folder with these rows; None, and no folder, if there are none."""
        seen, folder = Observation(), f"{kind}/{table}/{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("named")).write.parquet(self.storage.url(f"{self.base}/{folder}"))
        found = seen.get
        if not found["rows"]:
            self.storage.delete(f"{self.base}/{folder}")
            return None
        ranged = found["named"] == found["rows"]
        return Segment(folder, number, found["rows"], found["low"] if ranged else None, found["high"] if ranged else None)

    def _rows(self, df: DataFrame, table: str, number: int) -> Segment | None:
        own = self.tables[table]
        names = self.spark.createDataFrame([], own.schema).columns
        rows = df.select(names)
        dealt = rows.repartition(*map(F.expr, own.dealt_by)) if own.dealt_by else rows.repartitionByRange(F.col(own.sorted_by))
        return self._written(dealt.sortWithinPartitions(own.sorted_by), table, "segments", number, F.expr(own.key))

    def stage(self, base: Manifest, changes: dict[str, Change]) -> Manifest:
        """``base`` with these changes; their folders are written, the manifest isn't."""
        out = Manifest(base.number + 1, {t: list(s) for t, s in base.segments.items()}, {t: list(s) for t, s in base.gone.items()})
        for table, change in changes.items():
            older = out.segments.setdefault(table, [])
            if change.gone is not None and older:
                keys = change.gone.toDF("key_").select(F.col("key_").cast("string")).distinct()
                if (gone := self._written(keys, table, "gone", out.number, F.col("key_"))) and any(gone.meets(s) for s in older):
                    out.gone.setdefault(table, []).append(gone)
            if change.rows is not None and (added := self._rows(change.rows, table, out.number)):
                older.append(added)
        return out

    def commit(self, manifest: Manifest) -> Manifest:
        """Makes it the present state, if it is the next one."""
        self.storage.make(f"{self.base}/manifests")
        numbers = self.numbers()
        if (numbers[-1] if numbers else 0) >= manifest.number or not self.storage.create_text(self._manifest(manifest.number), manifest.text()):
            raise ConflictError(f"number {manifest.number} was committed by another writer")
        self._forget(manifest)
        return manifest

    def _forget(self, manifest: Manifest) -> None:
        """Old manifests, and the folders that only they name; a folder that no manifest has named yet is another writer's."""
        numbers = [n for n in self.numbers() if n <= manifest.number]
        old, kept = numbers[:-KEEP], numbers[-KEEP:]
        if not old:
            return
        load = lambda n: Manifest.parse(self.storage.read_text(self._manifest(n)))
        needed = set().union(*(load(n).folders() for n in kept))
        for n in old:
            try:
                for folder in load(n).folders() - needed:
                    self.storage.delete(f"{self.base}/{folder}")
                self.storage.delete(self._manifest(n))
            except OSError:  # another writer has forgotten it already
                continue

    # --- merging

    def to_merge(self, manifest: Manifest, table: str) -> list[Segment]:
        """Segments to write as one: ``FANOUT`` of about one size, or those that too many key sets concern."""
        segments, sets = manifest.segments.get(table, []), manifest.gone.get(table, [])
        if len(sets) >= SETS:
            return [s for s in segments if any(g.number > s.number and g.meets(s) for g in sets)]
        tiers: dict[int, list[Segment]] = {}
        for s in segments:
            tiers.setdefault(int(math.log(max(s.rows, 1), FANOUT)), []).append(s)
        return next((found for _, found in sorted(tiers.items()) if len(found) >= FANOUT), [])

    def compact(self) -> Manifest:
        """Merges what is due and commits it; if another writer comes first, nothing is changed."""
        base = self.current()
        out, merged = Manifest(base.number + 1, dict(base.segments), dict(base.gone)), False
        for table in self.tables:
            if found := self.to_merge(base, table):
                merged = True
                new = self._rows(self.read(table, base, found), table, out.number)
                out.segments[table] = [s for s in base.segments[table] if s not in found] + ([new] if new else [])
            left = out.segments.get(table, [])
            sets = [g for g in base.gone.get(table, []) if any(g.number > s.number and g.meets(s) for s in left)]
            merged |= len(sets) < len(base.gone.get(table, []))
            out.gone[table] = sets
        if not merged:
            return base
        try:
            return self.commit(out)
        except ConflictError:
            for folder in out.folders() - base.folders():
                self.storage.delete(f"{self.base}/{folder}")
            return self.current()
