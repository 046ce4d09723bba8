"""Suffix-array dedup: every byte covered by a long string that also starts elsewhere in the corpus is removed.

1. Every string of ``length`` bytes has one anchor, its least ``GRAM``-byte piece by hash, the first of equal ones. Strings
   that are equal have equal anchors, so only starts that share an anchor can match. Each anchor stands for a run of
   starts; its block is the text of those strings.
2. Blocks meet by anchor. Blocks that occur once more as a whole (by 128 bits of SHA-256) are repeated in full, and one of
   them stands for all. An anchor with but one distinct block needs nothing more.
3. The distinct blocks of the other anchors are dealt by anchor to shards of bounded size. Each shard gets its suffix array
   and common prefixes; the shards of an anchor that fills more than one are merged by binary search.

An anchor with more than ``HOT`` distinct blocks (the edge of a passage that very many texts share) would be too much for
one task. The strings of its distinct blocks are dealt one by one instead, by the same digest of the whole string. Which
anchors these are is a table like all else; nothing is collected.

Equal blocks are reduced within each batch before the shuffle, so a passage shared by a third of all rows sends one row a
batch. Texts travel once by row, and only blocks in doubt travel by anchor.

Rows are told apart by 128 bits (id, th) of their id and text.

Defined cases: null or empty text has no bytes and loses none; rows repeated in full are copies of each other; texts of any
length are cut into segments of starts, which changes no result; other columns may be kept. Where a removal splits a
character, ``kept_text`` drops the odd bytes (``kept_sha256`` is of the exact bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, row_key, table, written
from codeloom.llm.rolling import Sums, mixed
from codeloom.llm.suffixarray import Merged, Shard

LENGTH = 200
GRAM = 40
#: Starts in a segment; places in it must fit in 24 bits.
SEGMENT = 1 << 22
#: Bytes of text in a shard.
SHARD = 1 << 20
#: Distinct blocks of an anchor that one task takes.
HOT = 8192
_PLACE = np.uint64((1 << 24) - 1)


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of each anchor; the text has one segment at most."""
    hashes = Sums(text).windows(gram)
    least, width, wanted = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), 1, length - gram + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := wanted - width:
        least = np.minimum(least[:-rest], least[rest:])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    return hashes[(least[first] & _PLACE).astype(np.int64)].view(np.int64), first, last


def digests(parts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first 128 bits of SHA-256 of each."""
    sha = hashlib.sha256
    both = np.frombuffer(b"".join([sha(p).digest()[:16] for p in parts]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def blocks(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, digest of the block in two halves, first start, last start) by segments."""
    for at in range(0, len(text) - length + 1, SEGMENT):
        part = text[at : at + SEGMENT + length - 1]
        hashes, first, last = anchors(part, length, gram)
        yield hashes, *digests(part[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)), first + at, last + at


SPAN, BLOCK = 0, 1
_BLOCKS = "kind int, anchor long, d1 long, d2 long, id long, th long, a int, b int"


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def joined_spans(cols: list[np.ndarray]) -> list[np.ndarray]:
    """(id, th, a, b) with adjacent and overlapping runs of one text as one."""
    order = np.lexsort((cols[2], cols[1], cols[0]))
    i, th, a, b = (c[order] for c in cols)
    if not len(i):
        return [i, th, a, b]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (th[1:] != th[:-1]) | (a[1:] > b[:-1] + 1)])
    at = np.flatnonzero(new)
    return [i[at], th[at], a[at], np.maximum.reduceat(b, at)]


class Found:
    """Blocks of a batch, equal ones combined: one row of kind BLOCK each, and rows of kind SPAN for those found twice."""

    def __init__(self) -> None:
        self.rows: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
        self.size = 0

    def add(self, i: int, th: int, part: tuple[np.ndarray, ...]) -> None:
        anchor, d1, d2, a, b = part
        for to, x in zip(self.rows, (anchor, d1, d2, np.full(len(a), i), np.full(len(a), th), a, b), strict=True):
            to.append(x)
        self.size += len(a)

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        cols = [np.concatenate(x) for x in self.rows]
        self.__init__()
        order = np.lexsort((cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        same = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:3]])
        first = np.concatenate([[True], ~same])
        twice = ~first
        twice[:-1] |= same
        at = np.flatnonzero(first)
        yield _batch([np.full(len(at), BLOCK), *(c[at] for c in cols)])
        spans = joined_spans([c[twice] for c in cols[3:]])
        if len(spans[0]):  # dealt by document, as their anchors may be one and the same
            none = np.zeros(len(spans[0]), np.int64)
            yield _batch([np.full(len(none), SPAN), mixed(spans[0].view(np.uint64)).view(np.int64), none, none, *spans])


def find_blocks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of kind BLOCK to meet by anchor; rows of kind SPAN are blocks found twice in one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = Found(), 0
            for i, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                for part in blocks(data, length, gram):
                    found.add(i, th, part)
                size += len(data)
                if size > 32 << 20:
                    yield from found.take()
                    size = 0
            yield from found.take()

    return docs.select("id", "th", "text").mapInArrow(run, _BLOCKS)


def find_strings(cut: DataFrame, length: int) -> DataFrame:
    """The same for every single string of blocks (anchor, id, th, a, block): dealt by their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        for batch in batches:
            for _, i, th, a, block in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                n = len(block) - length + 1
                d1, d2 = digests(block[k : k + length] for k in range(n))
                found.add(i, th, (d1, d1, d2, np.arange(a, a + n), np.arange(a, a + n)))
                if found.size > 1 << 18:
                    yield from found.take()
        yield from found.take()

    return cut.mapInArrow(run, _BLOCKS)


def meet(found: DataFrame) -> DataFrame:
    """Spans that are repeated, and blocks in doubt: one for each distinct block of an anchor that has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: list | None = None  # the last row, whose successor isn't known yet
        row_equal = False
        waiting: list | None = None  # the first row of the last block, if it isn't handed over
        waiting_anchor = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(8)]
            spans = cols[0] == SPAN
            if spans.any():
                yield _batch([c[spans] for c in cols])
                cols = [c[~spans] for c in cols]
                if not len(cols[0]):
                    continue
            if row is not None:
                cols = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(row, cols, strict=True)]
            n = len(cols[0])
            equal = np.zeros(n, bool)
            equal[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[1:4]])
            equal[0] = row is not None and row_equal
            twice = equal[:-1] | equal[1:]
            at = np.flatnonzero(twice)
            if len(at):
                yield _batch([np.full(len(at), SPAN), *(c[at] for c in cols[1:])])
            firsts = np.flatnonzero(~equal)
            if row is not None:
                firsts = firsts[firsts > 0]
            if len(firsts):
                anchor = cols[1][firsts]
                before = np.concatenate([[waiting_anchor is not None and waiting_anchor == anchor[0]], anchor[1:] == anchor[:-1]])
                if before[0] and waiting is not None:
                    yield _batch([np.array([x]) for x in waiting])
                give = before.copy()
                give[:-1] |= before[1:]
                out = firsts[give]
                if len(out):
                    yield _batch([np.full(len(out), BLOCK), *(c[out] for c in cols[1:])])
                waiting_anchor = anchor[-1]
                waiting = None if give[-1] else [c[firsts[-1]] for c in cols]
            row, row_equal = [c[-1] for c in cols], bool(equal[-1])
        if row is not None and row_equal:
            yield _batch([np.array([SPAN]), *(np.array([x]) for x in row[1:])])

    return found.repartition("anchor").sortWithinPartitions("kind", "anchor", "d1", "d2").mapInArrow(run, _BLOCKS)


def cut_blocks(docs: DataFrame, doubt: DataFrame, length: int) -> DataFrame:
    """The text of the blocks in doubt: (anchor, id, th, a, block)."""
    wanted = doubt.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "a", "b")).alias("wanted"))
    schema = "anchor long, id long, th long, a int, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            size = 0
            for i, th, text, want in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = (text or "").encode()
                for w in want:
                    block = data[w["a"] : w["b"] + length]
                    for to, x in zip(rows, (w["anchor"], i, th, w["a"], block), strict=True):
                        to.append(x)
                    size += len(block)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)
                    rows, size = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    names, kinds = ["anchor", "id", "th", "a", "block"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return docs.select("id", "th", "text").join(wanted, ["id", "th"]).select("id", "th", "text", "wanted").mapInArrow(run, schema)


def shard_spans(cut: DataFrame, length: int, shard: int) -> DataFrame:
    """(id, th, a, b) of the repeated starts among blocks that share an anchor."""

    def spans(rows: list[tuple], merged: Merged | None, before: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (id, th, a, block); before: those of the anchor's earlier shards, in the order of ``merged``."""
        array = Shard([r[3] for r in rows])
        hit, distinct = array.repeated(length)
        yield from emit(rows, hit)
        if merged is not None:
            met, old = merged.add(array.data, distinct)
            yield from emit(rows, distinct[met])
            yield from emit(before, old)

    def emit(rows: list[tuple], places: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(places):
            return
        stops = np.cumsum([len(r[3]) for r in rows])
        places = np.sort(places)
        own = np.searchsorted(stops, places, side="right")
        start = places - np.concatenate([[0], stops[:-1]])[own]
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)])
        at = np.flatnonzero(first)
        last = np.concatenate([at[1:], [len(start)]]) - 1
        r = [rows[k] for k in own[at].tolist()]
        base = np.array([x[2] for x in r])
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in r], pa.int64()), pa.array([x[1] for x in r], pa.int64()), pa.array(base + start[at], pa.int32()), pa.array(base + start[last], pa.int32())],
            names=["id", "th", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # whole anchors, but for the last
        anchor, begin, size, own = None, 0, 0, 0  # of the last anchor: where it begins in rows, its bytes
        merged: Merged | None = None
        before: list[tuple] = []
        for batch in batches:
            for h, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if h != anchor:
                    if merged is not None:  # the end of an anchor that filled more than one shard
                        yield from spans(rows, merged, before)
                        rows, size, merged, before = [], 0, None, []
                    elif size >= shard:
                        yield from spans(rows, None, [])
                        rows, size = [], 0
                    anchor, begin, own = h, len(rows), 0
                elif own >= shard:
                    if merged is None:
                        if begin:
                            yield from spans(rows[:begin], None, [])
                        rows, merged = rows[begin:], Merged(length)
                    yield from spans(rows, merged, before)
                    before = before + rows
                    rows, size, own, begin = [], 0, 0, 0
                rows.append(tuple(row))
                size += len(row[3])
                own += len(row[3])
        if rows:
            yield from spans(rows, merged, before)

    return cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "id long, th long, a int, b int")


def half(key: Column, at: int) -> Column:
    """64 bits of a hexadecimal key."""
    high, low = (F.conv(F.substring(key, at + k, 8), 16, 10).cast("bigint") for k in (0, 8))
    return F.shiftleft(high, 32).bitwiseOR(low)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def remove_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT, with_text: bool = False
) -> DataFrame:
    """The columns ``keep`` and those of :data:`RESULT`; ``kept_text`` is filled if ``with_text``."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), RESULT])
    own = F.struct(F.lit(None).cast("string").alias(fresh(keep, "none")), *(df[c] for c in keep if c != text)).alias("own_")
    key = F.hex(row_key(df[doc_id], df[text]))
    docs = df.select(half(key, 1).alias("id"), half(key, 17).alias("th"), df[text].alias("text"), own)

    found = written(meet(find_blocks(docs, length, gram)), "blocks")
    doubt = found.filter(F.col("kind") == BLOCK)
    spans = found.filter(F.col("kind") == SPAN).select("id", "th", "a", "b")
    many = written(doubt.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "hot-anchors")
    if not many.isEmpty():
        strings = find_strings(cut_blocks(docs, doubt.join(many, "anchor", "left_semi"), length), length)
        spans = spans.unionByName(meet(strings).filter(F.col("kind") == SPAN).select("id", "th", "a", "b"))
        doubt = doubt.join(many, "anchor", "left_anti")
    spans = spans.unionByName(shard_spans(cut_blocks(docs, doubt, length), length, shard))
    removed = spans.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, rows = batch.column("text").to_pylist(), batch.column("spans").to_pylist(), []
            for t, s in zip(texts, spans, strict=True):
                rows.append(_cut(t, s, length, with_text))
            struct = batch.column("own_")
            columns = [batch.column("text") if c == text else struct.field(c) for c in keep]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns += [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return docs.join(removed, ["id", "th"], "left").select("text", "own_", "spans").mapInArrow(run, schema)


def _cut(text: str | None, spans: list[dict] | None, length: int, with_text: bool) -> tuple:
    data = (text or "").encode()
    if not spans:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), text if with_text else None
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.fromiter((s["a"] for s in spans), np.int64, len(spans)), 1)
    np.add.at(edge, np.fromiter((s["b"] + length for s in spans), np.int64, len(spans)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep=["doc_id"]).drop("kept_text")


#: Documents are told apart by a row number, as their ids may repeat.
OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), s AS (
  SELECT r, unnest(range(1, octet_length(b) - 198)) AS i, unnest(list_transform(range(1, octet_length(b) - 198), lambda i: md5(b[i:i + 199]))) AS h FROM d
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1
), islands AS (
  SELECT r, i, sum(CASE WHEN i > before + 200 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again)
), spans AS (
  SELECT r, min(i) AS a, max(i) + 199 AS z FROM islands GROUP BY r, k
), gone AS (
  SELECT r, sum(z - a + 1) AS n, count(*) AS spans, max(z) AS last FROM spans GROUP BY r
), pieces AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM spans
  UNION ALL SELECT d.r, coalesce(last, 0) + 1, octet_length(b) FROM d LEFT JOIN gone ON gone.r = d.r
), kept AS (
  SELECT d.r, sha256(unhex(string_agg(CASE WHEN p.z >= p.a THEN hex(b[p.a:p.z]) ELSE '' END, '' ORDER BY p.a))) AS h FROM d JOIN pieces p ON p.r = d.r GROUP BY d.r
)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(gone.n, 0)::BIGINT AS n_removed, coalesce(gone.spans, 0) AS n_spans, kept.h AS kept_sha256
FROM d LEFT JOIN gone ON gone.r = d.r JOIN kept ON kept.r = d.r
"""
