"""SimHash near-dedup: deletion-variant signatures, equality join, verification by distance.

A fingerprint is cut into ``distance // 2 + 1`` segments, so that one of them differs by at most one bit between linked
fingerprints. Each segment is indexed once for each of its bits with that bit deleted; equal variants meet, and the pairs
among them are verified. A pair is counted only under the first variant that it shares. Exact copies of a fingerprint are
one entry. Within a bucket of many fingerprints only links that connect are kept, never all pairs: it is cut again by
variants of the bits that are still free, until at most 2**11 fingerprints remain to be compared at once. Buckets that may
hold more than ``CROWDED`` fingerprints are dealt anew by such variants before they reach a task, so that no task holds
more than ``CROWDED`` of them, or as many as 18 free bits can tell apart.

A fingerprint may have further words of 64 bits, of longer shingles. They aren't indexed, but the further words of linked
texts may differ in few bits too, as many as fit a similarity; so a wide index distance stays safe among very many texts.

Defined cases: text without words (null, empty) has fingerprint zero, linked like any other; with fewer words than a
shingle the whole sequence is one shingle; repeated rows are copies; a component is named by its least id, null ids being
ignored unless there is no other; other columns are kept by :func:`deduplicate` and ignored by :func:`link_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, row_key, table, written
from codeloom.llm.components import components
from codeloom.llm.nearcopies import link_near_copies
from codeloom.llm.rolling import mixed

SHINGLE = 3
#: Words of a shingle of the further words.
SHINGLE_MORE = 5
DISTANCE = 3
SEED = 42
BITS = 64
#: Up to so many fingerprints are compared all with all at once.
DIRECT = 1 << 11
#: Buckets with more fingerprints are dealt again.
CROWDED = 1 << 16
#: Buckets up to this size are compared without Python loops.
SMALL = 24


def fingerprint(text: str | None, shingle: int = SHINGLE, words_more: int = 0, shingle_more: int = SHINGLE_MORE) -> list[int]:
    """Signed 64-bit SimHash words: of the XXH64 of the word shingles, then ``words_more`` of those of longer shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return [0] * (1 + words_more)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = [majority(shingle_hashes(line, starts, ends, shingle))]
    if words_more:
        longer = shingle_hashes(line, starts, ends, shingle_more)
        out += [majority(mixed(longer + np.uint64(k))) for k in range(words_more)]
    return out


def shingle_hashes(line: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(starts) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 256):  # sums of 255 bits fit in a byte
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if whole < len(part):
            ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def word_names(words_more: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, 1 + words_more))]


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, words_more: int = 0) -> DataFrame:
    """(doc_id, fp, fp1, ...) for each row."""
    names = word_names(words_more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle, words_more) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(len(names)))], names=["doc_id", *names])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names)]))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    """The 64 bits of a number as a signed one."""
    x &= (1 << BITS) - 1
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segment_value(first: int, width: int) -> Column:
    whole = F.shiftrightunsigned("fp", first)
    return whole if first + width == BITS else whole.bitwiseAND(F.lit((1 << width) - 1))


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """(slot, value, fp): the segments with each one bit deleted; a slot holds segment and bit."""
    keys = []
    for s, (first, width) in enumerate(segments(distance)):
        for bit in range(width):
            gone = segment_value(first, width).bitwiseAND(F.lit(signed(~(1 << bit))))
            keys.append(F.struct(F.lit(s * BITS + bit).cast("smallint").alias("slot"), gone.alias("value")))
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # so many rows come of each that the few partitions which hold the fingerprints would be too few
    return fps.repartition(spread, F.xxhash64("fp")).select(F.explode(F.array(*keys)).alias("key"), *fps.columns).select("key.slot", "key.value", *fps.columns)


def crowded_buckets(fps: DataFrame, distance: int) -> DataFrame:
    """(slot, value) of all buckets with more than ``CROWDED`` fingerprints, and perhaps of some with fewer.

    A bucket's fingerprints have one of two values in its segment, so one of the two has more than half of them.
    """
    cut = segments(distance)
    values = F.array(*(F.struct(F.lit(s).alias("s"), segment_value(first, width).alias("v")) for s, (first, width) in enumerate(cut)))
    many = fps.select(F.explode(values).alias("k")).groupBy("k.s", "k.v").count().filter(F.col("count") > CROWDED // 2)
    bits = F.array(*(F.sequence(F.lit(0), F.lit(width - 1)) for _, width in cut))
    each = many.select("s", "v", F.explode(F.element_at(bits, F.col("s") + 1)).alias("bit"))
    mask = F.bitwise_not(F.expr("shiftleft(1L, bit)"))
    return each.select((F.col("s") * BITS + F.col("bit")).cast("smallint").alias("slot"), F.col("v").bitwiseAND(mask).alias("value")).distinct()


def free_bits(slot: int, cut: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the bits in which fingerprints of this slot's buckets may differ."""
    first, width = cut[slot // BITS]
    fixed = set(range(first, first + width)) - {first + slot % BITS}
    return np.array([b for b in range(BITS) if b not in fixed])


def second_cuts(slot: int, distance: int) -> list[tuple[int, np.ndarray]]:
    """For each way to cut a bucket of this slot again: the mask of the bits that are equal then, and those still free."""
    free, out = free_bits(slot, segments(distance)), []
    for part in np.array_split(free, distance // 2 + 1):
        for bit in part:
            mask = sum(1 << int(b) for b in part if b != bit)
            out.append((signed(mask), np.concatenate([free[~np.isin(free, part)], [bit]])))
    return out


def first_slot(xor: np.ndarray, cut: list[tuple[int, int]]) -> np.ndarray:
    """The first slot that a pair with this difference shares."""
    slot = np.full(xor.shape, -1, np.int64)
    for s, (first, width) in reversed(list(enumerate(cut))):
        part = (xor >> np.uint64(first)) & np.uint64((1 << width) - 1)
        bit = np.bitwise_count(part - np.uint64(1) & ~part).astype(np.int64)  # of the lowest one
        single = (part & (part - np.uint64(1))) == 0
        slot = np.where(single, s * BITS + np.where(part == 0, 0, bit), slot)
    return slot


def forest(size: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least one that ``a`` and ``b`` connect it with."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            at = np.flatnonzero(root != np.arange(size))
            return root[at], at
        root = new


class Linker:
    """Links within buckets of equal (slot, value). Fingerprints are rows of 64-bit words, of which the first is indexed."""

    def __init__(self, distance: int, total: int | None, words: int) -> None:
        self.distance, self.total, self.cut, self.links, self.words = distance, total, segments(distance), [], words

    def near(self, x: np.ndarray, y: np.ndarray, slot: np.ndarray | int) -> np.ndarray:
        """For rows x and y: linked, and this slot is the first that they share."""
        xor = x[:, 0] ^ y[:, 0]
        out = np.bitwise_count(xor) <= self.distance
        at = np.flatnonzero(out)
        fits = first_slot(xor[at], self.cut) == (slot[at] if isinstance(slot, np.ndarray) else slot)
        if self.total is not None:
            fits &= np.bitwise_count(x[at, 1:] ^ y[at, 1:]).sum(axis=1, dtype=np.int64) <= self.total
        out[at] = fits
        return out

    def small(self, slot: np.ndarray, bucket: np.ndarray, fp: np.ndarray) -> None:
        for k in range(1, SMALL):
            same = np.flatnonzero(bucket[:-k] == bucket[k:])
            if not len(same):
                return
            hit = same[self.near(fp[same], fp[same + k], slot[same])]
            self.links.append((fp[hit], fp[hit + k]))

    def large(self, slot: int, fp: np.ndarray, free: np.ndarray) -> None:
        """fp: distinct; free: numbers of the bits of the first word in which they may differ."""
        if len(fp) < 2:
            return
        # texts that share the first word and differ in others have no free bits left to cut by
        if len(fp) <= DIRECT or len(free) <= 11:
            pairs = []
            for i in range(0, len(fp), 256):
                part = fp[i : i + 256]
                close = np.bitwise_count(part[:, None, 0] ^ fp[None, :, 0]) <= self.distance
                a, b = np.nonzero(close)
                a += i
                a, b = a[a < b], b[a < b]
                hit = self.near(fp[a], fp[b], slot)
                pairs.append(forest(len(fp), a[hit], b[hit]) if hit.sum() > len(fp) else (a[hit], b[hit]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            if len(a):
                a, b = forest(len(fp), a, b)
                self.links.append((fp[a], fp[b]))
            return
        n = self.distance // 2 + 1
        for part in np.array_split(free, n):
            mask = np.bitwise_or.reduce(np.uint64(1) << part.astype(np.uint64))
            for bit in part:
                value = fp[:, 0] & mask & ~(np.uint64(1) << np.uint64(bit))
                order = np.argsort(value, kind="stable")
                value, own = value[order], fp[order]
                left = np.concatenate([free[~np.isin(free, part)], [bit]])
                for group in np.split(own, np.flatnonzero(value[1:] != value[:-1]) + 1):
                    self.large(slot, group, left)

    def buckets(self, slot: np.ndarray, value: np.ndarray, fp: np.ndarray) -> None:
        """Whole buckets, sorted."""
        self.groups(slot, [slot, value], fp, lambda k: free_bits(int(slot[k]), self.cut))

    def groups(self, slot: np.ndarray, keys: list[np.ndarray], fp: np.ndarray, free: Callable[[int], np.ndarray]) -> None:
        """Whole groups of equal keys, sorted; ``free`` gives the bits in which those of the group at a place may differ."""
        edge = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        few = (sizes[bucket] > 1) & (sizes[bucket] <= SMALL)
        if few.any():
            self.small(slot[few], bucket[few], fp[few])
        for i in np.flatnonzero(sizes > SMALL):
            self.large(int(slot[starts[i]]), fp[starts[i] : starts[i] + sizes[i]], free(starts[i]))

    def take(self) -> pa.RecordBatch:
        none = np.zeros((0, self.words), np.uint64)
        a, b = (node_arrays(np.concatenate([none, *(x[k] for x in self.links)])) for k in (0, 1))
        self.links = []
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def node_arrays(fp: np.ndarray) -> pa.Array:
    """Fingerprints as nodes: a long for one word, else the bytes of all words."""
    if fp.shape[1] == 1:
        return pa.array(fp[:, 0].view(np.int64))
    data, size = fp.astype(">u8").tobytes(), 8 * fp.shape[1]
    return pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary())


def node(words_more: int) -> Column:
    """The same for the columns of a frame."""
    if not words_more:
        return F.col("fp")
    return F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in word_names(words_more))))


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, total: int | None = None) -> DataFrame:
    """Links (a, b) between nodes that connect what pairs of near fingerprints connect; ``fps`` holds distinct fingerprints."""
    words = len(fps.columns)
    schema = "a long, b long" if words == 1 else "a binary, b binary"

    def grouped(n_keys: int, handle):
        """Whole groups of rows with equal keys, sorted, by ``handle(linker, keys, fp)``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            linker, held = Linker(distance, total, words), []
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = [batch.column(k).to_numpy().astype(np.int64) for k in range(n_keys)]
                fp = np.stack([batch.column(n_keys + k).to_numpy().view(np.uint64) for k in range(words)], axis=1)
                if held and all(h[0] == k[0] == k[-1] for h, k in zip(held[0][0], keys, strict=True)):
                    held.append((keys, fp))  # one bucket over many batches
                    continue
                held.append((keys, fp))
                keys = [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)]
                fp = np.concatenate([h[1] for h in held])
                differ = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
                last = int(differ[-1]) + 1 if len(differ) else 0
                if last:
                    handle(linker, [k[:last] for k in keys], fp[:last])
                    yield linker.take()
                held = [([k[last:] for k in keys], fp[last:])]
            if held:
                handle(linker, [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]))
                yield linker.take()

        return run

    def crowd(linker: Linker, keys: list[np.ndarray], fp: np.ndarray) -> None:
        linker.groups(keys[0], keys, fp, lambda k: second_cuts(int(keys[0][k]), distance)[int(keys[2][k])][1])

    dealt, crowded, out = variants(fps, distance), written(crowded_buckets(fps, distance), "crowded"), None
    if not crowded.isEmpty():
        slots = [s * BITS + bit for s, (_, width) in enumerate(segments(distance)) for bit in range(width)]
        masks = fps.sparkSession.createDataFrame([(s, [m for m, _ in second_cuts(s, distance)]) for s in slots], "slot smallint, masks array<long>")
        again = dealt.join(crowded, ["slot", "value"], "left_semi").join(F.broadcast(masks), "slot")  # 64 rows
        again = again.select("slot", "value", F.posexplode("masks").alias("way", "mask"), *fps.columns).select("slot", "value", "way", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), *fps.columns)
        keys = ["slot", "value", "way", "rest"]
        out = again.repartition(*keys).sortWithinPartitions(*keys, *fps.columns).mapInArrow(grouped(4, crowd), schema)
        dealt = dealt.join(crowded, ["slot", "value"], "left_anti")
    dealt = dealt.select("slot", "value", *fps.columns).repartition("slot", "value").sortWithinPartitions("slot", "value", *fps.columns)
    links = dealt.mapInArrow(grouped(2, lambda linker, keys, fp: linker.buckets(*keys, fp)), schema)
    return links if out is None else links.unionByName(out)


def link_documents(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, words_more: int = 0, total: int | None = None
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``df``."""
    names = word_names(words_more)
    docs = written(fingerprints(df, doc_id, text, shingle, words_more), "fingerprints")
    fps = docs.groupBy(*names).agg(F.min("doc_id").alias("least"))
    star = components(fingerprint_links(fps.select(*names), distance, total))
    placed = fps.withColumn("node", node(words_more)).join(star, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written, so that the join by root is a join of two tables, which adaptive execution may split where a root is hot
    named = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return docs.join(placed.join(named, "root").select(*names, "component_id"), names).select("doc_id", "fp", "component_id")


def bits_for(similarity: float, words: int) -> int:
    """Bits in which this many words of texts of equal length differ at most, on average, whose shingles have this Jaccard similarity."""
    return math.ceil(BITS * words * math.acos(2 * similarity / (1 + similarity)) / math.pi)


#: For :func:`deduplicate`: bits of the fingerprint in which texts may differ to be proposed, and the similarity of five-word
#: shingles by which they are linked.
WIDE_DISTANCE, SIMILARITY = 7, 0.8


def deduplicate(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = WIDE_DISTANCE, words_more: int | None = None, similarity: float = SIMILARITY
) -> DataFrame:
    """``df`` with one row of each component: that of its least id, ids being told apart from null and rows by id and text.

    Components are those of the exact similarity (see :mod:`codeloom.llm.nearcopies`); if ``words_more`` is given, those of
    the fingerprints alone.
    """
    if words_more is None:
        linked = link_near_copies(df, doc_id, text, shingle, distance, similarity)
    else:
        total = bits_for(similarity, words_more) if words_more else None
        own = df.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key")).alias("row"), F.col(text).alias("text"))
        linked = link_documents(own, "row", "text", shingle, distance, words_more, total).select("doc_id.doc_id", "doc_id.key", F.col("component_id").alias("root"))
    stay = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least")).select(F.col("least.key").alias("key_"))
    key = fresh(df.columns, "key_")
    keyed = df.withColumn(key, row_key(df[doc_id], df[text])).dropDuplicates([key])  # reduced before it meets the keys that stay
    return keyed.join(stay.withColumnRenamed("key_", key), key, "left_semi").select(df.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
