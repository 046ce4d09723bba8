"""Near copies by exact similarity: signatures propose, the five-word shingles themselves decide.

1. Rows whose words are equal are one node. A node has a SimHash fingerprint and a MinHash sketch of its shingles.
2. Fingerprints within an index distance, and sketches that agree in a band, meet; of a band's bucket only such links stay as
   connect what the sketches hold for near (of one with more than ``CROWDED`` nodes, links of all its nodes to the bucket).
   At the similarity itself all bands fail for less than one pair in 10,000. The nodes so connected are a cluster.
3. A cluster is cut into blocks of bounded size. Every pair that the sketches (five standard deviations below the mean) and
   the sizes allow is compared by its shingles (as 64-bit hashes), unless the two are connected already: within a cluster
   of one block in one task; in a larger one its ``HUBS`` nodes of the most proposals are first compared with all others,
   then the nodes that these leave apart from the largest group, in blocks, with every block of the cluster.

Components are thus those of all pairs that reach the similarity, and of no others, whatever the size of a cluster; a task
holds two blocks at most. Shared passages and lines don't make clusters, as texts that share little have sketches that differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import row_key, written
from codeloom.llm.components import components
from codeloom.llm.rolling import Sums, mixed

SHINGLE = 5
#: Values of a sketch.
VALUES = 80
#: The share of pairs at the similarity that may agree in no band.
MISSED = 1e-4
#: Nodes of a band's bucket that are compared in one task.
CROWDED = 4096
#: Nodes and bytes of text in a block of a cluster.
BLOCK_NODES, BLOCK_BYTES = 2048, 8 << 20
#: Nodes of a large cluster that are compared with all others first.
HUBS = 8
_ADD = mixed(np.arange(1, VALUES + 1, dtype=np.uint64))
_TIMES = mixed(_ADD) | np.uint64(1)


def shingle_set(line: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a normalised text; with fewer words the whole is one."""
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    if len(starts) > size:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(Sums(line).ranges(starts, ends))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    out = np.full(VALUES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        out = np.minimum(out, ((_ADD[:, None] ^ hashes[None, at : at + 256]) * _TIMES[:, None]).min(axis=1))
    return mixed(out)


def rows_of_band(similarity: float) -> int:
    """As many values in a band as leave no more than MISSED of the pairs at this similarity without one in common."""
    return next((r for r in (8, 5, 4, 2) if (1 - similarity**r) ** (VALUES // r) <= MISSED), 1)


def least_agreement(similarity: float) -> int:
    """Values of the sketches in which texts of this similarity agree, but for five standard deviations."""
    return math.floor(VALUES * similarity - 5 * math.sqrt(VALUES * similarity * (1 - similarity)))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def nodes_of_rows(df: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, key, node, fp, sketch, bands, size) for each row."""
    import xxhash

    from codeloom.llm.simhash import fingerprint

    size = rows_of_band(similarity)
    names, kinds = ["node", "fp", "sketch", "bands", "size"], [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for t in batch.column(2).to_pylist():
                line = normalised(t)
                values = minima(shingle_set(line))
                bands = values.reshape(-1, size)[:, 0].copy()
                for k in range(1, size):
                    bands = mixed(bands + values.reshape(-1, size)[:, k])
                for to, x in zip(out, (xxhash.xxh3_128_digest(line), fingerprint(t, shingle)[0], values.astype(np.uint8).tobytes(), bands.view(np.int64), len(line)), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "key", *names])

    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, node binary, fp long, sketch binary, bands array<long>, size long")


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def connecting(sketch: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Links that connect what pairs of near sketches connect; each node is compared with those not reached yet."""
    a, b, left, queue = [], [], np.arange(1, len(sketch)), [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        near = (sketch[left] == sketch[i]).sum(axis=1) >= least
        hit = left[near].tolist()
        a += [i] * len(hit)
        b += hit
        queue += hit
        left = left[~near]
    return a, b


def band_links(nodes: DataFrame, least: int) -> DataFrame:
    """Links (a, b) between nodes that agree in a band and whose sketches are near."""

    def buckets(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        band, value = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        edge = np.flatnonzero((band[1:] != band[:-1]) | (value[1:] != value[:-1])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(band)]]))
        several = np.flatnonzero(sizes > 1)
        if not len(several):
            return
        own = rows.take(pa.array(np.flatnonzero(np.repeat(sizes > 1, sizes)))).combine_chunks()
        names, sketch, a, b, at = own.column(2).to_pylist(), sketches(own.column(3)), [], [], 0
        for n in sizes[several].tolist():
            x, y = connecting(sketch[at : at + n], least)
            a += [names[at + i] for i in x]
            b += [names[at + i] for i in y]
            at += n
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket, whose end isn't known yet
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, end = ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for k in (0, batch.num_rows - 1))
            if first == end == last:
                held.append(batch)
                continue
            band, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = 0 if first == end else int(np.flatnonzero((band != end[0]) | (value != end[1]))[-1]) + 1
            whole = [*held, batch.slice(0, cut)]
            if sum(x.num_rows for x in whole):
                yield from buckets(pa.Table.from_batches(whole))
            held, last = [batch.slice(cut)], end
        if held:
            yield from buckets(pa.Table.from_batches(held))

    bands = nodes.select(F.posexplode("bands").alias("band", "value"), "node", "sketch")
    crowded = written(bands.groupBy("band", "value").count().filter(F.col("count") > CROWDED).select("band", "value"), "crowded-bands")
    if crowded.isEmpty():
        return bands.repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(run, "a binary, b binary")
    bucket = F.concat(F.lit(b"\xff"), F.unhex(F.md5(F.concat_ws(":", "band", "value").cast("binary"))))  # a byte longer than a node
    all_linked = bands.join(crowded, ["band", "value"], "left_semi").select(bucket.alias("a"), F.col("node").alias("b"))
    others = bands.join(crowded, ["band", "value"], "left_anti").select("band", "value", "node", "sketch")
    return others.repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(run, "a binary, b binary").unionByName(all_linked)


def fingerprint_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints are equal or near."""
    from codeloom.llm.simhash import fingerprint_links

    fps = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(fps, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(fps.select("fp"), distance).withColumnsRenamed({"a": "x", "b": "y"})
    near = links.join(fps.select(F.col("fp").alias("x"), F.col("least").alias("a")), "x").join(fps.select(F.col("fp").alias("y"), F.col("least").alias("b")), "y")
    return same.unionByName(near.select("a", "b"))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def connected(sets: list[np.ndarray], sketch: np.ndarray, similarity: float, least: int, label: np.ndarray | None = None) -> np.ndarray:
    """For each set the first of those that pairs of this Jaccard similarity, or equal labels, connect it with."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(n) if label is None else label.copy()
    at, step = 0, 1  # one at first, which connects most of a group of like texts
    while at < n - 1:
        rows = slice(at, min(n, at + step))
        a, b = np.nonzero(label[rows, None] != label[None, at:])
        if len(a):
            low, high = np.minimum(size[a + at], size[b + at]), np.maximum(size[a + at], size[b + at])
            fits = low >= similarity * high - 1e-9
            a, b = a[fits] + at, b[fits] + at
            agree = np.concatenate([np.zeros(0, np.int64), *((sketch[a[k : k + 65536]] == sketch[b[k : k + 65536]]).sum(axis=1) for k in range(0, len(a), 65536))])
            near = np.flatnonzero(agree >= least)
            near = near[np.argsort(-agree[near], kind="stable")]
            a, b = a[near], b[near]
        while len(a):
            for x, y in zip(a[:64].tolist(), b[:64].tolist(), strict=True):
                if label[x] != label[y] and similar(sets[x], sets[y], similarity):
                    low_, high_ = sorted((label[x], label[y]))
                    label[label == high_] = low_
            a, b = a[64:], b[64:]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        at += step
        step = max(1, min(256, 16 * step, (1 << 20) // n))
    return label


def small_sketches(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([minima(s).astype(np.uint8) for s in sets])


def unit_links(units: DataFrame, keys: list[str], similarity: float, least: int) -> DataFrame:
    """Links (a, b) that connect what similar pairs connect within each unit; ``units`` are (keys, node, text, group), nodes of
    one group being connected already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sets, groups = None, {}, {}
        for batch in batches:
            own = zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True)
            for u, node, text, group in zip(own, *(batch.column(k).to_pylist() for k in ("node", "text", "group")), strict=True):
                if u != unit:
                    yield from parts(sets, groups)
                    unit, sets, groups = u, {}, {}
                if node not in sets:
                    sets[node], groups[node] = shingle_set(normalised(text)), group
        yield from parts(sets, groups)

    def parts(sets: dict[bytes, np.ndarray], groups: dict[bytes, bytes]) -> Iterator[pa.RecordBatch]:
        if len(sets) < 2:
            return
        names = sorted(sets)
        own, first = [sets[k] for k in names], {}
        before = np.array([first.setdefault(groups[k], i) for i, k in enumerate(names)])
        label = connected(own, small_sketches(own), similarity, least, before)
        at = np.flatnonzero((label != np.arange(len(names))) & (label != before)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([names[label[k]] for k in at], pa.binary()), pa.array([names[k] for k in at], pa.binary())], names=["a", "b"])

    return units.select(*keys, "node", "text", "group").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def hub_links(units: DataFrame, similarity: float, least: int) -> DataFrame:
    """Links (a, b) from the hubs to the similar nodes of each block; ``units`` are (cluster, block, member, node, text), hubs being no members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, hubs = None, []
        for batch in batches:
            a, b = [], []
            for c, block, member, node, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (c, block) != unit:
                    unit, hubs = (c, block), []
                own = shingle_set(normalised(text))
                sketch = minima(own).astype(np.uint8)
                if not member:
                    hubs.append((node, own, sketch))
                    continue
                for hub, other, theirs in hubs:
                    low, high = sorted((len(own), len(other)))
                    if hub != node and low >= similarity * high - 1e-9 and (sketch == theirs).sum() >= least and similar(own, other, similarity):
                        a.append(hub)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    keys = ["cluster", "block"]
    return units.select(*keys, "member", "node", "text").repartition(*keys).sortWithinPartitions(*keys, "member").mapInArrow(run, "a binary, b binary")


def large_links(members: DataFrame, proposals: DataFrame, similarity: float, least: int) -> DataFrame:
    """Links (a, b) within clusters of several blocks; ``members`` are (cluster, node, text, size, blocks)."""
    degrees = proposals.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "node"))
    hubs = members.select("cluster", "node").join(degrees, "node").withColumn("place", place).filter(F.col("place") <= HUBS).select("cluster", "node")
    placed = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    everywhere = members.join(hubs, ["cluster", "node"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    columns = ["cluster", "block", "member", "node", "text"]
    units = placed.withColumn("member", F.lit(True)).select(columns).unionByName(everywhere.withColumn("member", F.lit(False)).select(columns))
    found = written(hub_links(units, similarity, least), "hub-links")

    star = components(found)
    grouped = members.select("cluster", "node", "size", "blocks").join(star, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    main = grouped.groupBy("cluster", "group").count().groupBy("cluster").agg(F.max_by("group", F.struct("count", "group")).alias("main"))
    apart = written(grouped.join(main, "cluster").withColumn("apart", F.col("group") != F.col("main")).drop("main"), "groups")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("rest")
    rest = apart.filter("apart").groupBy("cluster").agg(blocks)
    rows = members.drop("size", "blocks").join(apart, ["cluster", "node"]).join(rest, "cluster")  # clusters without any apart go
    all_ = rows.withColumns({"i": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rest") - 1)), "j": F.pmod(F.xxhash64("node"), F.col("blocks"))})
    queries = rows.filter("apart").withColumns({"j": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)), "i": F.pmod(F.xxhash64("node"), F.col("rest"))})
    columns = ["cluster", "i", "j", "node", "text", "group"]
    return found.unionByName(unit_links(all_.select(columns).unionByName(queries.select(columns)), ["cluster", "i", "j"], similarity, least))


def verified(members: DataFrame, proposals: DataFrame, similarity: float, least: int) -> DataFrame:
    """(node, root) for the nodes that reach the similarity with another; ``members`` are (cluster, node, text, size), a node
    being in one cluster."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks")
    large = written(members.groupBy("cluster").agg(blocks).filter("blocks > 1"), "large-clusters")
    some = not large.isEmpty()
    small = members.join(large, "cluster", "left_anti") if some else members
    # a cluster of one block is linked in one task, each node to the first that it is connected with
    roots = unit_links(small.withColumn("group", F.col("node")), ["cluster"], similarity, least).select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(components(large_links(members.join(large, "cluster"), proposals, similarity, least))) if some else roots


def link_near_copies(df: DataFrame, doc_id: str, text: str, shingle: int, distance: int, similarity: float) -> DataFrame:
    """(doc_id, key, root) for each row; rows of one root are connected by pairs of this five-word similarity."""
    least = least_agreement(similarity)
    docs = written(nodes_of_rows(df, doc_id, text, shingle, similarity), "nodes")
    nodes = written(docs.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "sketch", "bands", "size")), F.min("key").alias("key")), "distinct-nodes")
    proposals = written(band_links(nodes, least).unionByName(fingerprint_pairs(nodes, distance)), "proposals")
    star = components(proposals)
    clusters = star.select("node", F.col("root").alias("cluster")).unionByName(star.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    wanted = clusters.join(nodes.select("node", "key", "size"), "node")
    texts = df.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    # one row of each node, as rows may be repeated in full
    members = written(texts.join(wanted, "key").groupBy("cluster", "node", "size").agg(F.first("text").alias("text")), "members")
    roots = verified(members, proposals, similarity, least)
    return docs.select("doc_id", "key", "node").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
