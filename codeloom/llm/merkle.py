"""Merkle manifest: a hash tree over the rows of a table, with a proof for each row, by fractal traversal.

Rows are leaves. Within a group they are in order; while several nodes remain, every two in a row (the last may be alone)
become their hash, and what remains is the group's subroot. The subroots, in order of the groups, give the root likewise. A
hash is the SHA-256 of the inputs put together, digests as lower-case hex.

The tree is cut into aligned blocks of ``2**HEIGHT`` nodes. Going up, each block becomes one node of the next table, until
one is left of each group; tables shrink by that factor. Going down, the blocks of each table meet the finished proofs of
their root, and :class:`Traversal` emits the path of each node within its block, to which these are appended. A task holds
the rows of one block, and of the tree above them only the stacked subtrees of the traversal.

Places in the order come from one sort by ranges: every row has a number in its task, and a small table, with a row for each
group in each task, says how many came before. No task sees a whole group.

Defined cases: rows that are equal in group, order and leaf may stand in either order, as they have the same proofs but for
their place; a null group and null values of the order come first; an empty table has no rows; columns named like a result
keep their place in ``kept``; values may be of any length, as they are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import table, written

#: Levels of a block of the tree.
HEIGHT = 10
#: Levels of a stacked subtree.
STACKED = 2

PROOF = "array<struct<left:boolean,digest:string>>"
_STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Growing:
    """The subtree of ``high`` levels over leaves ``index << high`` onwards, built a step at a time on a stack.

    Its nodes of ``low`` levels or more, but the top one, are kept; one that has no leaves is None.
    """

    def __init__(self, leaves: Sequence[str], low: int, high: int, index: int) -> None:
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.end = index << high, (index + 1) << high
        self.stack: list[tuple[int, str | None]] = []
        self.nodes: dict[tuple[int, int], str] = {}

    def step(self) -> bool:
        """One leaf taken or two nodes joined; False if it is complete."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, right), (_, left) = stack.pop(), stack.pop()
            level += 1
            node = None if left is None else digest(left if right is None else left + right)
        elif self.at < self.end:
            level, node = 0, self.leaves[self.at] if self.at < len(self.leaves) else None
            self.at += 1
        else:
            return False
        stack.append((level, node))
        if self.low <= level < self.high and node is not None:
            self.nodes[level, (self.at >> level) - 1] = node
        return True

    def complete(self) -> Growing:
        while self.step():
            pass
        return self

    @property
    def top(self) -> str | None:
        return self.stack[0][1]


class Traversal:
    """The authentication path of each leaf in turn, from stacked subtrees.

    At every height there is the subtree that holds the present leaf's siblings, and the one to its right, which is wanted
    next and grows by two steps a leaf, so that it is complete when the leaves get there.
    """

    def __init__(self, leaves: Sequence[str], levels: int, stacked: int = STACKED) -> None:
        self.leaves, self.levels = leaves, levels
        self.spans = [(low, min(low + stacked, levels)) for low in range(0, levels, stacked)]

    def paths(self) -> Iterator[list[str | None]]:
        """A sibling for each level, None where a node is alone."""
        leaves, spans = self.leaves, self.spans
        existing = [Growing(leaves, low, high, 0).complete().nodes for low, high in spans]
        desired = [Growing(leaves, low, high, 1) for low, high in spans[:-1]]
        for leaf in range(len(leaves)):
            yield [existing[k].get((level, leaf >> level ^ 1)) for k, (low, high) in enumerate(spans) for level in range(low, high)]
            for k, growing in enumerate(desired):
                growing.step()
                growing.step()
                low, high = spans[k]
                if (leaf + 1) % (1 << high) == 0:
                    existing[k] = growing.complete().nodes
                    desired[k] = Growing(leaves, low, high, (leaf + 1 >> high) + 1)


def levels_of(total: int, height: int) -> int:
    """Levels of a block, of a group with so many nodes."""
    return min(height, (total - 1).bit_length())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that agree in the first two columns, which stand together."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        for k in range(len(groups)):
            if (groups[k], blocks[k]) != key:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, start = [], (groups[k], blocks[k]), k
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _root_of_block(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        total = block["total"][0].as_py()
        levels = levels_of(total, height)
        top = Growing(block["digest"].to_pylist(), levels, levels, 0).complete().top
        yield pa.RecordBatch.from_arrays([pa.array([block["g"][0].as_py()]), pa.array([block["block"][0].as_py()]), pa.array([-(-total >> height)]), pa.array([top])], names=["g", "idx", "total", "digest"])


def _proofs_of_block(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """The first row of a block has what its root's proof is, the others are its nodes."""
    for block in _blocks(batches):
        above = block["proof"][0].as_py()
        up_left, up_digest = [s["left"] for s in above], [s["digest"] for s in above]
        nodes = block.slice(1).combine_chunks()
        leaves = nodes["digest"].to_pylist()
        levels = levels_of(nodes["total"][0].as_py(), height)
        left: list[bool] = []
        found: list[str | None] = []
        for k, path in enumerate(Traversal(leaves, levels).paths()):
            found += path
            found += up_digest
            left += [bool(k >> level & 1) for level in range(levels)]
            left += up_left
        n = len(leaves)
        offsets = pa.array(range(0, n * (levels + len(above)) + 1, levels + len(above)) if levels + len(above) else [0] * (n + 1), pa.int32())
        steps = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(found, pa.string())], fields=list(_STEP))
        same = [pa.array([block[c][0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
        yield pa.RecordBatch.from_arrays([nodes["kept"].combine_chunks(), pa.ListArray.from_arrays(offsets, steps), *same], names=["kept", "proof", "subroot", "root"])


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``idx``, their place within ``g`` by these columns, and ``total``, the rows of ``g``."""
    ranged = df.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "places").withColumn("task", F.shiftright("at", 33))
    runs = placed.groupBy("g", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "task", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    return placed.join(runs, ["g", "task"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "shift", "task")


def ascend(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Tables (g, idx, total, digest), from ``nodes`` up to that of one node for each group."""
    tables = [nodes]
    while (nodes.agg(F.max("total")).first()[0] or 0) > 1:
        dealt = nodes.select("g", F.shiftright("idx", height).alias("block"), "idx", "total", "digest").repartition("g", "block").sortWithinPartitions("g", "block", "idx")
        nodes = written(dealt.mapInArrow(partial(_root_of_block, height=height), "g string, idx long, total long, digest string"), "nodes")
        tables.append(nodes)
    return tables


def descend(tables: list[DataFrame], tops: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(kept, proof, subroot, root) for each node of the first table, ``kept`` being its column of that name.

    ``tops`` has (g, proof, subroot, root) for each group: the proof of its subroot.
    """
    above = tops.withColumn("idx", F.lit(0).cast("bigint"))
    for k in range(len(tables) - 2, -1, -1):
        nodes = tables[k] if k == 0 else tables[k].withColumn("kept", F.struct("g", "idx"))
        kind = nodes.schema["kept"].dataType.simpleString()
        first = above.select("g", F.col("idx").alias("block"), F.lit(-1).cast("bigint").alias("idx"), F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast(kind).alias("kept"), "proof", "subroot", "root")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("proof", PROOF), ("subroot", "string"), ("root", "string"))]
        rows = first.union(nodes.select("g", F.shiftright("idx", height).alias("block"), "idx", "total", "digest", "kept", *none))
        proofs = rows.repartition("g", "block").sortWithinPartitions("g", "block", "idx").mapInArrow(partial(_proofs_of_block, height=height), f"kept {kind}, proof {PROOF}, subroot string, root string")
        if k == 0:
            return proofs
        above = written(proofs.select("kept.g", "kept.idx", "proof", "subroot", "root"), "proofs")
    return tables[0].join(tops, "g").select("kept", "proof", "subroot", "root")


def manifest(df: DataFrame, leaf: str = "leaf", group: str | None = "lang", order: Sequence[str] = ("doc_id",), height: int = HEIGHT) -> DataFrame:
    """``kept`` (a struct of the row's columns), ``proof``, ``subroot``, ``root`` for each row.

    A proof is a list of struct<left, digest>, from the leaf to the root: a sibling and whether it stands to the left; the
    digest is null where a node is alone.
    """
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    kept = F.struct(*(F.col(c) for c in df.columns))
    salt = F.xxhash64(F.col(leaf), F.monotonically_increasing_id())
    rows = df.select(g.alias("g"), *(F.col(c).alias(f"order{k}") for k, c in enumerate([*order, leaf])), salt.alias("salt"), kept.alias("kept"), F.col(leaf).alias("digest"))
    by = [*(f"order{k}" for k in range(len(order) + 1)), "salt"]
    leaves = written(numbered(written(rows, "leaves"), by).select("g", "idx", "total", "digest", "kept"), "numbered")
    tables = ascend(leaves, height)
    groups = numbered(tables[-1].select(F.lit("").alias("g"), F.col("g").alias("own"), "digest"), ["own"])
    groups = written(groups.select("g", "idx", "total", "digest", F.struct("own", F.col("digest").alias("subroot")).alias("kept")), "groups")
    upper = ascend(groups, height)
    top = upper[-1].select("g", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    over = descend(upper, top, height).select(F.col("kept.own").alias("g"), "proof", "kept.subroot", "root")
    return descend(tables, written(over, "tops"), height)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(node: Column, step: Column) -> Column:
        sibling = F.coalesce(step["digest"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(sibling, node)).otherwise(F.concat(node, sibling)), 256)

    return F.aggregate(proof, leaf, up)


def row_digest(*values: Column) -> Column:
    """SHA-256 of each value's length in bytes, a colon and the value; a dash for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    other = [*own[:3], F.col("n_chars") + 1, own[4]]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", row_digest(*own).alias("leaf"), F.when(hit, row_digest(*other)).alias("tampered"))
    found = manifest(rows).select("kept.*", "proof", "subroot", "root")
    siblings = F.array_join(F.transform("proof", lambda s: s["digest"]), "")
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _row_sql(n_chars: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_UP_SQL = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"
OP12_SQL = rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_row_sql("n_chars")} AS leaf, {_row_sql("n_chars + 1")} AS tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc
  FROM documents
), up AS (
  SELECT lang, 0 AS k, list(leaf ORDER BY idx) AS l FROM leaves GROUP BY lang
  UNION ALL SELECT lang, k + 1, {_UP_SQL} FROM up WHERE len(l) > 1
), subs AS (
  SELECT lang, k AS height, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM up WHERE len(l) = 1
), over_ AS (
  SELECT 0 AS k, list(subroot ORDER BY idx) AS l FROM subs
  UNION ALL SELECT k + 1, {_UP_SQL} FROM over_ WHERE len(l) > 1
), steps AS (
  SELECT doc_id, k, l[xor(idx >> k, 1) + 1] AS sibling, (idx >> k) & 1 AS odd FROM leaves JOIN up ON up.lang IS NOT DISTINCT FROM leaves.lang AND len(l) > 1
  UNION ALL
  SELECT doc_id, height + k, l[xor(subs.idx >> k, 1) + 1], (subs.idx >> k) & 1 FROM leaves JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang JOIN over_ ON len(l) > 1
), folded AS (
  SELECT doc_id, 0 AS k, CASE WHEN crc % 7 = 0 THEN coalesce(tampered, leaf) ELSE leaf END AS node FROM leaves
  UNION ALL
  SELECT doc_id, k + 1, sha256(CASE WHEN odd = 1 THEN sibling || node ELSE node || coalesce(sibling, '') END) FROM folded JOIN steps USING (doc_id, k)
), proofs AS (
  SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof_sha256 FROM leaves LEFT JOIN steps USING (doc_id) GROUP BY doc_id
), ends AS (
  SELECT doc_id, arg_max(node, k) AS folded_root FROM folded GROUP BY doc_id
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN proofs USING (doc_id) JOIN ends USING (doc_id) JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang CROSS JOIN (SELECT l[1] AS root FROM over_ WHERE len(l) = 1)
"""
