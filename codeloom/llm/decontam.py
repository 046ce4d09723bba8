"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

1. Items are partitioned by the number of their shingles, each partition reaching twice as far as the one before. The partition
   gives the size of its items' sketches, which hold the least hashes of their word shingles: of an item with n shingles a
   document may lack ``n - ceil(threshold * n)``, so a sketch of s values is hit at least ``s`` less that many times, and s is
   one more than twice what the largest items of the partition may lack. No document that contains an item is missed,
   however long it is (signatures of whole documents would miss most items in long ones). The sketches are a table.
2. One pass over the documents, whatever the number of items: each partition has a filter, which says which of a document's
   shingles may be in one of its sketches; a document with too few shingles for the smallest items of a partition isn't
   asked for it. Documents with such shingles are written with them; all others are done with. The filters share 8 MB by the
   number of their values, after one of 8 MB for all partitions, which few shingles pass: with a million values in all sketches
   one other shingle in two thousand at most gets through both, with seven million about one in fifty. More values let more
   shingles pass, but lose none.
3. These hashes meet the sketches of their partition in an equi-join. Pairs with enough hits are verified by comparing the shingles themselves,
   ``ITEMS`` items of a document at a time.

Defined cases: items with fewer words than a shingle match as a whole sequence of words if asked for (the query and the
pipeline do), else not; items without an id are searched like others; null or empty ones match nothing; null or empty
documents contain nothing; items that are equal in id and text are one item; rows of documents that are repeated give rows
each; ids of any type are kept as they are; other columns are ignored; shingles are sets, so repeats count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, row_key, table, written
from codeloom.llm.rolling import Sums, mixed

SHINGLE = 5
THRESHOLD = 0.8
#: Bits of the filter for all partitions, and of those of the partitions together, as a power of two: 8 MB each at every size
#: of the benchmark.
FILTER_BITS = 26
#: Items verified at once against a document.
ITEMS = 256


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def ends_of_words(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of a normalised text, and the byte after it."""
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])


def shingles(text: str | None, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The normalised text with the first and last byte of every shingle."""
    line = normalised(text)
    starts, ends = ends_of_words(line)
    if not line or len(starts) < size:
        return line, starts[:0], ends[:0]
    return line, starts[: len(starts) - size + 1], ends[size - 1 :]


def spare(n: int, threshold: float) -> int:
    """Of n shingles, how many a document may lack."""
    return n - math.ceil(threshold * n - 1e-9)


def partition(n: int) -> int:
    """Of items with n shingles: partition p has those with 2**(p - 1) up to 2**p - 1."""
    return n.bit_length()


def sketch_size(n: int, threshold: float) -> tuple[int, int]:
    """For items with n shingles: values in a sketch of their partition, and how many of them must be hit."""
    size = min(n, 2 * spare(2 ** partition(n) - 1, threshold) + 1)
    return size, size - spare(n, threshold)


def least_shingles(part: int, threshold: float) -> int:
    """Shingles that a document must have to contain an item of this partition."""
    return math.ceil(threshold * 2 ** (part - 1) - 1e-9)


def shingle_hashes(line: bytes, size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed(Sums(line).ranges(starts, ends) + np.uint64(size))


def item_size(line: bytes, size: int) -> int:
    """Words in a shingle of this item: all it has, if it is shorter than a shingle."""
    return min(size, line.count(b" ") + 1)


def sketch_items(items: DataFrame, size: int, threshold: float, short: bool) -> DataFrame:
    """(part, words, hash, key, needs): a row for each value of an item's sketch; ``items`` are (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line = normalised(text)
                words = item_size(line, size)
                if not line or words < size and not short:
                    continue
                hashes = np.unique(shingle_hashes(line, words, *shingles(text, words)[1:]))
                values, needs = sketch_size(len(hashes), threshold)
                for h in hashes[:values].view(np.int64).tolist():
                    for to, x in zip(rows, (partition(len(hashes)), words, h, key, needs), strict=True):
                        to.append(x)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["part", "words", "hash", "key", "needs"])

    return items.select("key", "text").mapInArrow(run, "part int, words int, hash long, key binary, needs int")


def hash_filters(sketches: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """By (words, part) a bit for each hash by its last bits, a power of two in number. Partitions are some dozens at most.

    Under (0, 0) the filter for all, by the first bits.
    """
    counts = {(r.words, r.part): r["count"] for r in sketches.groupBy("words", "part").count().collect()}
    total = sum(counts.values())
    bits = {k: max(3, math.floor(math.log2(2**FILTER_BITS * n / total))) for k, n in counts.items()}
    own = F.coalesce(*(F.when((F.col("words") == w) & (F.col("part") == p), F.lit(b)) for (w, p), b in bits.items()), F.lit(3))
    bits[0, 0] = FILTER_BITS
    places = sketches.withColumn("bits", own).select("words", "part", F.expr("hash & (shiftleft(1L, bits) - 1)").alias("p"))
    places = places.unionByName(sketches.select(F.lit(0).alias("words"), F.lit(0).alias("part"), F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("p")))
    places = places.select("words", "part", F.shiftright("p", 3).cast("int").alias("byte"), F.expr("shiftleft(1, cast(p & 7 as int))").alias("bit"))
    out = {k: np.zeros(1 << (b - 3), np.uint8) for k, b in bits.items()}
    found = places.groupBy("words", "part", "byte").agg(F.bit_or("bit").alias("bits")).toArrow()  # twice 2**(FILTER_BITS - 3) rows at most
    words, part, byte, value = (found.column(c).to_numpy() for c in ("words", "part", "byte", "bits"))
    for (w, p), filled in out.items():
        own_rows = (words == w) & (part == p)
        filled[byte[own_rows]] = value[own_rows]
    return out


def set_in(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    at = place.astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def possible_hits(docs: DataFrame, sketches: DataFrame, size: int, threshold: float) -> DataFrame:
    """(row, text, hits: array of struct<words, part, hash>) of the documents that may hit a sketch; ``docs`` are (row, text)."""
    filters = hash_filters(sketches)
    sent = docs.sparkSession.sparkContext.broadcast((filters.pop((0, 0)), sorted(filters.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (whole, filters), right = sent.value, np.uint64(64 - FILTER_BITS)
        for batch in batches:
            at, hits = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                line = normalised(text)
                if not line:
                    continue
                starts, ends = ends_of_words(line)
                sums, found, n, some, of = Sums(line), [], 0, np.zeros(0, np.uint64), 0
                for (words, part), bits in filters:  # those of one length stand together
                    if len(starts) < words:
                        break
                    if of != words:
                        hashes = np.unique(mixed(sums.ranges(starts[: len(starts) - words + 1], ends[words - 1 :]) + np.uint64(words)))
                        of, n = words, len(hashes)
                        some = hashes[set_in(whole, hashes >> right)]
                    if n < least_shingles(part, threshold):
                        continue
                    own = some[set_in(bits, some & np.uint64(len(bits) * 8 - 1))]
                    found += [(words, part, h) for h in own.view(np.int64).tolist()]
                if found:
                    at.append(k)
                    hits.append([{"words": w, "part": p, "hash": h} for w, p, h in found])
            kind = pa.list_(pa.struct([("words", pa.int32()), ("part", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)), pa.array(hits, kind)], names=["row", "text", "hits"])

    return docs.select("row", "text").mapInArrow(run, "row binary, text string, hits array<struct<words:int,part:int,hash:bigint>>")


def verify(pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(row, key, n_shingles, n_found, containment); ``pairs`` are (row, text, items: array of struct<key, text>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, text, items in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own: dict[int, set[bytes]] = {}
                for item in items:
                    words = item_size(normalised(item["text"]), size)
                    if words not in own:
                        own[words] = shingle_set(text, words)
                    wanted = shingle_set(item["text"], words)
                    n, common = len(wanted), len(wanted & own[words])
                    if common >= threshold * n - 1e-9:
                        for to, x in zip(out, (row, item["key"], n, common, common / n), strict=True):
                            to.append(x)
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["row", "key", "n_shingles", "n_found", "containment"])

    return pairs.select("row", "text", "items").mapInArrow(run, "row binary, key binary, n_shingles long, n_found long, containment double")


def shingle_set(text: str | None, size: int) -> set[bytes]:
    line, starts, ends = shingles(text, size)
    return {line[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}


def contained_items(docs: DataFrame, items: DataFrame, size: int, threshold: float, short: bool) -> DataFrame:
    """(row, key, n_shingles, n_found, containment) for each item (key, text) that a document (row, text) contains."""
    sketches = written(sketch_items(items, size, threshold, short), "sketches")
    texts = written(possible_hits(docs, sketches, size, threshold), "possible-hits")
    hits = texts.select("row", F.inline("hits")).distinct().join(sketches, ["words", "part", "hash"])  # rows may be repeated in full
    pairs = hits.groupBy("row", "part", "key").agg(F.count("*").alias("n"), F.max("needs").alias("needs")).filter("n >= needs").select("row", "key")
    pairs = written(pairs.join(items.select("key", F.col("text").alias("item")), "key"), "candidates")
    lots = pairs.groupBy("row").agg(F.ceil(F.count("*") / ITEMS).alias("lots"))
    lot = F.pmod(F.xxhash64("key"), F.col("lots")).alias("lot")
    dealt = pairs.join(lots, "row").groupBy("row", lot).agg(F.collect_list(F.struct("key", F.col("item").alias("text"))).alias("items"))
    return verify(dealt.join(texts.select("row", "text"), "row"), size, threshold).dropDuplicates(["row", "key"])


def keyed_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(key, item_id, text) of the distinct items."""
    rows = items.select(row_key(F.col(item_id), F.col(text)).alias("key"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return rows.filter("text is not null").dropDuplicates(["key"])


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, short: bool = False
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each item that a document contains by ``threshold``.

    If ``short``, items with fewer words than a shingle are found too.
    """
    own = keyed_items(items, item_id, item_text)
    rows = docs.select(row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = written(contained_items(rows, own, shingle, threshold, short), "leaks")
    named = found.join(own.select("key", "item_id"), "key")
    return rows.select("row", "doc_id").join(named, "row").select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def remove_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", short: bool = False, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; rows are told apart by id and text."""
    key = fresh(docs.columns, "key_")
    keyed = docs.withColumn(key, row_key(docs[doc_id], docs[text]))
    rows = keyed.select(F.col(key).alias("row"), F.col(text).alias("text"))
    leaky = contained_items(rows, keyed_items(items, item_id, item_text), SHINGLE, THRESHOLD, short).select(F.col("row").alias(key)).distinct()
    return keyed.join(written(leaky, "leaky"), key, "left_anti").select(docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w
), v AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), b AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM v
), n AS (
  SELECT item_id, count(*) AS n FROM b GROUP BY item_id
)
SELECT doc_id, item_id, any_value(n) AS n_shingles, count(*) AS n_found, count(*) / any_value(n) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""
