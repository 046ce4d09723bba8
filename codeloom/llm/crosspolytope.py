"""Approximate nearest neighbours by cross-polytope hashing.

A vector of length one is turned by a pseudo-random rotation (three rounds of random signs and a fast Hadamard transform)
and hashed to the nearest signed axis. A bucket is named by the axes of one, two or three such rotations; there are
``TABLES`` independent tables. A query looks into the buckets that its own rotated coordinates make most likely, ``probes``
of them in each table, best first by the sum of squared gaps to the largest coordinate. In each bucket one matrix product
tells which of its vectors may be the nearest of each query that asks; the distances to these original vectors are computed in
double precision, and only the nearest of the bucket leave the task.

How many rotations name a bucket and how many buckets are probed is fitted: for up to ``SAMPLE`` of the queries (those of the
least hash) the true nearest are found among all vectors, in blocks; the number of probes is the least that finds ``TARGET`` of
them, and of the kinds of buckets the one that costs least by that sample is taken. Everything fitted is of bounded size,
and all rows are indexed. Vectors that are hard (at random in many dimensions) so get many probes rather than a low recall.

Equal vectors are one entry, which keeps as many of the smallest ids as could be asked for; so copies cost nothing. A bucket
of very many vectors is dealt to several tasks, all of which its queries ask.

Defined cases: vectors that are null, empty, zero, or have null or non-finite components, and rows with a null id, take no
part; vectors meet only those of their own length; a row that is repeated counts once; if one id has several vectors each
is a query and a candidate; an empty table, or no queries, give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import table, written

NEAREST = 10
TABLES = 8
#: Rotations that may name a bucket.
ROTATIONS = (1, 2, 3)
#: Queries that the number of probes is fitted on, at most.
SAMPLE = 256
#: Vectors that the share of rows in the probed buckets is estimated on, at most.
BACKGROUND = 2048
#: Share of the sample's true nearest that must be found.
TARGET = 0.96
#: Probes of a table at most, unless a bucket has only one axis; beyond them a kind of bucket isn't considered.
PROBES = 1024
#: Vectors of a bucket that go to one task, and components.
CROWDED, WIDE = 1 << 13, 1 << 20
#: Rows of a task.
PART = 1 << 14
#: Cells of the matrices that a task makes at once.
CELLS = 1 << 18
#: What a question to a bucket, or to a task of it, costs, in distances.
PROBE_COST = 4000
_SALTS = 16


def _padded(n: int) -> int:
    return 1 << (n - 1).bit_length()


def hadamard(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fast Walsh-Hadamard transform of each column, whose length is a power of two, and the other matrix, both overwritten."""
    n, width = len(x), 1
    while width < n:
        a, b = (m.reshape(n // (2 * width), 2, width, -1) for m in (x, y))
        np.add(a[:, 0], a[:, 1], out=b[:, 0])
        np.subtract(a[:, 0], a[:, 1], out=b[:, 1])
        x, y, width = y, x, 2 * width
    x /= np.sqrt(n)
    return x, y


@cache
def _signs(n: int, which: int) -> np.ndarray:
    return np.random.default_rng([n, which]).choice([-1.0, 1.0], (3, n))


def rotated(unit: np.ndarray, which: int) -> np.ndarray:
    """Columns turned by pseudo-rotation number ``which``, filled up with zeros to a power of two."""
    n = _padded(len(unit))
    x = np.zeros((n, unit.shape[1]))
    x[: len(unit)] = unit
    y = np.empty_like(x)
    for s in _signs(n, which):
        x *= s[:, None]
        x, y = hadamard(x, y)
    return x


def units(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)  # so that squares can't overflow
    scaled = vectors / top
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def axes(turned: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each column: twice its number, and one more if negative."""
    best = np.abs(turned).argmax(axis=0)
    return 2 * best + (turned[best, np.arange(len(best))] < 0)


def buckets(vectors: np.ndarray, rotations: int, tables: int = TABLES) -> np.ndarray:
    """The bucket of each vector in each table, as (vectors, tables)."""
    n = 2 * _padded(vectors.shape[1])
    out = np.zeros((len(vectors), tables), np.int64)
    step = max(1, CELLS // 4 // n)  # as much as stays in a processor's cache
    for a in range(0, len(vectors), step):
        unit, own = units(vectors[a : a + step]).T, out[a : a + step]
        for t in range(tables):
            for r in range(rotations):
                own[:, t] = own[:, t] * n + axes(rotated(unit, t * ROTATIONS[-1] + r))
    return out


def probed(vectors: np.ndarray, rotations: int, probes: int, tables: int = TABLES) -> np.ndarray:
    """The most likely buckets of each query in each table, best first, as (queries, tables, probes)."""
    n = 2 * _padded(vectors.shape[1])
    if len(vectors) > (step := max(16, CELLS // (2 * max(n, probes)))):  # bounds memory
        return np.concatenate([probed(vectors[a : a + step], rotations, probes, tables) for a in range(0, len(vectors), step)])
    unit, out = units(vectors), []
    for t in range(tables):
        name, cost = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for r in range(rotations):
            turned = rotated(unit.T, t * ROTATIONS[-1] + r).T
            near = np.stack([turned, -turned], axis=2).reshape(len(unit), n)
            gap = (near.max(axis=1, keepdims=True) - near) ** 2
            order = np.argsort(gap, axis=1, kind="stable")[:, :probes]
            i, j = np.divmod(np.arange(name.shape[1] * order.shape[1]), order.shape[1])
            first = (i + 1) * (j + 1) <= probes  # before any other come all those that are no worse in either part
            i, j = i[first], j[first]
            name, cost = name[:, i] * n + order[:, j], cost[:, i] + np.take_along_axis(gap, order, 1)[:, j]
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            name, cost = np.take_along_axis(name, best, 1), np.take_along_axis(cost, best, 1)
        out.append(name)
    return np.stack(out, axis=1)


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of each row to that of the other matrix."""
    top = np.maximum(np.abs(queries).max(axis=1), np.abs(vectors).max(axis=1))
    scale = np.where(top < 1e150, 1.0, top)
    return scale * np.sqrt(((vectors / scale[:, None] - queries / scale[:, None]) ** 2).sum(axis=1))


def _likely(queries: np.ndarray, vectors: np.ndarray, squares: np.ndarray, k: int) -> np.ndarray:
    """Which vectors may be among the ``k`` nearest of each query, by a product whose error is a small part of the squares."""
    if len(vectors) <= k:
        return np.ones((len(queries), len(vectors)), bool)
    with np.errstate(over="ignore", invalid="ignore"):
        own = (queries * queries).sum(axis=1)
        rough = (-2 * queries) @ vectors.T
        rough += squares * (1 + 1e-9)
        least, parts = rough, len(vectors) // 16
        if parts >= 4 * k:  # the least of parts tell almost as much as all
            least = rough[:, :parts].copy()
            for a in range(parts, 16 * parts, parts):
                np.minimum(least, rough[:, a : a + parts], out=least)
        edge = np.partition(least, k - 1, axis=1)[:, k - 1] + 2e-9 * own
        rough -= squares * 2e-9
        likely = rough <= edge[:, None]
        likely[~np.isfinite(own + squares.max())] = True
    return likely


def nearest(queries: np.ndarray, vectors: np.ndarray, squares: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, distance) of the ``k`` nearest of each query, nearest first, in pieces of whole queries; more if some are equally near."""
    step, pairs = max(1, CELLS // len(vectors)), max(1, CELLS // vectors.shape[1])
    for a in range(0, len(queries), step):
        who, at = np.nonzero(_likely(queries[a : a + step], vectors, squares, k))
        who += a
        exact = np.concatenate([distances(queries[who[b : b + pairs]], vectors[at[b : b + pairs]]) for b in range(0, len(who), pairs)])
        order = np.lexsort((exact, who))
        who, at, exact = who[order], at[order], exact[order]
        last = np.minimum(np.searchsorted(who, who) + k, np.searchsorted(who, who, "right")) - 1
        near = exact <= exact[last]
        yield who[near], at[near], exact[near]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def keyed(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(key, id, vector) of the rows that take part, each once; ``key`` is 128 bits that stand for the vector."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    own = df.select(F.col(vec_id).alias("id"), F.col(vector).cast(kind).alias("vector")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    own = own.withColumn("vector", F.transform("vector", lambda x: (x + 0).cast(kind[6:-1])))  # minus zero is zero
    half = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), F.col("vector").cast("array<double>"))), 16, "0")
    key = F.unhex(F.concat(half(1), half(2)))
    return own.withColumn("key", key).groupBy("key", "id").agg(F.first("vector").alias("vector"))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(key, vector, ids): each different vector with its ``k`` + 1 smallest ids.

    Copies are cut off before each shuffle, and first within salts, so that a vector with very many copies is no load.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    for by in (["key", "salt"], ["key"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("place") <= k + 1)
    return rows.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(zero_copy_only=False).astype(float), vectors.offsets.to_numpy()[:-1]
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


def _true_nearest(batches: Iterator[pa.RecordBatch], asked: dict[int, tuple[list[int], list[bytes], np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The nearest of this task to each query of the sample, but for the query's own vector."""
    best: dict[int, list[tuple[float, bytes, list[float]]]] = {}
    for batch in batches:
        keys, vectors = batch.column(0).to_pylist(), batch.column(1)
        for at, matrix in _by_length(vectors):
            squares = (matrix * matrix).sum(axis=1)
            if matrix.shape[1] not in asked:
                continue
            numbers, own, queries = asked[matrix.shape[1]]
            for piece in nearest(queries, matrix, squares, k + 1):
                met: dict[int, list[tuple[float, bytes, int]]] = {}
                for who, j, d in zip(*(x.tolist() for x in piece), strict=True):
                    if keys[at[j]] != own[who]:
                        met.setdefault(numbers[who], []).append((d, keys[at[j]], j))
                for q, found in met.items():
                    best[q] = sorted([*best.get(q, ()), *((d, key, matrix[j].tolist()) for d, key, j in sorted(found)[:k])])[:k]
    out = [(q, *x) for q, met in best.items() for x in met]
    q, d, key, vector = zip(*out, strict=True) if out else ((), (), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.float64()), pa.array(key, pa.binary()), pa.array(vector, pa.list_(pa.float64()))], names=["q", "d", "key", "vector"])


def fit(index: DataFrame, queries: DataFrame, k: int, target: float = TARGET) -> tuple[int, int]:
    """(rotations of a bucket's name, probes), from bounded samples of the queries and of the index."""
    sample = queries.select("key", "vector").orderBy(F.xxhash64("key")).limit(SAMPLE).collect()
    background = index.select("vector").orderBy(F.xxhash64("key", F.lit(1))).limit(BACKGROUND).collect()
    vectors = [np.array(r.vector, float) for r in sample]
    asked: dict[int, tuple[list[int], list[bytes], np.ndarray]] = {}
    for n in {len(v) for v in vectors}:
        at = [i for i, v in enumerate(vectors) if len(v) == n]
        asked[n] = at, [bytes(sample[i].key) for i in at], np.stack([vectors[i] for i in at])
    met = index.select("key", "vector").mapInArrow(partial(_true_nearest, asked=asked, k=k), "q long, d double, key binary, vector array<double>")
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d", "key"))).filter(F.col("place") <= k).select("q", "vector").collect()
    rows, kinds = index.count(), []
    for rotations in ROTATIONS:
        ranks, shares = [], []
        for n, (numbers, _, matrix) in asked.items():
            near = [(numbers.index(r.q), r.vector) for r in met if len(r.vector) == n]
            others = [r.vector for r in background if len(r.vector) == n]
            if not near or rotations > 1 and (2 * _padded(n)) ** rotations > rows:
                continue
            most = PROBES if rotations > 1 else 2 * _padded(n)
            names = probed(matrix, rotations, most)
            own = buckets(np.array([v for _, v in near], float), rotations)
            same = names[[q for q, _ in near]] == own[:, :, None]
            ranks += np.where(same.any(axis=2), same.argmax(axis=2), most).min(axis=1).tolist()
            if others:
                own = buckets(np.array(others, float), rotations)
                shares.append((names, own))
        if not ranks:
            continue
        probes = sorted(ranks)[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] + 1
        if rotations > 1 and probes > PROBES:
            continue
        hits = sum(int(np.isin(own[:, t], q[t, :probes]).sum()) for names, own in shares for q in names for t in range(TABLES))
        scanned = hits / max(1, sum(len(names) * len(own) for names, own in shares)) * rows
        kinds.append((scanned + PROBE_COST * (TABLES * probes + scanned / CROWDED), rotations, probes))
    return min(kinds)[1:] if kinds else (1, 1)


def _place(batches: Iterator[pa.RecordBatch], rotations: int, probes: int) -> Iterator[pa.RecordBatch]:
    """Adds ``names``: the buckets of each vector by table, or those that it probes."""
    rows = max(1, (1 << 20) // (TABLES * max(1, probes)))  # bounds memory
    for batch in (b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows)):
        found = [(at, probed(matrix, rotations, probes) if probes else buckets(matrix, rotations)[:, :, None]) for at, matrix in _by_length(batch.column("vector"))]
        widths = np.zeros(batch.num_rows, np.int64)
        for at, own in found:
            widths[at] = own.shape[2]
        ends = np.cumsum(np.repeat(widths, TABLES))
        names = np.zeros(ends[-1], np.int64)
        for at, own in found:
            first = ends[at * TABLES] - own.shape[2]
            names[first[:, None] + np.arange(TABLES * own.shape[2])] = own.reshape(len(own), -1)
        own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(names))
        own = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * TABLES, pa.int32()), own)
        yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "names"])


def _placed(df: DataFrame, rotations: int, probes: int = 0) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(partial(_place, rotations=rotations, probes=probes), f"{kinds}, names array<array<bigint>>")


def _by_bucket(placed: DataFrame, *columns: str) -> DataFrame:
    """A row for each bucket, with its vector's length, table and name."""
    rows = placed.select(*columns, F.size("vector").alias("length"), F.posexplode("names").alias("table", "own"))
    return rows.select(*columns, "length", "table", F.explode("own").alias("name"))


def _numbers(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    return np.unique(np.array([*ids.to_pylist(), None], object)[:-1], return_inverse=True)[1]


def _met(queries: np.ndarray, vectors: np.ndarray, squares: np.ndarray, ids: pa.ListArray, marks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(how many found, distances, ids, marks): the ``k`` nearest of each query, ties to the smaller id."""
    offsets, out = ids.offsets.to_numpy(), []
    for who, at, exact in nearest(queries, vectors, squares, k):
        sizes = np.diff(offsets)[at]
        flat = np.repeat(offsets[:-1][at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        who, exact, own, mark = np.repeat(who, sizes), np.repeat(exact, sizes), ids.values.take(pa.array(flat)), np.repeat(marks[at], sizes)
        order = np.lexsort((mark, _numbers(own), exact, who))
        order = order[np.arange(len(who)) - np.searchsorted(who, who) < k]  # who ascends before and after
        out.append((who[order], exact[order], own.take(pa.array(order)), mark[order]))
    who, exact, own, mark = zip(*out, strict=True)
    return np.bincount(np.concatenate(who), minlength=len(queries)), np.concatenate(exact), pa.concat_arrays(own), np.concatenate(mark)


def _rank(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, its vectors first: the nearest of the bucket for each of its queries."""
    at, parts, bucket = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).to_numpy() for c in ("length", "table", "name", "cut")], axis=1)
        asks, keys, ids = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("key"), batch.column("ids")
        vectors = batch.column("vector")
        starts, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
        matrix = lambda a, b: flat[starts[a] : starts[b]].astype(float).reshape(b - a, -1)  # noqa: B023, E731
        edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        who, found = [], []
        for first, end in pairwise(edges):
            if first or tuple(place[0].tolist()) != at:
                parts, bucket = [], None
            if not asks[end - 1] and end < batch.num_rows:
                continue
            asked = first + int(np.searchsorted(asks[first:end], True))
            if asked > first:
                marks = np.frombuffer(b"".join(keys.slice(first, asked - first).to_pylist()), np.int64)[::2]
                parts.append((matrix(first, asked), ids.slice(first, asked - first), marks))
            if asked == end or not parts:
                continue
            if bucket is None:
                own = np.concatenate([p[0] for p in parts])
                with np.errstate(over="ignore"):
                    bucket = own, (own * own).sum(axis=1), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            found.append(_met(matrix(asked, end), *bucket, k + 1))
            who.append(np.arange(asked, end))
        at = tuple(place[-1].tolist())
        if found:
            sizes, d, own, marks = zip(*found, strict=True)
            ends = pa.array(np.cumsum(np.concatenate([[0], *sizes])), pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(d)), pa.concat_arrays(own), pa.array(np.concatenate(marks))], names=["d", "id", "mark"])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(who))), pa.ListArray.from_arrays(ends, pairs)], names=["key", "near"])


def merged(near: DataFrame, k: int) -> DataFrame:
    """(key, near): the ``k`` nearest of each key from all that its buckets gave.

    A vector is found once a table at most, so so many times ``k`` hold them; only of these are copies left out, as that
    compares all pairs.
    """
    first = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, TABLES * k)
    return near.groupBy("key").agg(F.slice(F.array_distinct(first), 1, k).alias("near"))


def search(df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, target: float = TARGET) -> DataFrame:
    """(query_id, rank, <vec_id>, score): the ``k`` nearest found of each query, but its own row, ties to the smaller id."""
    index = written(entries(keyed(df, vec_id, vector), k), "entries")
    asked = written(keyed(queries, vec_id, vector), "queries")
    distinct = written(asked.groupBy("key").agg(F.first("vector").alias("vector")), "asked")
    rotations, probes = fit(index, distinct, k, target)
    stored = written(_placed(index, rotations), "stored")
    bucket = ["length", "table", "name"]
    most = F.greatest(F.lit(1), F.least(F.lit(CROWDED), F.floor(F.lit(WIDE) / F.col("length"))))
    crowded = _by_bucket(stored).groupBy(*bucket).count().filter(F.col("count") > most).select(*bucket, F.ceil(F.col("count") / most).cast("int").alias("cuts"))
    crowded = F.broadcast(written(crowded, "crowded"))  # a row for thousands
    cuts = F.coalesce("cuts", F.lit(1))
    ids = stored.schema["ids"].dataType.simpleString()
    dealt = _by_bucket(stored, "key", "vector", "ids").join(crowded, bucket, "left")
    dealt = dealt.select(*bucket, F.pmod(F.hash("key"), cuts).alias("cut"), F.lit(False).alias("asks"), "key", "vector", "ids")
    probing = _by_bucket(_placed(distinct, rotations, probes), "key", "vector").join(crowded, bucket, "left")
    probing = probing.select(*bucket, F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"), F.lit(True).alias("asks"), "key", "vector", F.lit(None).cast(ids).alias("ids"))
    place = [*bucket, "cut"]
    parts = max(index.count() * TABLES, distinct.count() * TABLES * probes) // PART + 1
    met = dealt.unionByName(probing).repartition(parts, *place).sortWithinPartitions(*place, "asks")
    near = met.mapInArrow(partial(_rank, k=k), f"key binary, near array<struct<d:double,id:{ids[6:-1]},mark:bigint>>")
    best = merged(near, k + 1)
    others = F.filter("near", lambda x: (x["id"] != F.col("id")) | (x["d"] > 0))
    ranked = asked.select("key", "id").join(best, "key").select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("place", "found"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("found.id").alias(vec_id), F.col("found.d").alias("score"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
