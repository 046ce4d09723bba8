"""LM scoring: corpus counts over all training texts, and a gated recurrent model trained and applied in parallel.

Counts: every word (A-Z lower-cased, runs of anything but ASCII white space) and an end after each text, summed over all
training rows. The base score is the smoothed unigram log10-probability.

Model: a GRU gives the class of the next token; a frequent word then has a softmax within its class, any other token the
smoothed share of its count within its tail class (by length, letters and last character), where unknown tokens have one
share. So the probabilities of all tokens sum to one. Training: texts are dealt to shards by a hash of the row, about
``SHARD`` tokens each; a first model is trained on at most ``SHARD`` tokens of the first shard; from it every shard trains
on all its texts, in the order of their hashes, and the weights are averaged by tokens. So the model doesn't depend on how
the input is split. What reaches the driver is the ``FREQUENT`` most frequent words, sums by tail class and the weights,
all of fixed size.

Scoring: distinct texts are dealt to blocks of bounded size; each block's distinct words meet their counts in one join, and
the block is scored as a whole, the state running through each complete text. Rows meet their text's score by 128 bits of the text.

Defined cases: null or empty text is an end alone; rows with null id are training rows; without training rows N and V are 0,
nothing is known, every share is that of an unknown token; repeated rows count each, train the network once and are scored
each; other columns may be kept, but those named like a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import gru
from codeloom.llm.common import fresh, table, written
from codeloom.llm.wordcut import Seen, Words, groups

#: A word that no text has, as words hold no white space.
END = b"\n"
FREQUENT = 512
PER_CLASS = 64
TAILS = 16
BUCKETS = 256
#: Characters of text in a block.
BLOCK_CHARS = 20 << 20
#: Up to so many blocks are dealt one to a partition; among more, chance evens them out.
EVEN_BLOCKS = 4096
LANES = 384
#: If a block would get more characters, as copies of a text do that all go to one, each text is sent once.
BLOCK_MOST = 3 * BLOCK_CHARS
#: Tokens of a shard, and tokens trained on at once.
SHARD = 1 << 20


def tail_class(word: bytes) -> int:
    """By length in bytes, by having other than ASCII, and by a last byte other than a letter."""
    last = word[-1]
    return min((len(word) - 1) // 3, 3) * 4 + 2 * (not word.isascii()) + (last < 128 and not (97 <= last <= 122))


class Coder:
    """Numbers of words: input, class, and word within the frequent ones (-1: tail)."""

    def __init__(self, frequent: list[bytes]) -> None:
        """``frequent``: the end, then the most frequent words."""
        self.n_words = len(frequent)
        self.n_inner = -(-len(frequent) // PER_CLASS)
        self.sizes = gru.shapes(len(frequent) + BUCKETS, self.n_inner + TAILS, len(frequent), PER_CLASS)
        self.frequent = Seen()
        self.frequent.add(Words(frequent[1:]).keys())

    def numbers(self, words: Words) -> np.ndarray:
        """Input and class as one number below 2**15: that of a frequent word, else bucket and tail class after them. The
        end's number is 0."""
        n, last = words.ends - words.starts, words.last(1)
        buckets = ((words.last(3) << 16) | (words.last(2) << 8) | last) % 251 % BUCKETS
        tails = np.minimum((n - 1) // 3, 3) * 4 + 2 * words.wide() + ((last < 128) & ~((97 <= last) & (last <= 122)))
        found = self.frequent.find(words.keys())
        return np.where(found >= 0, found + 1, self.n_words + buckets * TAILS + tails).astype(np.int16)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input, class and word by number."""
        f, tail = np.arange(self.n_words), np.arange(BUCKETS * TAILS)
        inputs = np.concatenate([f, self.n_words + tail // TAILS])
        classes = np.concatenate([f // PER_CLASS, self.n_inner + tail % TAILS])
        return inputs.astype(np.int16), classes.astype(np.int16), np.concatenate([f, np.full(len(tail), -1)]).astype(np.int16)

    @staticmethod
    def shifted(inputs: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The input before each token, that of the end where a text opens."""
        before = np.empty_like(inputs)
        before[1:] = inputs[:-1]
        before[opens] = 0
        return before


def with_ends(values: np.ndarray, counts: np.ndarray, end: float) -> tuple[np.ndarray, np.ndarray]:
    """Values of words with one for an end after each text, and where each text begins."""
    stops = np.cumsum(counts + 1)
    out = np.empty(len(values) + len(counts), values.dtype)
    at = np.ones(len(out), bool)
    at[stops - 1] = False
    out[at], out[~at] = values, end
    return out, stops - counts - 1


def count_words(docs: DataFrame) -> DataFrame:
    """(word, tail, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words, counts, n_texts = Seen(), [], np.zeros(0, np.int64), 0
        for batch in batches:
            for texts in groups(batch.column(0).to_pylist()):
                n_texts += len(texts)
                own = Words(texts)
                keys, first, n = np.unique(own.keys(), return_index=True, return_counts=True)
                known = seen.find(keys)
                counts[known[known >= 0]] += n[known >= 0]
                new = known < 0
                seen.add(keys[new])
                words += own.take(first[new])
                counts = np.concatenate([counts, n[new]])
                if len(words) > 400_000:
                    yield emit(words, counts)
                    seen, words, counts = Seen(), [], np.zeros(0, np.int64)
        yield emit([*words, END], np.append(counts, n_texts))

    def emit(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        tails = [-1 if w == END else tail_class(w) for w in words]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(tails, pa.int32()), pa.array(counts)], names=["word", "tail", "n"])

    return docs.select("text").mapInArrow(run, "word binary, tail int, n long").filter("n > 0").groupBy("word", "tail").agg(F.sum("n").alias("n"))


def dealt(spark: SparkSession, df: DataFrame, n: int, name: str) -> DataFrame:
    """Rows dealt by the column ``name`` (0 to n - 1): each value a partition of its own up to ``EVEN_BLOCKS`` values."""
    if n > EVEN_BLOCKS:
        return df.repartition(max(EVEN_BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions"))), name)
    if n > 1:
        df = df.withColumn(name, F.element_at(F.lit(even_keys(spark, n)), F.col(name) + 1))
    return df.repartition(n, name)


def code_texts(docs: DataFrame, coder: Coder) -> DataFrame:
    """(shard, k1, k2, numbers) of rows (shard, k1, k2, text); a row met before in a task is left out."""
    sent = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = sent.value, set()
        for batch in batches:
            at, out = [], []
            for k, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    at.append(k)
            rows = batch.take(pa.array(at, pa.int64()))
            for texts in groups(rows.column(3).to_pylist()):
                words = Words(texts)
                numbers, begins = with_ends(own.numbers(words), words.counts, 0)
                data, cuts = numbers.tobytes(), [*(2 * begins).tolist(), 2 * len(numbers)]
                out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(out, pa.binary())], names=["shard", "k1", "k2", "numbers"])

    return docs.select("shard", "k1", "k2", "text").mapInArrow(run, "shard int, k1 long, k2 long, numbers binary")


def train_weights(docs: DataFrame, coder: Coder, weights: np.ndarray, rate: float, n_shards: int, most: int | None = None) -> np.ndarray:
    """One pass over all texts of each shard (of ``most`` tokens, if given) from these weights; the average by tokens."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((weights, coder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value[1]
        tables = own.tables()
        total, seen = np.zeros(len(sent.value[0])), 0
        shard = key = params = None
        held, opens, size, taken = [], [], 0, 0

        def learn() -> None:
            numbers, first = np.concatenate(held), np.zeros(size, bool)
            first[opens] = True
            inputs, classes, words = (x[numbers] for x in tables)
            gru.train(params, own.shifted(inputs, first), first, classes, words, rate, LANES)

        for batch in batches:
            for s, *k, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if s != shard:
                    if size:
                        learn()
                    if taken:
                        total += gru.flat(params).astype(np.float64) * taken
                    shard, key, params = s, None, gru.unflat(sent.value[0].copy(), own.sizes)
                    held, opens, size, taken = [], [], 0, 0
                if k == key or most is not None and taken >= most:
                    continue
                key, numbers = k, np.frombuffer(data, np.int16)
                if most is not None:
                    numbers = numbers[: most - taken]
                held.append(numbers)
                opens.append(size)
                size += len(numbers)
                taken += len(numbers)
                seen += len(numbers)
                if size >= SHARD:
                    learn()
                    held, opens, size = [], [], 0
        if size:
            learn()
        if taken:
            total += gru.flat(params).astype(np.float64) * taken
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), float(seen)))], names=["i", "x", "n"])

    coded = dealt(spark, code_texts(docs, coder), n_shards, "shard").sortWithinPartitions("shard", "k1", "k2")
    sums = coded.mapInArrow(run, "i int, x double, n double").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = weights.astype(np.float64)
    for r in sums.collect():  # as many rows as the model has weights
        out[r.i] = r.x / r.n
    return out.astype(np.float32)


def first_weights(coder: Coder, frequent: np.ndarray, tails: np.ndarray) -> dict[str, np.ndarray]:
    """A model that gives every token about its share among all tokens, whatever came before."""
    params = gru.start(coder.sizes)
    padded = np.zeros(coder.n_inner * PER_CLASS)
    padded[: len(frequent)] = frequent
    padded = padded.reshape(coder.n_inner, PER_CLASS)
    shares = np.concatenate([padded.sum(axis=1), tails])
    params["out"][-1] = np.log(shares / shares.sum())
    params["inner"][:, -1] = np.log(np.maximum(padded / padded.sum(axis=1, keepdims=True), 1e-9))
    return params


def learn(docs: DataFrame, doc_id: str) -> tuple[Coder, np.ndarray, DataFrame, dict]:
    """The coder, the weights, the count table and its totals, from training rows (doc_id, text)."""
    counts = written(count_words(docs), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    best = counts.filter("tail >= 0").orderBy(F.desc("n"), "word").limit(FREQUENT - 1).select("word", "tail", "n").collect()
    coder = Coder([END, *(bytes(r.word) for r in best)])
    mass = np.full(TAILS, 0.5)
    for r in counts.filter("tail >= 0").groupBy("tail").agg(F.sum(F.col("n") + 0.5).alias("m")).collect():
        mass[r.tail] += r.m
    for r in best:
        mass[r.tail] -= r.n + 0.5
    ends = counts.filter("tail = -1").agg(F.max("n")).first()[0] or 0
    weights = gru.flat(first_weights(coder, np.array([ends, *(r.n for r in best)], np.float64) + 0.5, mass))
    n_shards = max(1, math.ceil((total.n or 0) / SHARD))
    k1, k2 = F.xxhash64(F.col(doc_id), F.col("text")), F.xxhash64(F.lit(1), F.col("text"), F.col(doc_id))
    rows = docs.select(F.pmod(k1, F.lit(n_shards)).cast("int").alias("shard"), k1.alias("k1"), k2.alias("k2"), "text")
    weights = train_weights(rows.filter("shard = 0"), coder, weights, 0.02, n_shards, SHARD)
    weights = train_weights(rows, coder, weights, 0.005, n_shards)
    return coder, weights, counts, {"n": total.n or 0, "v": total.v, "mass": mass}


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of n partitions, which Spark's hash deals to just that partition; so no task gets several blocks."""
    keys = spark.range(n * 24).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    found = {r.p: r.k for r in keys.collect()}  # n rows
    return [found.get(p, p) for p in range(n)]


def text_keys(text: Column) -> list[Column]:
    """128 bits of a text."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(1), whole)]


def score_texts(df: DataFrame, learned: tuple[Coder, np.ndarray, DataFrame, dict], doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, train_tokens, base_score, score."""
    coder, weights, counts, totals = learned
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in ([doc_id] if keep is None else keep) if c not in made]
    spark = df.sparkSession
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / BLOCK_CHARS))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each text in a task."""
        seen: set[tuple] = set()
        for batch in batches:
            at = []
            for k, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    at.append(k)
            yield batch if len(at) == batch.num_rows else batch.take(pa.array(at, pa.int64()))

    keys = text_keys(F.col(text))
    rows = df.select(F.pmod(keys[0], F.lit(n_blocks)).cast("int").alias("block"), keys[0].alias("k1"), keys[1].alias("k2"), F.col(text).alias("text"))
    most = rows.groupBy("block").agg(F.sum(F.length("text")).alias("chars")).agg(F.max("chars")).first()[0] or 0
    if most > BLOCK_MOST:  # first once from every task, then once at all
        rows = rows.mapInArrow(once, "block int, k1 long, k2 long, text string").dropDuplicates(["k1", "k2"])
    docs = dealt(spark, rows, n_blocks, "block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, Seen] = {}
        for batch in batches:
            blocks, texts = batch.column(0).to_numpy(), batch.column(1)
            for block in np.unique(blocks).tolist():
                for group in groups(texts.take(pa.array(np.flatnonzero(blocks == block))).to_pylist()):
                    if block not in met and len(met) >= 4 or block in met and len(met[block]) > 1_000_000:
                        met.clear()  # a word twice in a block does no harm
                    seen, words = met.setdefault(block, Seen()), Words(group)
                    keys, first = np.unique(words.keys(), return_index=True)
                    new = seen.find(keys) < 0
                    seen.add(keys[new])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(new.sum()), block, np.int32)), pa.array(words.take(first[new]), pa.binary())], names=["block", "word"])

    met = docs.select("block", "text").mapInArrow(distinct, "block int, word binary").join(counts.select("word", "n").hint("shuffle_hash"), "word")
    end_count = counts.filter("tail = -1").agg(F.max("n")).first()[0] or 0
    sent = spark.sparkContext.broadcast((weights, coder, totals, end_count))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        weights, own, totals, end_count = sent.value
        params, tables = gru.unflat(weights, own.sizes), own.tables()
        keys: dict[tuple[int, int], int] = {}
        once = []  # each text once
        for chunk in left.select(["k1", "k2"]).to_batches():
            for key in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                once.append(key not in keys)
                keys.setdefault(key, len(keys))
        texts = left.column("text").filter(pa.array(once, pa.bool_()))
        known = Seen()
        word_keys, first = np.unique(Words(right.column("word").to_pylist()).keys(), return_index=True)
        known.add(word_keys)
        # logarithms of the smoothed counts: of the known words, of an unknown one
        n = np.append(right.column("n").to_numpy()[first], 0) if len(first) else np.zeros(1)
        log_n = np.log10(n + 0.5)
        log_end, log_all, log_mass = np.log10(end_count + 0.5), np.log10(totals["n"] + 0.5 * (totals["v"] + 1)), np.log10(totals["mass"])
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for chunk in texts.chunks:
            for group in groups(chunk.to_pylist()):
                words = Words(group)
                at = known.find(words.keys())
                for to, (values, end) in zip(parts, ((own.numbers(words), 0), (log_n[at], log_end), (n[at] > 0, end_count > 0)), strict=False):
                    to.append(with_ends(values, words.counts, end)[0])
                parts[3].append(words.counts + 1)
        numbers, logs, is_known, lengths = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(parts, (np.int16, float, bool, np.int64), strict=True))
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        opens = np.zeros(len(numbers), bool)
        opens[np.cumsum(lengths) - lengths] = True
        inputs, classes, words = (x[numbers] for x in tables)
        tail = np.flatnonzero(words < 0)
        inner = np.bincount(doc[tail], logs[tail] - log_mass[classes[tail] - own.n_inner], len(lengths))
        scores = gru.score(params, lengths, own.shifted(inputs, opens), classes, words) / math.log(10)
        base = np.bincount(doc, logs, len(lengths)) - lengths * log_all
        columns = [pa.array(lengths), pa.array(np.bincount(doc, is_known, len(lengths)).astype(np.int64)), pa.array(base), pa.array(scores + inner)]
        k1, k2 = ([k[i] for k in keys] for i in (0, 1))
        return pa.Table.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), *columns], names=["k1", "k2", "n_tokens", "n_known", "base_score", "score"])

    scored = docs.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(run, "k1 long, k2 long, n_tokens long, n_known long, base_score double, score double")
    k1 = fresh([*keep, *made], "k1")
    k2 = fresh([*keep, *made, k1], "k2")
    out = df.select(*keep, *(c.alias(n) for c, n in zip(text_keys(F.col(text)), (k1, k2), strict=True))).join(scored.withColumnsRenamed({"k1": k1, "k2": k2}), [k1, k2])
    return out.withColumn("train_tokens", F.lit(totals["n"]).cast("bigint")).select(*keep, *made)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    docs = docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))
    learned = learn(docs.filter("not held_out").select("doc_id", "text"), "doc_id")
    return score_texts(docs, learned, keep=["doc_id", "held_out"])
