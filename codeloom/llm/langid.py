"""Language ID by rank-order profiles: out-of-place distance between n-gram ranks.

Letters are lower-cased one by one and kept as code points, as are the combining marks that follow them (vowel signs, accents
written apart); every run of anything else is one space, and a text has a space before and after it. N-grams have one to three code points, single spaces left out; three code points fit in one number. A
language's profile holds the ranks of its ``size`` most frequent n-grams over all training texts; a text is compared by the
ranks of its own ``size`` most frequent n-grams, an n-gram that a profile lacks counting ``size``, as does a greater
difference. The least distance wins; ties go to the smaller n-gram (as a number), then to the smaller language.

The score is 1 - distance/worst, worst being ``size`` for each n-gram of the text, so between 0 and 1.

Profiles are a table of one row for each language. They reach the tasks in blocks of ``LANGUAGES`` languages (2.4 MB), by
one pass over the texts, in which every block improves on the best language so far.

Defined cases: null text, text without a letter, or no profile at all: ``und`` with score 0; rows without language or text
don't train; repeated rows count each time in training; a text of any length is counted in pieces of bounded size that carry
the last two code points over, so that the counts are those of the whole; other columns may be kept, but those named like
a result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, table, written

SIZE = 300
#: Languages whose profiles a pass holds.
LANGUAGES = 1024
SPACE = 32
#: Tells a combining mark from a letter until it is known what it follows.
MARK = 1 << 24
#: Texts are counted in pieces of so many characters, which bounds memory.
PIECE = 1 << 20
#: Distinct n-grams of a language held by a task before they are handed over.
HELD = 1 << 21


class Letters:
    """Code points as lower-case letters, marks or spaces, learned from Python's own tables as they occur."""

    def __init__(self) -> None:
        self.known = np.full(0x110000, -1, np.int32)

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.known[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                c = chr(p)
                self.known[p] = ord(c.lower()[0]) if c.isalpha() else p | MARK if unicodedata.category(c)[0] == "M" else SPACE
            out = self.known[points]
        return out


def after_letters(own: np.ndarray, begun: bool) -> np.ndarray:
    """Marks that follow a letter, or marks that do, are kept; others are spaces. ``begun``: a letter or mark stands before."""
    mark = own >= MARK
    if not mark.any():
        return own
    last = np.maximum.accumulate(np.where(mark, -1, np.arange(len(own))))
    follows = np.where(last >= 0, own[last] != SPACE, begun)
    return np.where(mark, np.where(follows, own & (MARK - 1), SPACE), own).astype(own.dtype)


def pieces(letters: Letters, text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text as numbers, by pieces; none if there is no letter."""
    before = np.array([SPACE], np.int32)  # what the last piece left: its last two symbols, or the space at the start
    seen = False
    for at in range(0, len(text) + 1, PIECE):
        own = after_letters(letters.of(text[at : at + PIECE]), bool(before[-1] != SPACE)) if at < len(text) else np.zeros(0, np.int32)
        if at + PIECE > len(text):
            own = np.append(own, np.int32(SPACE))
        seen = seen or bool((own != SPACE).any())
        x = np.concatenate([before, own])
        gap = x == SPACE
        keep = np.ones(len(x), bool)
        keep[len(before) :] = ~(gap[len(before) :] & gap[len(before) - 1 : -1])
        x = x[keep].astype(np.int64)
        new = x[len(before) :]  # n-grams end at one of these
        two = (x[:-1] << 21) | x[1:]
        three = (two[:-1] << 21) | x[2:]
        out = np.concatenate([new[new != SPACE], two[len(before) - 1 :], three])
        before = x[-2:].astype(np.int32)
        if seen:
            yield out


def counted(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams with their counts."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in parts:
        own, n = np.unique(part, return_counts=True)
        grams, counts = (own, n) if not len(grams) else added(np.concatenate([grams, own]), np.concatenate([counts, n]))
    return grams, counts


def added(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first)


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by n-gram."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


class Totals:
    """Counts of the n-grams of a language; sorted in large lots."""

    def __init__(self) -> None:
        self.grams, self.counts, self.held, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, grams: np.ndarray) -> None:
        self.held.append(grams)
        self.size += len(grams)
        if self.size > 4 * PIECE:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            own, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.grams, self.counts = added(np.concatenate([self.grams, own]), np.concatenate([self.counts, n]))
            self.held, self.size = [], 0
        return self.grams, self.counts


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, grams) for each language, over all rows with text and language; the n-grams are in order of rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, totals = Letters(), {}
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k not in totals and len(totals) >= 64:  # many languages: hand over what there is
                    yield from emit(totals)
                    totals = {}
                total = totals.setdefault(k, Totals())
                for g in pieces(letters, t):
                    total.add(g)
                if len(total.grams) > HELD:
                    yield from emit({k: totals.pop(k)})
        yield from emit(totals)

    def emit(totals: dict) -> Iterator[pa.RecordBatch]:
        for k, total in totals.items():
            grams, counts = total.settle()
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    rows = df.select(F.col(text).alias("t"), F.col(lang).alias("k")).filter("t is not null and k is not null")
    sums = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = sums.withColumn("place", place).filter(F.col("place") <= size)
    return best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("grams"))


def predict(df: DataFrame, profiles: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; ``profiles`` as :func:`learn_profiles` gives them."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    own = fresh(keep, "text_")
    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"{own} string", "lang_pred string, score double"])

    def better(block: list[tuple[str, list[int]]]):
        names = [k for k, _ in block]
        every = np.unique(np.concatenate([np.array(g, np.int64) for _, g in block]))
        ranks = np.full((len(names), len(every) + 1), size * 4, np.int32)  # the last column: an n-gram that no profile has
        for i, (_, grams) in enumerate(block):
            ranks[i, np.searchsorted(every, np.array(grams, np.int64))] = np.arange(len(grams))
        sent = df.sparkSession.sparkContext.broadcast((names, every, ranks))  # LANGUAGES profiles at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, every, ranks = sent.value
            letters = Letters()
            for batch in batches:
                said, scores = batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist()
                for k, t in enumerate(batch.column(own).to_pylist()):
                    top = top_grams(*counted(pieces(letters, t or "")), size)
                    if not len(top):
                        continue
                    at = np.minimum(np.searchsorted(every, top), len(every) - 1)
                    at = np.where(every[at] == top, at, len(every))
                    away = np.minimum(np.abs(ranks[:, at] - np.arange(len(top))), size).sum(axis=1)
                    best = int(away.argmin())
                    score = 1.0 - float(away[best]) / (size * len(top))
                    if said[k] == "und" or score > scores[k]:  # equal ones: the block before has the smaller languages
                        said[k], scores[k] = names[best], score
                columns = [*(batch.column(c) for c in [*keep, own]), pa.array(said, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, own, "lang_pred", "score"])

        return run

    out = df.select(*keep, df[text].alias(own), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for block in blocks_of(profiles):
        out = out.mapInArrow(better(block), kinds)
    return out.drop(own)


def blocks_of(profiles: DataFrame) -> Iterator[list[tuple[str, list[int]]]]:
    """Profiles by language, in blocks; one is on the driver at a time."""
    block: list[tuple[str, list[int]]] = []
    for r in written(profiles, "profiles").orderBy("lang").toLocalIterator():
        block.append((r.lang, r.grams))
        if len(block) == LANGUAGES:
            yield block
            block = []
    if block:
        yield block


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    profiles = learn_profiles(docs.filter("not held_out"))
    return predict(docs, profiles, keep=["doc_id", "held_out"])


#: CRC-32 of the id in decimals, bit by bit: a number is a byte to be added, -1 a step.
CRC32_SQL = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), "
    "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
)
OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, lang, coalesce({CRC32_SQL} % 4 = 2, false) AS held_out FROM documents
), s AS (
  SELECT r, list_transform(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '([^\p{{L}}\p{{M}}]\p{{M}}*)+', ' ', 'g'), '(?s).'), lambda c: unicode(c)::BIGINT) AS x FROM d WHERE regexp_matches(text, '\p{{L}}')
), g AS (
  SELECT r, unnest(list_concat(list_filter(x, lambda v: v <> 32), list_transform(range(1, len(x)), lambda i: x[i] * 2097152 + x[i + 1]),
    list_transform(range(1, len(x) - 1), lambda i: (x[i] * 2097152 + x[i + 1]) * 2097152 + x[i + 2]))) AS gram FROM s
), c AS (
  SELECT r, gram, count(*) AS n FROM g GROUP BY r, gram
), own AS (
  SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS place FROM c QUALIFY place < 300
), total AS (
  SELECT lang, gram, sum(n) AS n FROM c JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram
), p AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS place FROM total QUALIFY place < 300
), away AS (
  SELECT own.r, l.lang, sum(least(coalesce(abs(own.place - p.place), 300), 300)) AS away, count(*) AS k
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = own.gram GROUP BY own.r, l.lang
), best AS (
  SELECT r, lang, away, k FROM away QUALIFY row_number() OVER (PARTITION BY r ORDER BY away, lang) = 1
)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - away::DOUBLE / (300 * k), 0)::DOUBLE AS score FROM d LEFT JOIN best ON best.r = d.r
"""
