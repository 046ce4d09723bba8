"""Spelling variants: words that differ by one letter, matched in half from the front or from the back.

If two words differ by one letter inserted, deleted or replaced, then either the first half of the one begins the other, or
its second half ends it. So each word is looked up twice: in a minimal automaton of the words as they are, where its first
half is followed exactly and the rest completed with one error, and in one of the words read backwards, where its second
half is. What the first lookup has found is left out of the second. Automata number their words, so a match is a number and
its count and spelling are looked up by it.

A word is stored under its half of each length that a word one letter shorter, as long or one letter longer would follow,
and asks under its own. Words of equal halves meet in one automaton, those of many halves share one; a half that more than
``CROWDED`` words have is dealt to several automata, all of which are asked. Automata are built from rows that Spark has
sorted, and the words that ask stream past them, so a task holds one automaton whatever the number of words. Matches never
leave the task: a word gets their number and the best of them, and these are added up.

Words that aren't frequent by themselves are led to the form they vary: the near word of the largest count, if that is
``ratio`` times the word's. The root is where the chain of forms ends; counts grow by that ratio with each step, so that a
few doublings of the links reach it.

Defined cases: null or empty text has no words; a null id counts as an empty one; rows that are repeated count each time;
no words at all give an empty table; of near words of equal count the first in code-point order is the form; other columns
are ignored. Memory follows the longest word, at some hundred bytes a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.automaton import Automaton
from codeloom.llm.common import ascii_lower, table, written

LETTERS = r"A-Za-zÀ-ÿ"
#: Letters of a word at least.
LEAST = 7
#: Occurrences of a word at least.
OFTEN = 2
#: One run in so many loses a letter.
DAMAGED = 31
#: How many times as frequent a form must be.
RATIO = 10
#: Words for which there is one more automaton of each half length.
PART = 1 << 15
#: Words of one half that may go to the same automaton.
CROWDED = 1 << 14


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, often: int = OFTEN, damaged: int | None = None) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``least`` letters that occur ``often`` times at least.

    With ``damaged``, a run loses a letter where the CRC-32 of id, colon and run is a multiple of it.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), 0)  # shorter runs can't match
    found = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(ascii_lower(F.col("run")))
    found = found.select("id", word.alias("word"))
    if damaged:
        found = found.withColumn("crc", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        place = (F.col("crc") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), place), F.substr("word", place + 2))
        found = found.select(F.when(F.col("crc") % damaged == 0, cut).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _half(length: Column, back: bool) -> Column:
    """Letters that are followed exactly."""
    front = F.shiftright(length, 1)
    return length - front if back else front


def _entries(words: DataFrame, least: int) -> DataFrame:
    """(word, n, back, size, asks, spelled, place): a word under each half it can be met by, and where it asks itself."""
    length = F.length("word")
    kinds = [F.struct(F.lit(back).alias("back"), _half(length + more, back).alias("size"), F.lit(asks).alias("asks")) for back in (False, True) for more, asks in ((-1, False), (0, False), (1, False), (0, True))]
    met = F.filter(F.array_distinct(F.array(*kinds)), lambda k: k["size"] >= F.when(k["back"], least - least // 2).otherwise(least // 2))
    rows = words.select("word", "n", F.explode(met).alias("kind")).select("word", "n", "kind.*")
    rows = rows.withColumn("spelled", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    return rows.withColumn("place", F.xxhash64("back", "size", F.substr("spelled", F.lit(1), F.col("size"))))


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by automaton, those to store first: for each word that asks, its near words' number and the best."""
    at, stored, counts, automaton = None, [], [], None
    for batch in batches:
        out: list[tuple] = []
        for group, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[:3]):
            if group != at:
                at, stored, counts, automaton = group, [], [], None
            back, size, _ = group
            for _, _, _, asks, spelled, n in rows:
                if not asks:
                    stored.append(spelled)
                    counts.append(n)
                    continue
                if automaton is None:
                    automaton = Automaton(stored)
                near = automaton.one_error(spelled, size)
                if back and near:  # those whose first half agrees too were found from the front
                    front = spelled[size - len(spelled) :]
                    near = [k for k in near if not stored[k].endswith(front)]
                if near:
                    most = max(counts[k] for k in near)
                    best = [stored[k] for k in near if counts[k] == most]
                    out.append((spelled[::-1], len(near), most, min(b[::-1] for b in best)) if back else (spelled, len(near), most, min(best)))
        word, near_words, most, form = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near_words, pa.int64()), pa.array(most, pa.int64()), pa.array(form, pa.string())], names=["word", "n_near", "most", "form"])


def near_words(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n_near, most, form) of the words that have a near one: how many, and the most frequent. ``words``: (word, n), a table."""
    parts = words.count() // PART + 1
    entries = _entries(words, least)
    crowded = entries.filter("not asks").groupBy("place").count().filter(F.col("count") > CROWDED)
    crowded = crowded.select("place", F.ceil(F.col("count") / CROWDED).cast("int").alias("cuts"))
    placed = entries.join(crowded, "place", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("cuts")))
    cuts = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("cuts") - 1).cast("array<bigint>")).otherwise(own)
    part = F.array_distinct(F.transform(cuts, lambda cut: F.pmod(F.xxhash64("place", cut), F.lit(parts))))
    dealt = placed.select("back", "size", F.explode(part).alias("part"), "asks", "spelled", "n")
    key = ["back", "size", "part"]
    met = dealt.repartition(4 * parts, *key).sortWithinPartitions(*key, "asks", "spelled")
    found = met.mapInArrow(_ask, "word string, n_near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("most"), "best.form")


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, root) one step apart, chains having at most so many."""
    for _ in range(steps.bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return links


def group_variants(words: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n), none of which has fewer than ``least`` letters."""
    if least < 2:
        raise ValueError("a word of one letter has no half")
    words = written(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    met = words.join(near_words(words, least), "word", "left")
    enough = F.col("most") >= ratio * F.col("n")
    formed = written(met.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("most")).alias("form_n")), "forms")
    steps = len(str(formed.agg(F.max("form_n")).first()[0] or 0)) if ratio >= 10 else 63
    roots = _roots(formed.filter("form is not null").select("word", F.col("form").alias("root")), steps)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_variants(word_counts(docs, damaged=DAMAGED))


#: The CRC-32 takes the UTF-8 bytes bit by bit: a number is a byte to be added, -1 a step; letters from 192 to 255 have two bytes.
OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), hashed AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, '') || ':' || run, '.'),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
      ELSE [195::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1, unicode(c)::BIGINT - 64, -1, -1, -1, -1, -1, -1, -1, -1] END))),
    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h FROM runs
), w AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = cut.rest
  UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = cut.rest
), best AS (
  SELECT near.word, count(*) AS n_near, max(w.n) AS most, arg_min(other, (-w.n, other)) AS form FROM near JOIN w ON w.word = other GROUP BY near.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN form END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS reached, 0 AS steps FROM formed
  UNION ALL SELECT chain.word, formed.form, steps + 1 FROM chain JOIN formed ON formed.word = chain.reached WHERE formed.form IS NOT NULL
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(reached, steps) AS root FROM chain GROUP BY word) USING (word)
"""
