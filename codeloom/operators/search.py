"""Ranked full-text search over an inverted index kept as a table.

``postings`` has a row for each term, row and column with the term's positions; sorted by term, a Parquet scan skips all
other terms. A query is parsed on the driver into phrases and a boolean expression. Its plan is one scan of the postings
with the terms pushed down, one aggregation to a row for each hit with its phrase occurrences, and the score. A query that
can't be parsed falls back to a pattern match on names, as does the empty query.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
DEFAULT_LIMIT = 10
#: Bytes of text cut at once when an index is built.
GROUP = 4 << 20
#: The bits of a place within a column.
PLACES = (1 << 32) - 1
TOKEN, GAP = r"[\p{L}\p{N}\p{Co}]+", r"[^\p{L}\p{N}\p{Co}]+"


def _folds() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(ACCENTED, PLAIN)).lower()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def tokenize(text: str) -> list[str]:
    import regex

    return regex.findall(TOKEN, fold_text(text))


POSTINGS = "term string, id string, col string, pos array<int>"
LENGTHS = "id string, n long"
#: Postings are dealt by the term and a part of the rows, so that those of a frequent term are no one task's.
BY_TERM = ("term", "pmod(xxhash64(id), 64)")


@dataclass
class TextIndex:
    """postings (term, id, col, pos array), lengths (id, n)."""

    postings: DataFrame
    lengths: DataFrame
    columns: list[str]

    def write(self, path: str) -> None:
        self.postings.repartition(*map(F.expr, BY_TERM)).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def build_index(df: DataFrame, id_col: str, columns: Sequence[str]) -> TextIndex:
    """The index of ``df``, whose ids are a key. The places of a term in a row are gathered where the row is read, so no single token is shuffled."""
    folded = [fold(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    rows = df.select(F.col(id_col).alias("id"), *(F.regexp_replace(c, GAP, "\n").alias(f"t{k}") for k, c in enumerate(folded)))  # one string travels better than a list
    size = sum((F.regexp_count(c, F.lit(TOKEN)) for c in folded), F.lit(0)).cast("bigint")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in enumerate(columns):
                yield from places(batch.column(0), batch.column(k + 1), c)

    postings = rows.mapInArrow(run, f"term string, id {kind}, col string, pos array<int>")
    return TextIndex(postings, df.select(F.col(id_col).alias("id"), size.alias("n")), list(columns))


def places(ids: pa.Array, texts: pa.Array, col: str) -> Iterator[pa.RecordBatch]:
    """(term, id, col, pos) of the tokens of each row, which line ends part, for about ``GROUP`` bytes at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GROUP, "right")))
        cut = pc.split_pattern(texts.slice(a, b - a), "\n")
        every, row = cut.flatten(), np.repeat(np.arange(b - a), cut.value_lengths().to_numpy())
        whole = np.flatnonzero(pc.binary_length(every).to_numpy())  # nothing stands before a gap that begins a text
        row, coded = row[whole], every.take(pa.array(whole)).dictionary_encode()
        codes, sizes = coded.indices.to_numpy(), np.bincount(row, minlength=b - a)
        at = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        order = np.argsort(row * len(coded.dictionary) + codes, kind="stable")
        row, codes = row[order], codes[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (codes[1:] != codes[:-1]))[: len(row)])
        pos = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(at[order], pa.int32()))
        found = [coded.dictionary.take(pa.array(codes[first])), ids.take(pa.array(row[first] + a)), pa.repeat(pa.scalar(col), len(first)), pos]
        yield pa.RecordBatch.from_arrays(found, names=["term", "id", "col", "pos"])
        a = b


def read_index(spark, path: str, columns: Sequence[str]) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), list(columns))


class QuerySyntaxError(ValueError):
    """A query outside the grammar."""


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    first: bool = False
    columns: list[str] | None = None


@dataclass
class Query:
    """The boolean expression is a nested tuple: ("phrase", number), ("and" | "or" | "not", left, right)."""

    phrases: list[Phrase] = field(default_factory=list)
    tree: tuple = ()


def normalize_query(q: str) -> str:
    """A plain query gets a ``*``: its last word becomes a prefix."""
    if not q or any(c in q for c in '*"-') or any(f" {w} " in q.upper() for w in ("OR", "AND", "NOT")):
        return q
    return q + "*"


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\u0080-\U0010ffff\x1a]+)|([()*+^:{}-]))')


def parse_query(q: str, columns: Sequence[str]) -> Query:
    """Grammar: phrases, ``"..."``, ``+``, prefix ``*``, ``^``, ``column:``, ``{a b}:``, ``-column:``, implicit AND, NOT, AND, OR, parentheses."""
    items, at, text = [], 0, q.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise QuerySyntaxError(q)
        items.append(("string", m[1][1:-1].replace('""', '"')) if m[1] is not None else ("word", m[2]) if m[2] else (m[3], m[3]))
        at = m.end()
    if not items:
        raise QuerySyntaxError("empty query")
    out, place = Query(), 0
    lookup = {c.lower(): c for c in columns}

    def peek(k: int = 0) -> tuple[str, str]:
        return items[place + k] if place + k < len(items) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal place
        place += 1
        return items[place - 1]

    def operator(word: str) -> bool:
        return peek() == ("word", word)

    def binary(word: str, below):
        def parse(cols):
            left = below(cols)
            while operator(word):
                take()
                left = (word.lower(), left, below(cols))
            return left

        return parse

    def starts() -> bool:
        kind, value = peek()
        return kind in ("string", "(", "^", "{", "-") or kind == "word" and value not in ("AND", "OR", "NOT")

    def implicit(cols):
        if not starts():
            raise QuerySyntaxError(q)
        left = primary(cols)
        while starts():
            left = ("and", left, primary(cols))
        return left

    def column_set() -> list[str] | None:
        """The columns of a filter that stands here, else nothing is taken."""
        nonlocal place
        begin, minus, found = place, False, []
        if peek()[0] == "-":
            take()
            minus = True
        if peek()[0] == "{":
            take()
            while peek()[0] in ("word", "string"):
                found.append(take()[1])
            if take()[0] != "}" if place < len(items) else True:
                raise QuerySyntaxError(q)
        elif peek()[0] in ("word", "string"):
            found.append(take()[1])
        if not found or peek()[0] != ":":
            if minus:
                raise QuerySyntaxError(q)
            place = begin
            return None
        take()
        if any(f.lower() not in lookup for f in found):
            raise QuerySyntaxError(f"no such column in {q!r}")
        own = [lookup[f.lower()] for f in found]
        return [c for c in columns if c not in own] if minus else own

    def primary(cols):
        own = column_set()
        if own is not None:
            cols = own if cols is None else [c for c in own if c in cols]
        if peek()[0] == "(":
            take()
            inner = either(cols)
            if place >= len(items) or take()[0] != ")":
                raise QuerySyntaxError(q)
            return inner
        first = peek()[0] == "^"
        if first:
            take()
        terms, prefix = [], False
        while True:
            kind, value = peek()
            if kind not in ("word", "string") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QuerySyntaxError(q)
            take()
            terms += tokenize(value)
            if peek()[0] == "*":
                take()
                prefix = True
            if peek()[0] != "+":
                break
            take()
            if prefix:
                raise QuerySyntaxError(q)
        out.phrases.append(Phrase(terms, prefix, first, cols))
        return ("phrase", len(out.phrases) - 1)

    either = binary("OR", binary("AND", binary("NOT", implicit)))
    out.tree = either(None)
    if place != len(items):
        raise QuerySyntaxError(q)
    return out


def _matches(term: Column, word: str, prefix: bool) -> Column:
    return term.startswith(word) if prefix else term == word


def _holds(tree: tuple) -> Column:
    if tree[0] == "phrase":
        return F.coalesce(F.col(f"f{tree[1]}"), F.lit(0)) > 0
    left, right = _holds(tree[1]), _holds(tree[2])
    return left & right if tree[0] == "and" else left | right if tree[0] == "or" else left & ~right


def match(index: TextIndex, query: Query) -> DataFrame:
    """(id, rank) of the rows that the query fits; the lower the rank the better."""
    counts, wanted = [], F.lit(False)
    column = F.array_position(F.lit(index.columns), F.col("col"))
    for p, phrase in enumerate(query.phrases):
        n, hits = len(phrase.terms), []
        for k, word in enumerate(phrase.terms):
            hit = _matches(F.col("term"), word, phrase.prefix and k == n - 1)
            hits.append(hit if phrase.columns is None else hit & F.col("col").isin(phrase.columns))
            wanted = wanted | hits[-1]
        if n == 1:  # each place of the term is one of the phrase
            of_term = F.array_contains("pos", 0).cast("bigint") if phrase.first else F.size("pos").cast("bigint")
            count = F.coalesce(F.sum(F.when(hits[0], of_term)), F.lit(0))
        elif n:  # places where it may begin, as numbers of column and place, met by all its terms
            starts = [F.flatten(F.collect_list(F.when(hit, _starts(column, n - k)))) for k, hit in enumerate(hits)]
            whole = starts[0]
            for s in starts[1:]:
                whole = F.array_intersect(whole, s)
            count = F.size(F.filter(whole, lambda x, n=n: x.bitwiseAND(PLACES) == n) if phrase.first else whole).cast("bigint")
        else:
            count = F.lit(0).cast("bigint")
        counts.append(count.alias(f"f{p}"))
    by_row = index.postings.filter(wanted).groupBy("id").agg(*counts)
    n_hits = by_row.agg(*(F.count(F.when(F.col(f"f{p}") > 0, 1)).alias(f"n{p}") for p in range(len(query.phrases))))
    totals = index.lengths.agg(F.count("*").alias("rows_"), F.avg("n").alias("mean_")).crossJoin(n_hits)  # one row each
    scored = by_row.filter(_holds(query.tree)).join(index.lengths, "id").crossJoin(F.broadcast(totals))
    rank = F.lit(0.0)
    for p in range(len(query.phrases)):
        idf = F.log((F.col("rows_") - F.col(f"n{p}") + 0.5) / (F.col(f"n{p}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(f"f{p}").cast("double")
        rank = rank + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.col("mean_")))
    return scored.select("id", (-rank).alias("rank"))


def _starts(column: Column, shift: int) -> Column:
    """The places of a posting, moved on, as numbers that tell columns apart."""
    return F.transform("pos", lambda at: F.shiftleft(column, 32) + at.cast("bigint") + shift)


def search(
    df: DataFrame, index: TextIndex, q: str, id_col: str = "id", name_cols: Sequence[str] = ("name", "qualified_name"), limit: int = DEFAULT_LIMIT, offset: int = 0, filters: dict[str, object] | None = None
) -> DataFrame:
    """The best rows of ``df`` for the query, with ``rank`` (null where the query fell back to names)."""
    from codeloom.operators.files import filtered

    limit = limit if limit > 0 else DEFAULT_LIMIT
    rows = filtered(df, **(filters or {}))
    try:
        query = parse_query(normalize_query(q), index.columns)
    except QuerySyntaxError:
        return like_search(rows, q, name_cols, id_col, limit, offset)
    hits = match(index, query).withColumnRenamed("id", "hit_id")
    return rows.join(hits, F.col(id_col) == F.col("hit_id")).drop("hit_id").orderBy("rank", id_col).offset(offset).limit(limit)


def like_search(df: DataFrame, q: str, name_cols: Sequence[str], id_col: str, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Rows with the raw query, its wildcards included, anywhere in a name; by name."""
    fits = F.lit(False)
    for c in name_cols:
        fits = fits | F.col(c).ilike(f"%{q}%")
    return df.filter(fits).withColumn("rank", F.lit(None).cast("double")).orderBy(name_cols[0], id_col).offset(offset).limit(limit)
