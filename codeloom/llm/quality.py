"""Quality rules, lines first: every line is judged, failing lines go, and a text that loses too much is rejected.

A line is what stands between line feeds. A line with a word fails if it is navigation (a large share of bare separators),
punctuated unlike prose (a mark to most words, as ``.``, ``!``, ``...``; or a line of few words that ends without any mark),
boilerplate (fixed phrases, as whole words, in a line of ``short_line`` words or as a large share of a longer one), markup or
symbols rather than prose, one word over and over, or an earlier line again. Common lines, such as a site's heading, go too. A
text is rejected if its whole fails a rule of the base (too few words, too much repeated), if it has but common lines, or if
the failing lines hold more than ``max_lost`` of the code points in the words of all lines but the common ones.

Common lines are counted over all documents: a line of ``common_chars`` code points at most is common if it stands between
many different pairs of neighbours, at least ``common_least`` and ``common_share`` of the number of rows. Copies of a
document have equal neighbours, so that they make no line common. There are no more common lines than short lines in
a mean document divided by that share, whatever the size of the corpus; their hashes are sent to the tasks.

Defined cases: a null or empty text has no words, all counts zero, and is rejected; a line without a word neither counts
nor fails; repeated rows get equal verdicts; other columns may be kept, but those named like a result. Work is one pass over
each text with memory proportional to that text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, table
from codeloom.llm.rolling import mixed

SYMBOLS = b"#*$%&|<>"
SEPARATORS = {b"|", b"\xc2\xbb", b"\xc2\xb7", b">", b"/", b"::", b"-", b"\xe2\x80\xa2"}
BOILERPLATE = re.compile(
    rb"(?i)(?<![0-9A-Za-z_\x80-\xff])(?:(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript"
    rb"|click here|read more|sign up|log in|subscribe|lorem ipsum|powered by|licensed under|share this)(?![0-9A-Za-z_\x80-\xff])|copyright (?:\(c\)|\xc2\xa9))"
)
#: Marks of punctuation within a line, and those that a line may end with, closing quotes and brackets included.
MARKS = b"!?.,;:"
ENDINGS = tuple(x.encode() for x in ".!?:;\u2026\"')]\u00bb\u201d\u2019\u201c\u3002\uff01\uff1f\u061f\u0964")
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string"


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are of the words or characters of a line or text."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    nav_share: float = 0.3
    symbol_share: float = 0.3
    min_letter_share: float = 0.4
    mono_words: int = 6
    mono_share: float = 0.8
    short_line: int = 15
    boilerplate_share: float = 0.2
    max_lost: float = 0.5
    mark_words: int = 6
    mark_share: float = 0.8
    unfinished_words: int = 3
    common_chars: int = 200
    common_least: int = 20
    common_share: float = 0.001


def code_points(b: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(b) if b.isascii() else len(b.decode())


def repeated_words(words: list[bytes], n: int) -> int:
    """Words inside n-word windows that occur twice or more in the text, all occurrences included."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    rank, span = seq, len(ids)  # of the windows of the first k words; below span
    for k in range(1, n):
        if span * len(ids) >= 1 << 62:
            found, rank = np.unique(rank, return_inverse=True)
            span = len(found)
        rank = rank[:-1] * len(ids) + seq[k:]
        span *= len(ids)
    _, inverse, counts = np.unique(rank, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def line_fails(line: bytes, words: list[bytes], rules: Rules) -> bool:
    """The verdict on one line that has words."""
    n = len(words)
    if n <= rules.unfinished_words and not words[-1].endswith(ENDINGS):
        return True
    if n >= rules.mark_words and len(line) - len(line.translate(None, MARKS)) > rules.mark_share * n:
        return True
    if sum(w in SEPARATORS for w in words) >= rules.nav_share * n:
        return True
    size = sum(map(len, words))
    symbols = size - len(line.translate(None, SYMBOLS + b" \t\n\v\f\r"))
    if symbols > rules.symbol_share * size:
        return True
    letters = len(re.sub(rb"[^A-Za-z\x80-\xff]", b"", line))
    if letters < rules.min_letter_share * size:
        return True
    if n >= rules.mono_words and max(Counter(words).values()) >= rules.mono_share * n:
        return True
    if n <= rules.short_line:
        return bool(BOILERPLATE.search(line))
    return sum(len(m.split()) for m in BOILERPLATE.findall(line)) >= rules.boilerplate_share * n


def common_lines(df: DataFrame, text: str, rules: Rules) -> frozenset[int]:
    """XXH64 (seed 42) of the common lines."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, short = [0], [False]  # a zero between texts stands for no line
            for t in batch.column(0).to_pylist():
                for line in (t or "").encode().split(b"\n"):
                    hashes.append(xxh64_intdigest(line, 42))
                    short.append(0 < len(line) <= rules.common_chars or 0 < len(line) <= 4 * rules.common_chars and code_points(line) <= rules.common_chars)
                hashes.append(0)
                short.append(False)
            h, at = np.array(hashes, np.uint64), np.flatnonzero(short)
            between = mixed(mixed(h[at - 1]) + h[np.minimum(at + 1, len(h) - 1)])
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(between.view(np.int64))], names=["h", "between"])

    least = max(rules.common_least, rules.common_share * df.count())
    pairs = df.select(df[text].alias("t")).mapInArrow(run, "h long, between long").distinct()
    found = pairs.groupBy("h").count().filter(F.col("count") >= least).select("h")
    return frozenset(int(h) & (1 << 64) - 1 for h in found.toArrow().column(0).to_pylist())


def judge(text: str | None, rules: Rules, common: frozenset[int] = frozenset()) -> tuple:
    """The columns of :data:`RESULT`; ``common`` are hashes of the common lines."""
    from xxhash import xxh64_intdigest

    data = (text or "").encode()
    words = data.split()
    chars = code_points(b"".join(words))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup, lost, left, kept_lines = 0, 0, chars, []
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            kept_lines.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if common and len(line) <= 4 * rules.common_chars and xxh64_intdigest(line, 42) in common:
            left -= code_points(b"".join(own))
        elif again or line_fails(line, own, rules):
            lost += code_points(b"".join(own))
        else:
            kept_lines.append(line)
    repeats = repeated_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    kept = not failed and left > 0 and lost <= rules.max_lost * left
    return len(words), chars, symbols, dup, repeats, failed, kept, b"\n".join(kept_lines).decode() if kept else None


def apply_quality(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: Rules | None = None, clean: bool = False) -> DataFrame:
    """The columns ``keep`` and those of :data:`RESULT`; ``clean_text`` (the lines that passed) is filled if ``clean``."""
    rules, keep = rules or Rules(), df.columns if keep is None else keep
    sent = df.sparkSession.sparkContext.broadcast(common_lines(df, text, rules))  # bounded by the share, as said above
    names = [f.split()[0] for f in RESULT.split(", ")]
    keep = [c for c in keep if c not in names]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), RESULT])
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]

    own = fresh(keep, "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, rules, sent.value) for t in batch.column(own).to_pylist()]
            columns = [batch.column(c) for c in keep]
            for i, kind in enumerate(types):
                columns.append(pa.array([r[i] if i < 7 or clean else None for r in rows], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return df.select(*keep, df[text].alias(own)).mapInArrow(run, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_quality(docs, keep=["doc_id"]).drop("clean_text")


_BORDER = r"[^0-9A-Za-z_\x{80}-\x{10FFFF}]"
#: The phrases in a line all of whose characters but those of words stand twice, so that neighbours don't share a border.
_PHRASES = (
    rf"(?i)(?:^|{_BORDER})(?:(?:all  rights  reserved|terms  of  (?:use|service)|privacy  policy|cookie  policy|accept  (?:all  )?cookies|enable  javascript"
    rf"|click  here|read  more|sign  up|log  in|subscribe|lorem  ipsum|powered  by|licensed  under|share  this)(?:{_BORDER}|$)|copyright  (?:\(\(c\)\)|©))"
)
OP10_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n
  FROM (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w)
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, range(5) q(k) WHERE n > 1 GROUP BY r
), split AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d
), around AS (
  SELECT r, line, i, {'a': lag(line) OVER (PARTITION BY r ORDER BY i), 'b': lead(line) OVER (PARTITION BY r ORDER BY i)} AS between_ FROM split
), common AS (
  SELECT line FROM around WHERE length(line) BETWEEN 1 AND 200 GROUP BY line HAVING count(DISTINCT between_) >= greatest(20, 0.001 * (SELECT count(*) FROM d))
), lines AS (
  SELECT r, line, i, line IN (SELECT line FROM common) AS common, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    regexp_extract_all(regexp_replace(line, '([^0-9A-Za-z_\x{80}-\x{10FFFF}])', '\1\1', 'g'), 'PHRASES') AS phrases
  FROM split
), judged AS (
  SELECT r, len(array_to_string(w, '')) AS chars, strlen(array_to_string(w, '')) AS size, len(w) AS n, common,
    row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again,
    len(list_filter(w, lambda x: x IN ('|', '»', '·', '>', '/', '::', '-', '•'))) AS separators,
    len(line) - len(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
    len(line) - len(regexp_replace(line, '[!?.,;:]', '', 'g')) AS marks,
    regexp_matches(w[-1], '[.!?:;…"'')\]»”’“。！？؟।]$') AS finished,
    strlen(regexp_replace(line, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters,
    list_max(map_values(list_aggregate(w, 'histogram'))) AS most,
    len(phrases) AS n_phrases,
    coalesce(list_sum(list_transform(phrases, lambda x: len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')))), 0) AS phrase_words
  FROM lines WHERE len(w) > 0
), by_doc AS (
  SELECT r, count(*) FILTER (again) AS dup, coalesce(sum(chars) FILTER (common), 0) AS set_aside,
    sum(chars) FILTER (NOT common AND (again OR separators >= 0.3 * n OR symbols > 0.3 * size OR letters < 0.4 * size OR (n >= 6 AND most >= 0.8 * n)
      OR (n <= 3 AND NOT finished) OR (n >= 6 AND marks > 0.8 * n) OR (n <= 15 AND n_phrases > 0) OR (n > 15 AND phrase_words >= 0.2 * n))) AS lost
  FROM judged GROUP BY r
), base AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(array_to_string(w.w, ''))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(set_aside, 0) AS set_aside
  FROM w LEFT JOIN by_doc ON by_doc.r = w.r LEFT JOIN repeats ON repeats.r = w.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars > set_aside AND lost <= 0.5 * (word_chars - set_aside) AS kept
FROM base
"""
).replace("PHRASES", _PHRASES)
