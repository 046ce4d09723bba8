"""Byte-level BPE by merge replay: an inverted index from token pair to word positions.

A partition's texts are a corpus: each distinct word (a match of the pattern) is encoded once. The new words of a batch are
laid end to end; the index maps each pair of neighbours that the vocabulary can merge to its positions, by rank. Ranks are
replayed from the lowest; a merge touches only the two neighbours of its place, whose new pairs enter the index. A pair
that arises with a rank below the current one is replayed next, so that the result is the one of encoding each word alone.
The words' ids then make up the texts' ids, and a text is decoded from its ids.

Defined cases: null text is empty and has no ids; texts of any length are handled whole; repeated rows give equal ids;
other columns may be kept, but those named like a result. The memory of word ids is bounded: at ``MEMORY`` words it is emptied.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import fresh, table, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct words whose ids a Python worker remembers.
MEMORY = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Ranks(dict):
    """Ranks with the tokens by rank beside them."""

    def __init__(self, pairs: dict[bytes, int]) -> None:
        super().__init__(pairs)
        self.tokens = {r: t for t, r in pairs.items()}


def replay(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """The ids of each word."""
    out: list[list[int]] = [[]] * len(words)
    parts: list[bytes | None] = []  # None: a border of a word, or a place merged into an earlier one
    starts: list[tuple[int, int]] = []
    for k, w in enumerate(words):
        whole = ranks.get(w)
        if whole is not None and len(w) == 1:
            out[k] = [whole]
            continue
        starts.append((k, len(parts)))
        parts += [w[i : i + 1] for i in range(len(w))]
        parts.append(None)
    size = len(parts)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    index: dict[int, list[int]] = {}
    get = ranks.get
    for i in range(size - 1):
        a, b = parts[i], parts[i + 1]
        if a is not None and b is not None and (r := get(a + b)) is not None:
            index.setdefault(r, []).append(i)
    queue = sorted(index)
    token = ranks.tokens
    while queue:
        r = heappop(queue)
        places = index.pop(r, None)
        if places is None:
            continue
        whole = token[r]
        places.sort()
        for n, i in enumerate(places):
            a = parts[i]
            if a is None:
                continue
            j = after[i]
            b = parts[j]
            if b is None or len(a) + len(b) != len(whole) or a + b != whole:
                continue
            parts[i], parts[j] = whole, None
            k = after[j]
            after[i] = k
            before[k] = i
            lower = False
            c = parts[k]
            if c is not None and (x := get(whole + c)) is not None:
                if x in index:
                    index[x].append(i)
                else:
                    index[x] = [i]
                    heappush(queue, x)
                lower = x < r
            h = before[i]
            if h >= 0 and (c := parts[h]) is not None and (x := get(c + whole)) is not None:
                if x in index:
                    index[x].append(h)
                else:
                    index[x] = [h]
                    heappush(queue, x)
                lower |= x < r
            if lower:  # the lower rank first; the rest of this one after it
                if rest := places[n + 1 :]:
                    index.setdefault(r, []).extend(rest)
                    heappush(queue, r)
                break
    for k, i in starts:
        ids = []
        while parts[i] is not None:
            ids.append(ranks[parts[i]])
            i = after[i]
        out[k] = ids
    return out


class Encoder:
    """Encodes texts with the words' ids remembered; each word has its ids as a tuple and as text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.find = Ranks(ranks), regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.decimal = list(map(str, range(max(self.ranks.tokens, default=-1) + 1)))

    def words(self, texts: list[str]) -> list[list[str]]:
        found = [self.find(t) for t in texts]
        new = set().union(*found) - self.known.keys() if found else set()
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = set().union(*found)
        new = sorted(new)
        self.known.update(zip(new, map(tuple, replay([w.encode() for w in new], self.ranks)), strict=True))
        return found

    def ids(self, words: list[str]) -> list[int]:
        return [i for part in map(self.known.__getitem__, words) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))


#: Encoders of this Python worker, which Spark reuses for later tasks.
ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return ENCODERS[path, pattern]


#: Characters of text encoded at once.
BLOCK = 1 << 22


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """The columns ``keep`` with n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, and ids if asked for."""
    import public_tokenizers

    path, pattern = vocabulary or tokenizer_path(VOCABULARY), pattern or public_tokenizers.PATTERN
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), kinds])

    own = fresh(df.columns, "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        decimal = encoder.decimal
        for batch in batches:
            counts, digests, decoded, every = [], [], [], []
            for block in blocks(batch.column(own).to_pylist()):
                for words in encoder.words(block):
                    ids = encoder.ids(words)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if with_ids:
                        every.append(ids)
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            columns += [pa.array(every, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *made])

    return df.select(*keep, df[text].alias(own)).mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
