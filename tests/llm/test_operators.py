from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import bpe, chat, common, components, decontam, gru, langid, lmscore, nearcopies, quality, simhash, suffixdedup, urlfilter, warc, wordcut
from codeloom.llm.suffixarray import Merged, Shard
from tests.llm import brute

ODD = [None, "", " \t\n ", "one", "Two words", "a b c d e", "ü é ñ 日本", "x" * 3000, "same text of some words here", "same text of some words here", "\x00\x01 odd"]


def frame(spark, texts, more=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string" + more)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def babble(seed, n, letters="abé", most=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, most))) for _ in range(n)]


# --- 1


@pytest.mark.parametrize("lot", [256, 2])
def test_decontamination(spark, monkeypatch, lot):
    monkeypatch.setattr(decontam, "ITEMS", lot)
    items = babble(1, 30, most=30) + [None, "", "too short", "q w e r t y u i o p"]
    docs = babble(2, 40, most=200)
    docs += [f"{docs[0]} {items[3]} {docs[1]}", (items[4] or "").upper(), f"x {items[5]} y", None, "", "q w e r t y u i o z"] + ODD
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontam.find_leaks(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id")).collect()}
    want = {}
    for i, d in enumerate(docs):
        for k, b in enumerate(items):
            n, common = brute.contained(d, b)
            if n and common >= 0.8 * n - 1e-9:
                want[i, k] = (n, common)
    assert got == want and want
    clean = rows(decontam.remove_leaks(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id")))
    assert set(clean) == set(range(len(docs))) - {i for i, _ in want}


def test_items_without_id_and_short_items(spark):
    docs = ["now the quick brown fox jumps over it", "answer: Forty two.", "forty twofold", "answer: Forty two. x", "nothing here", None, "b a b"]
    items = spark.createDataFrame([(None, "the quick brown fox jumps over"), (1, "forty two."), (2, ""), (3, None), (4, "a b"), (None, "nothing")], "item_id long, text string")
    found = decontam.find_leaks(frame(spark, docs), items, short=True)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(0, None, 2, 2, 1.0), (1, 1, 1, 1, 1.0), (3, 1, 1, 1, 1.0), (4, None, 1, 1, 1.0), (6, 4, 1, 1, 1.0)], key=str)
    assert [tuple(r)[:2] for r in decontam.find_leaks(frame(spark, docs), items).collect()] == [(0, None)]
    assert {r.doc_id for r in decontam.remove_leaks(frame(spark, docs), items, short=True).collect()} == {2, 5}


def test_decontamination_of_empty_tables(spark):
    docs, items = frame(spark, ["one two three four five six"]), spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string")
    for d, i in [(docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))]:
        assert decontam.find_leaks(d, i, short=True).count() == 0
        assert decontam.remove_leaks(d, i, short=True).count() == d.count()
    assert decontam.remove_leaks(docs, items).count() == 0


@pytest.mark.parametrize("n", range(1, 60))
def test_sketch_sizes_miss_nothing(n):
    import math

    size, needs = decontam.sketch_size(n, 0.8)
    assert needs >= 1 and size - (n - math.ceil(0.8 * n - 1e-9)) == needs


# --- 2


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<|>|<|\\|>", "a\\", "\\<|user|>", "[|image 1|]", "<</s>>", "", None, "</s", "/s>", "\\\\</s>", "é\n<s>"]
    data = [(c, t, r, said[(c + t) % len(said)]) for c in range(6) for t, r in enumerate(["system", "<|>", "assistant", "user|", None])]
    df = spark.createDataFrame([*data, (None, None, "user", "x"), (1, 0, "system", said[1]), (1, 0, "system", said[1])], "conv_id long, turn long, role string, text string")
    part = F.struct(F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    got = rows(chat.read_back(chat.format_conversations(df.withColumn("parts", F.array(part)))), "conv_id")
    for c in range(6):
        want = sorted((t, r or "", s or "") for k, t, r, s in data if k == c)
        if c == 1:
            want = sorted([*want, (0, "system", said[1]), (0, "system", said[1])])
        assert [(t.role, t.text) for t in got[c].turns] == [(r, s) for _, r, s in want]
    assert len(got) == 7


def test_chat_parts(spark):
    part = chat.PART
    df = spark.createDataFrame(
        [
            (1, 0, "user", [("text", "see [|", None, None), ("image", None, "u1", 2), ("text", "and", None, None), ("document", None, "u2", 3)]),
            (1, 1, "assistant", [("audio", None, "u3", None)]),
            (2, 0, "user", None),
            (3, 0, "user", []),
        ],
        f"conv_id long, turn long, role string, parts array<{part}>",
    )
    got = rows(chat.format_conversations(df), "conv_id")
    assert got[1].formatted == "<s><|user|>see [\\|[|image 1|]and[|document 2|]</s><|assistant|>[|audio 3|]</s>"
    assert [(a.ordinal, a.kind, a.ref, a.n_tokens) for a in got[1].attachments] == [(1, "image", "u1", 512), (2, "document", "u2", 1536), (3, "audio", "u3", 25)]
    assert got[1].attachment_tokens == 2073 and got[2].formatted == "<s><|user|></s>" == got[3].formatted
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parts_round_trip(spark):
    """Control strings cut at every place, over borders of parts and roles."""
    rng = random.Random(21)
    bits = [s[a:b] for s in [*chat.CONTROLS, "\\\\", "\\"] for a in range(len(s)) for b in range(a + 1, len(s) + 1)] + ["x", " 1", "\n", "é", "|image 1|]"]
    word = lambda n: "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))

    def part():
        return None if rng.random() < 0.05 else (rng.choice(["text", "text", "image", "audio", None, word(2) or "x"]), None if rng.random() < 0.1 else word(3), rng.choice([None, word(2)]), rng.choice([None, 3]))

    data = [(c, t, rng.choice([None, "user", word(3)]), [part() for _ in range(rng.randint(0, 5))]) for c in range(150) for t in range(rng.randint(1, 4))]
    data += [(1000 + k, 0, "user", [("text", s[:k], None, None), ("text", s[k:], None, None)]) for s in chat.CONTROLS for k in range(1, len(s))]
    df = spark.createDataFrame([(f"{c}-{i // 1000}", *r) for i, (c, *r) in enumerate(data)], f"conv_id string, turn long, role string, parts array<{chat.PART}>")
    got = rows(chat.read_back(chat.format_conversations(df)), "conv_id")
    by_conv = {}
    for i, (c, t, role, parts) in enumerate(data):
        by_conv.setdefault(f"{c}-{i // 1000}", []).append((t, role, parts))
    for name, turns in by_conv.items():
        if len({t for t, _, _ in turns}) < len(turns):
            continue  # turns that share a number are ordered by content
        r, n, marks = got[name], 0, []
        want = []
        for _, role, parts in turns:
            own = []
            for p in parts:
                kind, said, ref, units = p or (None, None, None, None)
                if kind in (None, "text"):
                    if said:
                        own[-1:] = [("text", own[-1][1] + said, None)] if own and own[-1][0] == "text" and own[-1][2] is None else [*own[-1:], ("text", said, None)]
                else:
                    n += 1
                    own.append((kind, None, n))
                    marks.append((n, kind, ref, chat.TOKENS_PER_UNIT.get(kind, 1) * (units or 1)))
            want.append((role or "", own))
        assert [(t.role, [tuple(p) for p in t.parts]) for t in r.turns] == want
        assert [tuple(a) for a in r.attachments] == marks


# --- 3


def test_rules_of_many_shapes(spark):
    rng = random.Random(24)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = sorted({(rng.choice(["allow", "block"]), h, "/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 3)))) for h in hosts for _ in range(3)})
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [f"http://{'.'.join(rng.choice('abc') for _ in range(rng.randint(1, 5)))}/{'/'.join(rng.choice('xy') for _ in range(rng.randint(0, 5)))}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "own", "own", "own") for i, u in enumerate(urls)], "page_id long, path string, url_ string, rest_ string, won string")
    got = {r.page_id: r for r in urlfilter.judge_urls(df, urlfilter.rules_frame(spark, rules), url="path").collect()}
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)[0], "/" + u[7:].split("/", 1)[1]
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[3], best[4] if best else "allow")
        assert (got[i].url_, got[i].rest_, got[i].won) == ("own", "own", "own")


def test_url_filters(spark):
    urls = [None, "", "x.com/en/", "http://COM/en/x", "http://a.example.com/en/77?q#f", "http://notcom/en/", "http://b.net/de", "http://b.net/de/", "s://example.net/de/81", "http://x.org#/es/", "a?u=http://z.org/es/1", "http://Ä.com/en/", "http://a.com:80/en/"]
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string")
    got = rows(urlfilter.judge_urls(df, urlfilter.rules_frame(spark, urlfilter.CONTRACT_RULES)), "page_id")

    def want(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = brute.lower(host)
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.CONTRACT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[1], best[2] if best else "allow"

    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [want(u) for u in urls]
    none = urlfilter.judge_urls(df, urlfilter.rules_frame(spark, urlfilter.CONTRACT_RULES).limit(0))
    assert none.filter("verdict = 'allow' and rule is null").count() == len(urls) + 1
    assert urlfilter.judge_urls(df.limit(0), urlfilter.rules_frame(spark, urlfilter.CONTRACT_RULES)).count() == 0


# --- 4


def test_warc(spark, tmp_path):
    import base64

    html = [None, "", "<p>é</p>", "same", "same", "x" * 5000, "a\r\n\r\nWARC/1.1\r\n", "same"]
    data = [(10 - i, f"http://x/{i}\r\nEvil: 1", h) for i, h in enumerate(html)]
    df = spark.createDataFrame([*data, data[-1], (None, None, "lone"), (None, None, "same")], "page_id long, url string, html string")
    for least in (0, 3):
        path = f"file://{tmp_path}/{least}"
        warc.write_archive(df, path, "page_id", "url", "html", least)
        got = warc.parse_records(warc.reconstruct(spark, path)).collect()
        assert len(got) == len(html) + 3
        firsts = {}
        for p, _, h in data:
            firsts[(h or "").encode()] = min(p, firsts.get((h or "").encode(), 99))
        firsts[b"lone"] = None
        for r in got:
            if r.page_id is None:
                continue
            payload = (html[10 - r.page_id] or "").encode()
            assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            first = firsts[payload]
            again = r.page_id != first and len(payload) >= least
            assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))
        lone = [r for r in got if r.page_id is None]
        assert {(r.record_type, r.payload_bytes) for r in lone} == {("response", 4), ("revisit", 4)}
    records = [bytes(r.record) for r in warc.reconstruct(spark, path).collect()]
    assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") and b"\r\nEvil" not in r for r in records)
    warc.write_archive(df.limit(0), f"file://{tmp_path}/none", "page_id", "url", "html")
    assert warc.reconstruct(spark, f"file://{tmp_path}/none").count() == 0


# --- 5


def test_bpe_matches_the_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = [*ODD, "a" * 700, "  x \n\n y", "don't we'll", *("".join(rng.choice("abcdeé ñ\n'slt日本xyz 0123!?") for _ in range(rng.randint(0, 300))) for _ in range(150))]
    got = rows(bpe.encode(frame(spark, texts), keep=["doc_id"], with_ids=True))
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(frame(spark, texts).limit(0)).count() == 0


def test_replay_with_ranks_that_fall():
    """A merge may give rise to a pair of lower rank; the result is that of taking the least pair, the first of equals."""
    rng = random.Random(6)
    for _ in range(200):
        found = {b"a", b"b", b"c"}
        while len(found) < 14:
            x, y = rng.choice(sorted(found)), rng.choice(sorted(found))
            found.add(x + y)
        order = sorted(found - {b"a", b"b", b"c"})
        rng.shuffle(order)
        ranks = bpe.Ranks({t: k for k, t in enumerate([b"a", b"b", b"c", *order])})
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode() for _ in range(20)]
        for w, got in zip(words, bpe.replay(words, ranks), strict=True):
            parts = [w[i : i + 1] for i in range(len(w))]
            while True:
                options = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
                if not options:
                    break
                _, i = min(options)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert got == [ranks[p] for p in parts]


# --- 6


@pytest.mark.parametrize(("shard", "segment", "hot"), [(1 << 20, 1 << 22, 1000), (400, 37, 1000), (60, 50, 8), (1 << 20, 1 << 22, 2)])
def test_suffix_dedup(spark, monkeypatch, shard, segment, hot):
    monkeypatch.setattr(suffixdedup, "SEGMENT", segment)
    texts = babble(7, 120, most=60)
    texts += [texts[3]] * 3 + ODD + ["ab" * 100, "a" * 150] + [a[:50] + b[10:] for a, b in zip(texts[:30], texts[30:60], strict=True)]
    df = frame(spark, texts)
    got = rows(suffixdedup.remove_repeats(df.withColumn("n_bytes", F.lit("clash")), keep=["doc_id"], length=20, gram=8, shard=shard, hot=hot, with_text=True))
    want = brute.repeats(texts, 20)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert any(w[1] for w in want)


def test_suffix_dedup_odd_rows(spark):
    text = "long enough to be a repeat " * 2
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "other"), (2, None)], "doc_id long, text string")
    got = suffixdedup.remove_repeats(df, length=20, gram=8).collect()
    assert len(got) == 5 and sorted(r.n_removed for r in got) == [0, 0, 54, 54, 54]
    one = suffixdedup.remove_repeats(spark.createDataFrame([(1, "no repeat in this text"), (2, "nor here, not at all")], "doc_id long, text string"), length=20, gram=8)
    assert {r.n_removed for r in one.collect()} == {0}
    assert suffixdedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(8)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        s = Shard(texts)
        ends = np.repeat(s.stops, [len(t) for t in texts])
        suffix = [bytes(s.data[i : ends[i]]) for i in range(len(s.data))]
        assert [suffix[i] for i in s.sa] == sorted(suffix)
        common = s.common_prefixes()
        for k in range(1, len(s.sa)):
            a, b = suffix[s.sa[k - 1]], suffix[s.sa[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_merging_by_binary_search():
    rng = random.Random(9)
    merged, seen = Merged(12), {}
    for _ in range(6):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 30))) for _ in range(10)]
        s = Shard(texts)
        _, distinct = s.repeated(12)
        own = [bytes(s.data[i : i + 12]) for i in distinct]
        met, old = merged.add(s.data, distinct)
        assert own == sorted(set(own)) and [o in seen for o in own] == met.tolist()
        assert [bytes(merged.data[i : i + 12]) for i in old] == [o for o, m in zip(own, met, strict=True) if m]
        seen |= dict.fromkeys(own)


# --- 7


def test_gradients():
    rng = np.random.default_rng(0)
    sizes = gru.shapes(20, 6, 10, 5)
    p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in gru.start(sizes, 1).items()}
    steps, lanes = 7, 4
    x, c = rng.integers(0, 20, (steps, lanes)), rng.integers(0, 6, (steps, lanes))
    o, w = rng.random((steps, lanes)) < 0.2, np.where(rng.random((steps, lanes)) < 0.5, rng.integers(0, 10, (steps, lanes)), -1)
    h = np.zeros((lanes, gru.HIDDEN))

    def loss(q):
        m = gru.Model(q)
        return -m.log_probabilities(m.states(x, o, h)[0].reshape(steps * lanes, -1), c.ravel(), w.ravel()).mean()

    g, _ = gru.Model(p).gradients(x, o, c, w, h)
    for k, v in p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in v.shape)
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_every_step_is_trained(monkeypatch):
    seen, real = [], gru.Model.gradients
    monkeypatch.setattr(gru.Model, "gradients", lambda self, x, *rest: seen.append(len(x)) or real(self, x, *rest))
    n = gru.WINDOW * 3 + 1
    rng = np.random.default_rng(3)
    gru.train(gru.start(gru.shapes(20, 6, 10, 5), 1), rng.integers(0, 20, n), rng.random(n) < 0.2, rng.integers(2, 6, n), np.full(n, -1), 0.01, lanes=1)
    assert seen == [gru.WINDOW] * 3 + [1]


def test_padding_is_not_trained(monkeypatch):
    """A stream that leaves places of the lanes empty trains as the same steps without these places do."""
    rng, n = np.random.default_rng(5), 3 * gru.WINDOW * 7 - 2
    data = rng.integers(0, 20, n), rng.random(n) < 0.1, rng.integers(2, 6, n), np.full(n, -1)
    seen, real = [], gru.Model.gradients

    def spy(self, x, o, c, w, h, mask=None):
        out = real(self, x, o, c, w, h, mask)
        again = real(self, x, o, np.where(mask, c, 3) if mask is not None else c, w, h, mask)  # what stands there has no effect
        assert all((out[0][k] == again[0][k]).all() for k in out[0])
        seen.append(x.size if mask is None else int(mask.sum()))
        return out

    monkeypatch.setattr(gru, "UPDATES", 1)
    monkeypatch.setattr(gru.Model, "gradients", spy)
    gru.train(gru.start(gru.shapes(20, 6, 10, 5), 1), *data, 0.01, lanes=7)
    assert sum(seen) == n


def test_probabilities_sum_to_one():
    p = gru.start(gru.shapes(20, 6, 10, 5), 2)
    h = np.random.default_rng(1).standard_normal((1, gru.HIDDEN)).astype(np.float32)
    m = gru.Model(p)
    tails = sum(np.exp(m.log_probabilities(h, np.array([k]), np.array([-1]))[0]) for k in range(2, 6))
    words = sum(np.exp(m.log_probabilities(h, np.array([w // 5]), np.array([w]))[0]) for w in range(10))
    assert tails + words == pytest.approx(1, abs=1e-5)


def test_words_at_once():
    rng = random.Random(30)
    for _ in range(200):
        texts = ["".join(rng.choice("abAB é日.\t\n\x0b\x1c\x85 ") * rng.choice([1, 1, 9]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5))]
        words = wordcut.Words([t.encode() for t in texts])
        want = [brute.words(brute.lower(t)) for t in texts]
        flat = [w.encode() for own in want for w in own]
        assert words.take(np.arange(len(words))) == flat and words.counts.tolist() == list(map(len, want))
        keys = words.keys().tolist()
        assert len(set(keys)) == len(set(flat)) == len(set(zip(keys, flat, strict=True)))
        assert words.wide().tolist() == [not w.isascii() for w in flat]


def test_numbers_of_words():
    frequent = [lmscore.END, b"the", b"a", b"a" * 20]
    coder = lmscore.Coder(frequent)
    own = [b"the", b"a", b"b", b"ab", b"abc.", "é".encode(), "日本語".encode(), b"x" * 50, b"9", b"it's", b"\xff", b"a" * 20, b"a" * 9 + b"b" + b"a" * 10]
    inputs, classes, words = coder.tables()
    for w, k in zip(own, coder.numbers(wordcut.Words(own)).tolist(), strict=True):
        if w in frequent:
            assert (inputs[k], classes[k], words[k]) == (frequent.index(w), frequent.index(w) // lmscore.PER_CLASS, frequent.index(w))
        else:
            assert (inputs[k], classes[k], words[k]) == (coder.n_words + int.from_bytes(w[-3:], "big") % 251, coder.n_inner + lmscore.tail_class(w), -1)
    assert coder.numbers(wordcut.Words([])).tolist() == []


def test_lm_scoring(spark, monkeypatch):
    texts = babble(10, 300, "abcdefgh", 60) + ODD
    docs = frame(spark, texts).withColumn("score", F.lit("clash"))
    train = docs.filter("doc_id % 3 <> 0")
    learned = lmscore.learn(train, "doc_id")
    got = rows(lmscore.score_texts(docs, learned))
    from collections import Counter

    counts = Counter()
    for i, t in enumerate(texts):
        if i % 3:
            counts.update([*brute.words(brute.lower(t)), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        own = [*brute.words(brute.lower(t)), "\n"]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert got[i].base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert got[i].score < 0
    monkeypatch.setattr(lmscore, "BLOCK_CHARS", 3000)
    again = rows(lmscore.score_texts(docs, learned))
    assert all(again[i].score == pytest.approx(got[i].score, rel=1e-4) for i in got)
    none = lmscore.learn(train.limit(0), "doc_id")
    assert {r.n_known for r in lmscore.score_texts(docs, none).collect()} == {0}
    assert lmscore.score_texts(docs.limit(0), learned).count() == 0


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_scores_do_not_depend_on_the_splits(spark, monkeypatch, shard):
    monkeypatch.setattr(lmscore, "SHARD", shard)
    monkeypatch.setattr(lmscore, "BLOCK_MOST", 1 << 26 if shard > 2000 else 2)
    monkeypatch.setattr(wordcut, "GROUP", 4 << 20 if shard > 2000 else 100)
    texts = babble(25, 200, "abcdefgh", 60)
    data = [(i if i % 7 else None, t, "own", "own") for i, t in enumerate(texts)] + [(None, texts[0], "own", "own")] * 40 + [(3, None, "own", "own")]
    df = spark.createDataFrame(data, "doc_id long, text string, block string, key string")
    found = []
    for parts in (1, 3, 8):
        docs = df.repartition(parts)
        scored = lmscore.score_texts(docs, lmscore.learn(docs.filter("doc_id is null or doc_id % 5 <> 1"), "doc_id"), keep=["doc_id", "text", "block", "key"]).collect()
        assert {(r.block, r.key) for r in scored} == {("own", "own")} and len(scored) == len(data)
        found.append(sorted((str(r.doc_id), r.text or "", r.n_tokens, r.base_score, r.score) for r in scored))
    for other in found[1:]:
        assert [x[:3] for x in other] == [x[:3] for x in found[0]]
        assert all(x[3:] == pytest.approx(y[3:], rel=1e-6) for x, y in zip(other, found[0], strict=True))


def test_copies_of_a_text_are_dealt_once(spark, monkeypatch):
    """Copies don't add up in a block: by characters, whatever the number of rows."""
    texts = babble(28, 20, "abcdef", 40)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *[texts[0] * 50] * 300])], "doc_id long, text string").repartition(6)
    learned = lmscore.learn(df.filter("doc_id < 20"), "doc_id")
    sent, dealt = [], lmscore.dealt
    monkeypatch.setattr(lmscore, "dealt", lambda spark, rows, n, by: sent.append(rows.count()) or dealt(spark, rows, n, by))
    scores = []
    for most in (1 << 30, 10_000):
        monkeypatch.setattr(lmscore, "BLOCK_MOST", most)
        scores.append({r.doc_id: r.score for r in lmscore.score_texts(df, learned).collect()})
    assert sent == [320, 21]
    assert scores[0].keys() == scores[1].keys() and all(scores[1][k] == pytest.approx(v, rel=1e-6) for k, v in scores[0].items())


def test_training_has_no_single_task_over_all_rows(spark, tmp_path):
    frame(spark, babble(26, 50)).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    coder = lmscore.Coder([lmscore.END, b"a"])
    rows = docs.select(F.lit(0).alias("shard"), F.xxhash64("text").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "text")
    coded = lmscore.dealt(spark, lmscore.code_texts(rows, coder), 4, "shard")
    assert "Coalesce" not in coded._jdf.queryExecution().executedPlan().toString()


def test_the_model_learns_order(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)]

    def chain():
        w = [rng.randrange(40)]
        for _ in range(60):
            w.append((w[-1] * 7 + rng.randrange(2)) % 40)
        return " ".join(vocabulary[k] for k in w)

    docs = frame(spark, [chain() for _ in range(1500)])
    learned = lmscore.learn(docs.filter("doc_id % 5 <> 1"), "doc_id")
    held = lmscore.score_texts(docs.filter("doc_id % 5 = 1"), learned).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > 0.8 * held.b


# --- 8


def test_simhash(spark):
    texts = babble(12, 60, "abc", 30)
    texts += [" ".join(w for k, w in enumerate(t.split()) if k != 5) for t in texts[:30]] + ODD + ["A B C", "a b  c"]
    df = frame(spark, texts).unionByName(spark.createDataFrame([(None, "lone text here now")], "doc_id long, text string"))
    got = rows(simhash.link_documents(df))
    fp = [brute.fingerprint(t) for t in texts]
    root = brute.components(len(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert [(got[i].fp % 2**64, got[i].component_id) for i in range(len(texts))] == list(zip(fp, root, strict=True))
    assert got[None].component_id is None
    kept = simhash.deduplicate(df.withColumn("fp", F.lit("clash")).unionByName(df.withColumn("fp", F.lit("clash"))), distance=3, words_more=0)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(root))
    assert simhash.link_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("words", "distance", "total", "direct", "small", "crowded"),
    [(1, 3, None, 2048, 24, 1 << 16), (1, 3, None, 16, 4, 1 << 16), (3, 7, 12, 2048, 24, 1 << 16), (3, 7, 12, 16, 4, 6), (1, 5, None, 8, 2, 1 << 16), (1, 3, None, 16, 4, 4), (1, 0, None, 16, 4, 1)],
)
def test_links_connect_what_near_pairs_connect(spark, monkeypatch, words, distance, total, direct, small, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "DIRECT", direct)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (60, words), dtype=np.uint64)
    fp = base[rng.integers(0, 60, 500)]
    for _ in range(distance):
        fp = np.where(rng.random(fp.shape) < 0.7, fp ^ (np.uint64(1) << rng.integers(0, 64, fp.shape, dtype=np.uint64)), fp)
    fp = np.unique(fp, axis=0)
    df = spark.createDataFrame([tuple(map(int, r)) for r in fp.view(np.int64)], ", ".join(f"{c} long" for c in simhash.word_names(words - 1)))
    name = (lambda r: int(r.view(np.int64)[0])) if words == 1 else (lambda r: r.astype(">u8").tobytes())
    number = {name(r): k for k, r in enumerate(fp)}
    links = {tuple(number[x if words == 1 else bytes(x)] for x in (r.a, r.b)) for r in simhash.fingerprint_links(df, distance, total).collect()}

    def near(a, b):
        x = np.bitwise_count(fp[a] ^ fp[b])
        return x[0] <= distance and (total is None or x[1:].sum() <= total)

    assert brute.components(len(fp), lambda a, b: (a, b) in links or (b, a) in links) == brute.components(len(fp), near)


@pytest.mark.parametrize(("steps", "block"), [(1, 2048), (40, 2048), (40, 6)])
def test_near_copies_are_those_of_the_exact_similarity(spark, monkeypatch, steps, block):
    """Pairs on either side of the similarity, far from what fingerprints can tell apart; also in clusters of many blocks."""
    monkeypatch.setattr(nearcopies, "BLOCK_NODES", block)
    if block < 100:
        monkeypatch.setattr(nearcopies, "HUBS", 2)
        monkeypatch.setattr(nearcopies, "CROWDED", 3)
        monkeypatch.setattr(simhash, "CROWDED", 8)
    rng = random.Random(20)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(base))
        for _ in range(6 if steps == 1 else 2):
            edited = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * rng.randint(1, 6) // 150)):
                edited[at] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
    if steps > 1:  # a group whose texts are alike only in turn, and a passage that many share
        passage = " ".join(rng.choice(vocabulary) for _ in range(40))
        base = [rng.choice(vocabulary) for _ in range(150)]
        for k in range(steps):
            base[(k * 7) % 150] = rng.choice(vocabulary)
            texts += [" ".join(base), f"{passage} " + " ".join(rng.choice(vocabulary) for _ in range(60))]
    sets = [brute.shingle_set(t) for t in texts]
    root = brute.components(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    near = sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a))
    kept = simhash.deduplicate(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and near > 30
    assert simhash.deduplicate(frame(spark, texts).limit(0)).count() == 0


def test_rows_with_null_or_repeated_ids_stay_apart(spark):
    def prose(seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))

    texts = [prose(k) for k in range(6)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[3]), (1, texts[4]), (2, texts[5]), (3, texts[0]), (2, texts[5])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = {(None, texts[1]), (None, texts[2]), (1, texts[3]), (1, texts[4]), (2, texts[5]), (3, texts[0])}
    for words_more in (None, 0, 2):
        kept = [tuple(r) for r in simhash.deduplicate(df, words_more=words_more).collect()]
        assert len(kept) == len(want) and set(kept) == want
    items = spark.createDataFrame([(0, texts[1]), (1, texts[4])], "item_id long, text string")
    clean = [tuple(r) for r in decontam.remove_leaks(df, items).collect()]
    assert len(clean) == 6 and set(clean) == {d for d in data if d[1] not in (texts[1], texts[4])}


def test_spans_are_those_of_the_row(spark, monkeypatch):
    """Two texts without an id whose 32-bit hashes are equal."""
    seen, n = {}, 0
    while True:
        part = spark.range(n, n + 200_000).select("id", F.hash(F.concat(F.lit("a passage of its own, numbered "), F.col("id"))).alias("h")).collect()
        pair = next(((seen[r.h], r.id) for r in part if seen.setdefault(r.h, r.id) != r.id), None)
        if pair:
            break
        n += 200_000
    a, b = (f"a passage of its own, numbered {k}" for k in pair)
    df = spark.createDataFrame([(None, a), (None, b), (1, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in suffixdedup.remove_repeats(df, length=len(a), gram=8).collect())
    assert got == sorted([(0, a, len(a)), (0, b, 0), (1, a, len(a))])


@pytest.mark.parametrize("many", [50_000, 1])
def test_components(spark, monkeypatch, many):
    monkeypatch.setattr(components, "MANY", many)
    chain = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (3, 2), (2, 3), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 150)} | {201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9


def test_language_id(spark):
    rng = random.Random(13)
    stems = {"xx": ["lor", "mip", "sut"], "yy": ["graz", "thun", "öch"], "zz": ["ний", "мост", "река"]}
    data = []
    for i in range(150):
        lang = rng.choice(sorted(stems))
        data.append((i, " ".join(rng.choice(stems[lang]) + rng.choice("aeiou") for _ in range(30)), lang))
    data += [(200, None, "xx"), (201, "12 !?", "xx"), (202, "lora mipi", None), (203, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df.filter("doc_id % 2 = 0"))
    assert sorted(r.lang for r in profiles.collect()) == ["xx", "yy", "zz"]
    got = rows(langid.predict(df.withColumn("score", F.lit("clash")), profiles, keep=["doc_id"]))
    assert all(got[i].lang_pred == lang for i, _, lang in data[:150])
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["und", "und", "xx", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(df, profiles.limit(0), keep=["doc_id"]).collect()} == {"und"}
    assert langid.learn_profiles(df.limit(0)).count() == 0 and langid.predict(df.limit(0), profiles).count() == 0


def rank_order(texts, langs, size):
    """Language and score of each text by a plain rank-order comparison."""
    counts = [brute.grams(t) for t in texts]
    total = {}
    for c, k in zip(counts, langs, strict=True):
        if k:
            total.setdefault(k, Counter()).update(c)
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]]
    profiles = {k: order(c) for k, c in sorted(total.items()) if c}
    out = []
    for c in counts:
        own = order(c)
        if not own:
            out.append(("und", 0.0))
            continue
        away = {k: sum(min(abs(i - p.index(g)), size) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(away, key=lambda k: (away[k], k))
        out.append((best, 1 - away[best] / (size * len(own))))
    return out


@pytest.mark.parametrize(("piece", "languages"), [(1 << 20, 1024), (7, 2)])
def test_out_of_place_distance(spark, monkeypatch, piece, languages):
    monkeypatch.setattr(langid, "LANGUAGES", languages)
    rng = random.Random(22)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for letters in ["abc É.", "bcd é 1", "日本語 ab,", "ний\nмост", "αβγΣ "] for _ in range(12)] + ODD
    langs = [[None, "a", "b", "c", "d", "e"][rng.randrange(6)] for _ in texts]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    got = rows(langid.predict(df, langid.learn_profiles(df, size=20), keep=["doc_id"], size=20))
    want = rank_order(texts, langs, 20)
    assert [(got[i].lang_pred, pytest.approx(got[i].score)) for i in range(len(texts))] == want


def test_texts_in_pieces(monkeypatch):
    letters, rng = langid.Letters(), random.Random(23)
    for piece in (1, 2, 3, 5, 1 << 20):
        monkeypatch.setattr(langid, "PIECE", piece)
        for _ in range(150):
            text = "".join(rng.choice("ab É. ,日\n") for _ in range(rng.randint(0, 14)))
            grams, counts = langid.counted(langid.pieces(letters, text))
            assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == brute.grams(text)
    monkeypatch.setattr(langid, "PIECE", 40)
    total, parts = langid.Totals(), list(langid.pieces(letters, "abc def " * 200))
    for p in parts:
        total.add(p)
    grams, counts = total.settle()
    assert len(parts) > 30 and dict(zip(grams.tolist(), counts.tolist(), strict=True)) == brute.grams("abc def " * 200)


# --- 10


def test_quality_base(spark):
    texts = babble(14, 150, "ab#|", 60) + [t.replace(" ", "\n") for t in babble(15, 50, "ab", 30)] + ODD + ["w " * 50, "a b c d e a b c d e", "é " * 12]
    got = rows(quality.apply_quality(frame(spark, texts).withColumn("kept", F.lit("clash")), keep=["doc_id"]))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), t
        assert not (r.base_failed and r.kept)
    assert quality.apply_quality(frame(spark, texts).limit(0)).count() == 0


def test_quality_lines(spark):
    prose = "The first line says a thing at some length.\nAnother line says something else, and ends."
    texts = [prose, prose + "\nHome | News | About | More", "Home | News | a | b | c | d | e\nx | y | z | w | v", prose + "\n" + prose, "All rights reserved. " * 1 + "\n" + prose, "###### ##### #### ### ## # #### ### ## ##### ####### ####"]
    got = rows(quality.apply_quality(frame(spark, texts), clean=True))
    assert [got[i].kept for i in range(6)] == [True, True, False, False, True, False]
    assert got[0].clean_text == prose == got[1].clean_text == got[4].clean_text


def test_boilerplate_must_be_words_and_dominate_the_line(spark):
    prose = "They came down from the hills in spring, with mules and empty sacks, to trade for salt at the river towns below"
    texts = [
        f"{prose} powered by wind and by rain; nobody knew how long it had been so, or cared",
        f"{prose} read more slowly than others do, and subscribe to no paper at all",
        f"{prose}\nA catalog in hand\nIt spread more widely\nThey design up there",
        f"{prose}\nCopyright \u00a92020 Someone\nRead more\nShare this.",
        "click here to log in or sign up and read more about the privacy policy and the terms of use of this site",
    ]
    got = rows(quality.apply_quality(frame(spark, texts), clean=True))
    assert [got[i].kept for i in range(5)] == [True, True, True, True, False]
    assert [got[i].clean_text for i in range(4)] == [*texts[:3], prose]


def test_one_word_over_and_over_after_others():
    line = b"three other words " + b"same " * 16
    assert quality.line_fails(line, line.split(), quality.Rules())
    assert not quality.line_fails(b"three other words and then same same same", b"three other words and then same same same".split(), quality.Rules())


def test_punctuation_of_lines():
    fails = lambda line: quality.line_fails(line.encode(), line.encode().split(), quality.Rules())
    assert fails("THE!! ERHEAT!! TIHAING!! ERONBLE!! ANHAER!! THIS.") and fails("About us") and fails("Home page\u00a0")
    for line in ["Yes.", "\u00abOui.\u00bb", "\u00bfQu\u00e9?", "\u201eJa.\u201c", "\u65e5\u672c\u3002", "She said: no, never, not once, and left.", "A line that was wrapped where no sentence ends"]:
        assert not fails(line), line


def test_common_lines_are_counted_over_documents(spark, monkeypatch):
    rng = random.Random(27)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    prose = lambda n=30: " ".join(word() for _ in range(n)) + "."
    heading, copied = "News of the river towns.", f"{prose()}\nA short line.\n{prose()}"
    texts = [f"{heading}\n{prose()}\n{prose()}" for _ in range(30)] + [copied] * 40 + [f"{heading}\n{heading}\n{heading} {heading}"]
    got = rows(quality.apply_quality(frame(spark, texts).repartition(3), clean=True))
    assert all(got[i].kept and got[i].clean_text == texts[i].split("\n", 1)[1] for i in range(30))
    assert all(got[i].kept and got[i].clean_text == copied for i in range(30, 70))
    assert not got[70].kept
    few = rows(quality.apply_quality(frame(spark, texts[:15]), clean=True))
    assert all(few[i].clean_text == texts[i] for i in range(15))


# --- all


def test_columns_that_clash(spark):
    """Columns of the caller named like the operators' own temporary ones are kept."""
    names = ["text_", "block", "key", "key_", "own_", "id", "th", "row", "node", "shard", "spans", "url_", "won"]
    text = " ".join(f"word{k} and" for k in range(40))
    df = spark.createDataFrame([(i, f"{text} {i} end.", "en", *["mine"] * len(names)) for i in range(4)], ", ".join(["doc_id long, text string, lang string", *(f"{n} string" for n in names)]))
    items = spark.createDataFrame([("item", "nothing of the kind is in any of these")], "item_id string, text string")
    made = [
        bpe.encode(df),
        quality.apply_quality(df),
        langid.predict(df, langid.learn_profiles(df)),
        lmscore.score_texts(df, lmscore.learn(df, "doc_id"), keep=df.columns),
        suffixdedup.remove_repeats(df, length=20, gram=8),
        decontam.remove_leaks(df, items),
        urlfilter.judge_urls(df, urlfilter.rules_frame(spark, urlfilter.CONTRACT_RULES), url="text"),
    ]
    for out in made:
        got = out.collect()
        assert len(got) == 4 and all(r[n] == "mine" for r in got for n in names)
    assert all(r[n] == "mine" for r in simhash.deduplicate(df).collect() for n in names)


def test_ids_of_other_types(spark):
    text = "a passage that two rows hold in full, long enough"
    df = spark.createDataFrame([("a", text), ("b", text), (None, "another text"), ("a", "x")], "doc_id string, text string")
    items = spark.createDataFrame([("q1", "a passage that two rows hold"), (None, "another text")], "item_id string, text string")
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in decontam.find_leaks(df, items, short=True).collect()))) == sorted(map(str, [("a", "q1"), ("b", "q1"), (None, None)]))
    assert sorted(r.n_removed for r in suffixdedup.remove_repeats(df, length=20, gram=8).collect()) == [0, 0, len(text), len(text)]
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(df).collect()) == ["None", "a", "a"]
    assert {r.component_id for r in simhash.link_documents(df.filter("text like '%passage%'")).collect()} == {"a"}


def test_long_texts(spark):
    """Texts of megabytes, longer than any piece, segment or block that the operators cut."""
    rng = random.Random(28)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(500_000))
    texts = [long, long + " tail", "short one"]
    df = frame(spark, texts).withColumn("lang", F.lit("xx"))
    assert [r.fp % 2**64 for r in sorted(simhash.link_documents(df).collect())] == [brute.fingerprint(t) for t in texts]
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == {0, 2}
    removed = rows(suffixdedup.remove_repeats(df, keep=["doc_id"]))
    assert (removed[0].n_removed, removed[1].n_removed, removed[2].n_removed) == (len(long), len(long), 0)
    item = spark.createDataFrame([(0, " ".join(long.split()[-30:]))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.find_leaks(df, item).collect()) == [0, 1]
    encoded = rows(bpe.encode(df, keep=["doc_id"]))
    assert [encoded[i].decoded_sha256 for i in range(3)] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert {r.lang_pred for r in langid.predict(df, langid.learn_profiles(df)).collect()} == {"xx"}
    assert [rows(quality.apply_quality(df))[i].n_words for i in range(3)] == [500_000, 500_001, 2]


def test_folders(spark, monkeypatch, tmp_path):
    """Tables that nothing reads any more are deleted; off a local master there is no folder of this machine."""
    with common.passing(spark):
        path = common.shared_folder(spark, "passing")
        df = common.written_to(spark.range(3), path)
        assert df.count() == 3 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))

    class Far:
        master = "spark://far:7077"

        class _jsc:
            sc = staticmethod(lambda: Far)

        getCheckpointDir = staticmethod(lambda: Far)
        isDefined = staticmethod(lambda: False)

    class Session:
        sparkContext = Far

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Session, "x")


def test_long_texts_of_conversations_and_urls(spark):
    mixed = "a😀[|" * 250_000
    rows = [(1, 0, "user", mixed), (1, 1, "assistant", "\\" + mixed)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, said string")
    kind = chat.PART
    parts = F.array(F.struct(F.lit("text").alias("kind"), F.col("said").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units")), F.struct(F.lit("im age").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("r").alias("ref"), F.lit(1).cast("bigint").alias("units")))
    back = chat.read_back(chat.format_conversations(df.withColumn("parts", parts.cast(f"array<{kind}>")))).first()
    assert [(t.role, t.text, [(p.kind, p.ordinal) for p in t.parts]) for t in back.turns] == [(r, t, [("text", None), ("im age", k + 1)]) for k, (_, _, r, t) in enumerate(rows)]
    hosts = ["a." * 500_000 + "evil.com", "." * 1_000_000, "x" * 1_000_000 + ".evil.com", "evil.com.b"]
    urls = spark.createDataFrame([(k, f"http://{h}/p/{'q' * 1_000_000}") for k, h in enumerate(hosts)], "page_id long, url string")
    rules = urlfilter.rules_frame(spark, [("block", "evil.com", "/p"), ("allow", "a.evil.com", "/p/q")])
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(urls, rules).select("page_id", "rule", "verdict").collect()}
    assert got == {0: ("a.evil.com/p/q", "allow"), 1: (None, "allow"), 2: ("evil.com/p", "block"), 3: (None, "allow")}


def test_marks_stay_with_their_letters(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 3)
    letters = langid.Letters()

    def words(text):
        grams = np.concatenate([[], *langid.pieces(letters, text)]).astype(np.int64)
        one = [int(g) for g in grams if g < 1 << 21]
        three = Counter(tuple(int(g) >> k & (1 << 21) - 1 for k in (42, 21, 0)) for g in grams if g >= 1 << 42)
        return "".join(map(chr, one)), three

    assert words("हिन्दी")[0] == "हिन्दी" and words("ไทยกำลัง, e\u0301t\u00e9 ")[0] == "ไทยกำลังe\u0301t\u00e9"
    assert words("\u0301a \u0301\u0302b\u0301\u0302 1\u0301")[0] == "ab\u0301\u0302"
    assert words("\u0301 \u0302")[0] == ""
    assert words("a\u0301b")[1] == Counter({(32, 97, 0x301): 1, (97, 0x301, 98): 1, (0x301, 98, 32): 1})


def test_partitions_decide_sketches_filters_and_documents(spark):
    """Sizes follow from the partition, filters share a bounded space, and a short document isn't asked for large items."""
    assert decontam.partition(8) == decontam.partition(15) == 4
    assert {decontam.sketch_size(n, 0.8)[0] for n in range(8, 16)} == {7} and decontam.least_shingles(4, 0.8) == 7
    words = lambda a, n: " ".join(f"w{k}" for k in range(a, a + n))
    items = decontam.keyed_items(spark.createDataFrame([(1, words(0, 100)), (2, words(0, 8)), (3, "one two")], "item_id long, text string"), "item_id", "text")
    sketches = decontam.sketch_items(items, 5, 0.8, True)
    filters = decontam.hash_filters(sketches)
    assert {k: v for k, v in sketches.groupBy("words", "part").count().rdd.map(lambda r: ((r.words, r.part), r["count"])).collect()}.keys() == filters.keys() - {(0, 0)} == {(5, 7), (5, 3), (2, 1)}
    assert len(filters.pop((0, 0))) == 1 << (decontam.FILTER_BITS - 3) >= sum(len(v) for v in filters.values())
    docs = spark.createDataFrame([(b"short", words(0, 30)), (b"long", words(0, 90)), (b"none", words(500, 90))], "row binary, text string")
    hits = {bytes(r.row): {h.part for h in r.hits} for r in decontam.possible_hits(docs, sketches, 5, 0.8).collect()}
    assert hits == {b"short": {3}, b"long": {3, 7}}
    assert decontam.hash_filters(sketches.limit(0)).keys() == {(0, 0)}


def test_keys_of_words_differ():
    own = [f"{a}1{'0' * k}" for a in "123" for k in range(5, 15)] + [f"x{chr(c + 1)}{chr(c) * k}z" for c in (45, 61, 97) for k in range(4, 15)] + ["xcb" + "ab" * k for k in range(2, 8)]
    assert len(set(wordcut.Words([w.encode() for w in own]).keys().tolist())) == len(own)
