from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import brute


def prose(rng, n):
    w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return ". ".join(" ".join(w[i : i + 12]) for i in range(0, n, 12)) + "."


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    base = [prose(rng, 150) for _ in range(25)]
    item = prose(rng, 30)
    passage = prose(rng, 70)
    words = base[1].split()
    texts = [*base, base[0], " ".join([*words[:70], "changed", *words[71:]]), f"{prose(rng, 100)} {passage} {prose(rng, 60)}", f"{prose(rng, 90)} {passage} {prose(rng, 80)}", f"{prose(rng, 100)} {item} {prose(rng, 50)}", "junk", None, "| a | b " * 40]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)

    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept[name] = {r.doc_id: r for r in out.collect()}
        now = out
    ids = {k: set(v) for k, v in kept.items()}
    assert ids["quality_rules"] == set(range(30))
    assert ids["simhash_near_dedup"] == set(range(30)) - {25, 26}
    cut = kept["suffix_array_dedup"]
    assert set(cut) == ids["simhash_near_dedup"]
    assert all(cut[i].text == texts[i] for i in range(25)) and passage not in cut[27].text and passage not in cut[28].text
    want = brute.repeats([texts[i] for i in sorted(cut)], 200)
    assert [len(cut[i].text) for i in sorted(cut)] == [w[0] - w[1] for w in want]
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert ids["benchmark_decontamination"] == ids["simhash_near_dedup"] - {29}
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(final) == ids["benchmark_decontamination"] and all(r.n_tokens == len(r.ids) for r in final.values())


def test_empty_tables_and_more_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).filter(F.lit(True)).count() == 0
