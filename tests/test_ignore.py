"""Ignore rules as a relation against the same rules tried one by one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import ignore


def made_line(pick: random.Random) -> str:
    word = lambda: pick.choice(["a", "b", "ab", "lib", "x.log", "y.min.js", "f1", "f2", ".hid", "z~"])
    line = pick.choice([word(), "/" + word(), "*." + pick.choice(["log", "js", "py"]), word() + "/" + word(), "**/" + word(), word() + "/**", "f?", "[ab]*", "*~", "*", word() + "/*.py", "**/*.js", "a*.log", "lib/**/" + word()])
    return pick.choice(["", "", "", "!"]) + line + pick.choice(["", "", "/"])


def test_equals_rules_tried_one_by_one(spark):
    pick = random.Random(5)
    parts = ["a", "b", "ab", "lib", "x.log", "y.min.js", "f1", "f2.py", ".hid", "z~", "abc.log"]
    found = sorted({"/".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(300)})
    for seed in range(4):
        pick = random.Random(seed)
        lines = [(d, k, made_line(pick)) for d in ("", "a", "lib", "a/b", "a.b") for k in range(pick.randint(0, 12))]
        rules = [r for r in (paths.parse_ignore_line(line, d, k) for d, k, line in lines) if r]
        for is_dir in (False, True):
            rows = spark.createDataFrame([(p, is_dir) for p in [*found, None]], "path string, d boolean")
            got = {r.path: r.ignored for r in ignore.with_ignored(rows, ignore.rules_table(spark, lines), is_dir="d").collect()}
            one_by_one = {r.path: r.x for r in rows.filter("path is not null").select("path", paths.is_ignored(F.col("path"), rules, is_dir).alias("x")).collect()}
            assert got == one_by_one | {None: False}, seed


def test_ten_thousand_rules_in_one_plan(spark):
    lines = [("", k, f"/gen/out{k}/") for k in range(5000)] + [(f"d{k}", 0, f"!{k}.o") for k in range(5000)] + [("", 5000, "*.o")]
    rows = spark.createDataFrame([(f"gen/out{k}/x.c",) for k in range(0, 10000, 9)] + [(f"d{k}/{k + k % 2}.o",) for k in range(0, 6000, 7)], "path string")
    plan = lambda n: ignore.with_ignored(rows, ignore.rules_table(spark, lines[:n]))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(len(lines)).splitlines()) == len(plan(10).splitlines())
    got = {r.path: r.ignored for r in ignore.with_ignored(rows, ignore.rules_table(spark, lines)).collect()}
    want = {}
    for p in got:
        first = p.split("/")[0]
        want[p] = int(p.split("/")[1][3:]) < 5000 if first == "gen" else not (int(first[1:]) < 5000 and p == f"{first}/{first[1:]}.o")
    assert got == want


def test_rules_of_a_table_and_none(spark):
    lines = spark.createDataFrame([("", 0, "*.o"), ("", 1, "# x"), ("", 2, ""), (None, 3, None), ("a", 0, "[z-a]"), ("a", 1, "!k.o")], "directory string, ordinal int, line string")
    rows = spark.createDataFrame([("a/k.o", 1), ("k.o", 2), ("k.o", 2), ("k.c", 3)], "path string, ignored_by int")
    got = ignore.with_ignored(rows, ignore.parse_rules(lines))
    assert sorted(map(tuple, got.collect())) == [("a/k.o", 1, False), ("k.c", 3, False), ("k.o", 2, True), ("k.o", 2, True)]
    assert ignore.with_ignored(rows, ignore.parse_rules(lines.limit(0))).filter("ignored").count() == 0
