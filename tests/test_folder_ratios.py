"""Strings of folders that meet: scored in one call for a pair, field by field until it cannot reach the threshold."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tonearm.functions import similarity
from tonearm.operators import pairs as p
from tonearm.plans import registry

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_a_pair_is_one_call_on_whole_folders(spark):
    """Not one for each field with a string for each file on either side."""
    plan = registry._pairs(spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("ratio_sums(") == 1 and "ratio_sum(" not in plan


def test_sums_of_folders_match_a_plain_version(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abc ñ\"\\\U0001f600", k=rng.choice([0, 3, 12, 30, 33, 62, 64, 80])))
    folders = []
    for _ in range(24):
        titles = [word() for _ in range(4)]
        folders.append([[f"{i} {t[:9]}.mp3" for i, t in enumerate(titles)], titles, ["album"] * 4, [rng.choice(["", "x", "xy"]) for _ in range(4)], [word()]])
    weights = [1.0, 0.5, 0.25, 0.5, 2.0]
    rows = [(i, k, json.dumps(x, ensure_ascii=k % 2 == 0), json.dumps(y), weights, rng.choice([None, 4.0, 7.0])) for i, x in enumerate(folders) for k, y in enumerate(folders)]
    df = spark.createDataFrame([*rows, (-1, -1, None, "[]", weights, None)], "i int, k int, a string, b string, weights array<double>, least double")
    got = {(r.i, r.k): r for r in df.select("*", similarity.ratio_sums("a", "b", "weights", "least").alias("sums")).collect()}
    assert got.pop((-1, -1)).sums is None
    ended = 0
    for (i, k), r in got.items():
        want = [sum(ratio(x, y) for x, y in zip(own, other, strict=True) if x and y) for own, other in zip(folders[i], folders[k], strict=True)]
        if r.least is not None and sum(x * w for x, w in zip(want, weights, strict=True)) < r.least:
            ended += r.sums is None
            assert r.sums is None or r.sums == pytest.approx(want)
        else:
            assert r.sums == pytest.approx(want, rel=1e-12), (i, k)
    assert ended > 100


def test_strings_with_null_characters_differ(spark):
    rows = spark.createDataFrame([(["a\0", "a"], ["a", "a\0b"])], "a array<string>, b array<string>")
    assert rows.select(similarity.ratio_sum("a", "b").alias("s")).first().s == ratio("a\0", "a") + ratio("a", "a\0b")


def test_many_common_blocks_together(monkeypatch):
    """Pairs are halved where they hold too many blocks; blocks at the last places, near copies, and texts of one character."""
    rng = random.Random(3)
    pairs = [("".join(rng.choices("ab", k=rng.randint(1, 63))), "".join(rng.choices("ab", k=rng.randint(1, 63)))) for _ in range(300)]
    pairs += [("a" * n, "a" * m) for n in (1, 31, 32, 62, 63, 64) for m in (1, 31, 32, 62, 63, 64)]
    pairs += [(x[:k] + "z" + x[k:62], x[:62]) for x in ("".join(rng.choices("abcdefgh", k=62)) for _ in range(40)) for k in (0, 30, 62)]
    want = [ratio(*x) for x in pairs]
    for most in (similarity.BLOCKS, 500):
        monkeypatch.setattr(similarity, "BLOCKS", most)
        assert list(similarity._ratios_of([a for a, _ in pairs], [b for _, b in pairs])) == want


def test_no_folder_that_holds_the_same_is_told_apart(spark):
    """Marks may meet without reason, never the other way; a missing value is one too."""
    rng = random.Random(2)
    own = {f"f{i:02d}": [rng.choice([None, f"h{rng.randrange(60)}"]) if rng.random() < 0.3 else f"u{i}" for _ in range(5)] for i in range(40)}
    rows = spark.createDataFrame([(f, h) for f, h in own.items()], "f string, h array<string>").withColumns(p.marks(F.col("h")))
    side = lambda k: rows.select(*[F.col(c).alias(f"{c}{k}") for c in rows.columns])
    got = side(1).crossJoin(side(2)).select("f1", "f2", p.apart().alias("apart"), p.equal_share("h1", "h2").alias("share")).collect()
    for r in got:
        assert r.share == sum(x == y for x, y in zip(own[r.f1], own[r.f2], strict=True)) / 5
        assert not (r.apart and r.share)
    assert sum(r.apart for r in got) > 300


def test_shared_counts(spark):
    row = spark.createDataFrame([(["1:1:av", "2:1:av", "1:1:bw", "3:2:abx"], ["1:1:av", "2:1:av", "1:1:bW", "3:2:abx"])], "a array<string>, b array<string>")
    r = row.select(p.shared_counts(F.col("a"), F.col("b")).alias("c")).first().c
    assert (r.total, r.distinct, [tuple(x) for x in r.scores]) == (3, 2, [("a", 2), ("ab", 1)])


def test_digits_of_a_report(spark):
    values = [0.0, 1.0, -0.0, 0.004, 0.005, 0.015, 0.125, 0.995, 0.9999, 99.995, 100.0, None]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select(p.two_digits(F.col("x")).alias("own"), F.format_number(F.abs("x"), 2).alias("theirs")).collect()
    assert [r.own for r in rows] == [r.theirs for r in rows] and rows[-1].own is None
    row = spark.createDataFrame([("a", "b", *[0.5] * 7, {"genre": 1.0, "k": 0.25}, 50.0), ("a", "c", *[None] * 7, None, 100.0)], "f1 string, f2 string, " + ", ".join(f"{k} double" for k in p.WEIGHTS) + ", additional_metadata map<string,double>, weighted_score double")
    got = {(r.f2, r.field): r.value for r in p.report(row).collect()}
    assert got == {("b", k): "0.50" for k in p.WEIGHTS} | {("b", "tag genre"): "1.00", ("b", "tag k"): "0.25", ("b", "weighted_score"): "50.00", ("c", "weighted_score"): "100.00"}
    plan = p.report(row)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" not in plan and "transform_values" not in plan
