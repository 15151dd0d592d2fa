import os.path
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tonearm.functions import similarity, text


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_stem_and_extension_equal_the_standard_library(spark):
    rng = random.Random(1)
    names = ["", ".", "..", ".a", "a.", "a.b/c", "/x/.hidden", "a/b.Tar.GZ", "a\nb.mp3"] + ["".join(rng.choices("ab./\n", k=rng.randint(0, 9))) for _ in range(500)]
    assert column(spark, names, text.stem) == [os.path.splitext(n)[0] for n in names]
    assert column(spark, names, text.extension) == [os.path.splitext(n)[1].lower() for n in names]
    assert column(spark, names, text.base_name) == [os.path.basename(n) for n in names]


def test_digits_and_letters(spark):
    names = ["a1٣b", "Ⅷ½x²₃", "01 - שיר.mp3"]
    assert column(spark, names, text.strip_digits) == ["ab", "Ⅷ½x²₃", " - שיר.mp"]
    assert column(spark, names, text.letters_only) == ["ab", "Ⅷ½x", "שירmp"]


def test_mojibake(spark):
    assert column(spark, ["ùìåí òåìí", "plain English", "שלום", "élève à Besançon", None, ""], text.fix_mojibake) == ["שלום עולם", "plain English", "שלום", "élève à Besançon", None, ""]
    assert column(spark, ["שלום a", "abc", ""], text.contains_hebrew) == [True, False, False]


def test_track_word(spark):
    assert column(spark, ["Track 1", "my track", "TRAcks", "Other"], text.replace_track_word) == ["רצועה 1", "my רצועה", "רצועהs", "Other"]
    assert column(spark, ["Track 1", "My track"], lambda c: text.replace_track_word(c, keep_case=True)) == ["Track 1", "My רצועה"]


def test_repeating_names(spark):
    got = column(spark, ["Best Of - Track 01 best of", "A.+ - track 2", " - Track 3", "Song 4"], text.without_repeating_name)
    assert got == ["Track 01", "track 2", None, None]


def test_bitrate_score(spark):
    rows = spark.createDataFrame([(320.0,), (100.0,), (640.0,), (0.0,)], "x double")
    got = [tuple(r) for r in rows.select(text.bitrate_score(F.col("x")), text.bitrate_score(F.col("x"), "128"), text.bitrate_score(F.col("x"), "no")).collect()]
    assert got == [(1.0, 0.0, 0.0), (100 / 320, 1 - 28 / 192, 0.0), (1.0, 0.0, 0.0), (0.0, pytest.approx(1 - 128 / 192), 0.0)]


def test_ad_genres_and_required_similarity(spark):
    assert column(spark, ["Free DOWNLOAD", "pop", None], text.is_ad_genre) == [True, False, False]
    assert column(spark, ["ab cd", ""], text.required_similarity) == [pytest.approx(0.96), 1.0]


def pairs(n=400):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcd e", k=rng.randint(0, 12)))
    return [("", ""), ("Hello", "World"), ("Hello", "Hell"), ("x" * 10, "ab" * 150)] + [(word(), word()) for _ in range(n)]


def test_ratio_is_the_matchers(spark):
    rows = spark.createDataFrame(pairs(), "a string, b string")
    for r in rows.select("a", "b", similarity.seq_ratio("a", "b").alias("r")).collect():
        assert r.r == SequenceMatcher(None, r.a, r.b).ratio()
    lists = spark.createDataFrame([(["a", "b"], ["b"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(similarity.seq_ratio("a", "b")).collect()] == [pytest.approx(2 / 3), 1.0]


def test_scored_pairs_are_distinct_and_right(spark):
    rows = spark.createDataFrame([*pairs(50), ("a", "a"), ("a", "a"), (None, "a")], "a string, b string")
    got = similarity.scored(rows).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and all(r.ratio == SequenceMatcher(None, r.a, r.b).ratio() for r in got)


def test_bounds_never_fall_below_the_ratio(spark):
    rows = spark.createDataFrame(pairs(), "a string, b string")
    for r in rows.select("a", "b", similarity.length_bound(F.col("a"), F.col("b")).alias("l"), similarity.multiset_bound(F.col("a"), F.col("b")).alias("m")).collect():
        ratio = SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()
        assert ratio - 1e-12 <= r.m <= r.l + 1e-12
