"""Like names against all pairs by the standard matcher: short ones, long ones, and lists in which one index would find nearly all."""

import random
from difflib import SequenceMatcher

from tonearm.functions import similarity
from tonearm.operators import names as nm


def test_like_names_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    names = {"c" + str(rng.randint(0, 99999)) for _ in range(60)} | {"".join(rng.choices("abñ \U0001f600", k=rng.randint(0, 9))) for _ in range(60)}
    base = "".join(rng.choices("abcdefgh", k=24))
    names |= {base[:i] + rng.choice("xyz") * rng.randint(0, 4) + base[i + 2 :] for i in range(14)} | {base[:13] + "q" * k for k in range(9)}
    names = sorted(names)
    want = sorted((a, b) for a in names for b in names if a != b and SequenceMatcher(None, a, b).ratio() >= 0.8)
    got = nm.like_names(spark.createDataFrame([(n,) for n in names], "s string")).collect()
    assert len(want) > 200 and sorted((r.a, r.b) for r in got) == want


def test_few_names_of_digits_are_scored(spark, monkeypatch):
    """All have the same characters; before, most pairs were scored."""
    asked = []
    scored = similarity.scored
    monkeypatch.setattr(similarity, "scored", lambda pairs: (asked.append(pairs.count()), scored(pairs))[1])
    names = [f"c{i}" for i in range(1000, 9000, 13)]
    found = nm.like_names(spark.createDataFrame([(n,) for n in names], "s string")).count()
    assert 0 < found <= asked[0] <= 1.05 * found + 50
