"""Collocations against a plain count of all phrases, and the tiles against plain sums."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tonearm.llm import collocations as c


def plain(rows, least, longest, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = {(lang, p[i:j]) for (lang, p), a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * f[lang, p[i:j]]}
    out = []
    for lang in n:
        own = []
        for (of, p), a in often.items():
            if of == lang and (lang, p) not in inside:
                score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(own)[:first], 1)]
    return sorted(out)


def random_rows(n, seed):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "dd", "É", "ñu", "the", "of", "x\x00", "日本", "ee\xa0e", *[f"r{k}" for k in range(200)]]
    chances = [1 / (k + 1) for k in range(len(words))]
    said = lambda: "".join(w + rnd.choice([" "] * 8 + ["\t", "  ", ". ", "\n", ",", " ; "]) for w in rnd.choices(words, chances, k=rnd.randint(0, 40)))
    return [(rnd.choice(["en", "en", "en", "de", None, ""]), said()) for _ in range(n)] + [("en", None), (None, ""), ("fr", " \t\n"), ("en", "a b " * 500), ("en", "a b " * 500)]


@pytest.mark.parametrize(("least", "longest", "first", "block"), [(3, 5, 2000, 1), (5, 5, 7, 400), (2, 3, 50, 32 << 20)])
def test_equals_plain(spark, monkeypatch, least, longest, first, block):
    rows = random_rows(150, least)
    docs = spark.createDataFrame([(k, lang, text, "x", 1) for k, (lang, text) in enumerate(rows)], "`do``c` long, lang string, text string, word string, block int").repartition(3)
    found = c.collocations(docs, least=least, longest=longest, first=first, block=block)
    assert sorted(map(tuple, found.collect())) == plain(rows, least, longest, first)


def test_nothing_to_find(spark):
    for rows in ([], [("en", "once only"), ("en", None)]):
        assert c.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_exact_beyond_64_bits(spark):
    """The score of made-up counts whose products pass 64 bits."""
    from pyspark.sql import functions as F

    a, n, left, right = 10**12 + 7, 3 * 10**13 + 1, 10**12 + 9, 2 * 10**12 + 3
    own = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(c.score("a", "n", F.col("l"), F.col("r")))
    assert own.first()[0] == 1000 * a * n // (left * right)


def test_bands_and_tiles():
    ranks = np.r_[np.arange(1, 5000), 2 ** np.arange(13, 40), 2 ** np.arange(13, 40) - 1]
    band, first, width = c.bands(ranks)
    assert ((first <= ranks) & (ranks < first + width)).all()
    assert (np.diff(band[:4999]) >= 0).all() and (np.diff(band[:4999]) <= 1).all()
    assert np.array_equal(np.stack(c.corner(band)), np.stack([first, width]))
    i, j = np.random.default_rng(1).permutation(ranks), ranks
    assert np.array_equal(np.stack(c.ranks_at(*c.placed(i, j))), np.stack([i, j]))


@pytest.mark.parametrize("high", [3, 40, 3000, 10**9])
@pytest.mark.parametrize("weighted", [False, True])
def test_tally_dense_and_sparse(high, weighted):
    rng = np.random.default_rng(high)
    i, j = (np.exp(rng.uniform(0, np.log(high), 5000)).astype(np.int64) for _ in "ij")
    n = rng.integers(1, 9, 5000) if weighted else None
    tile, cell, count, place = c.tally(*c.placed(i, j), n)
    want = Counter()
    for a, b, k in zip(i.tolist(), j.tolist(), n.tolist() if weighted else [1] * 5000, strict=True):
        want[a, b] += k
    left, right = c.ranks_at(tile, cell)
    assert dict(zip(zip(left.tolist(), right.tolist(), strict=True), count.tolist(), strict=True)) == want and len(count) == len(want)
    assert np.array_equal(left[place], i) and np.array_equal(right[place], j)
    assert (np.diff(tile) != 0).sum() == len(set(tile.tolist())) - 1  # a tile's pairs lie together


def test_steps_of_cells():
    cell, ends = np.array([5, 6, 70_000, 0, 2**40, 2**40 + 65_535, 7]), np.array([0, 3, 6, 6, 7])
    found, size = c.unpacked(*c.packed(cell, ends))
    assert np.array_equal(found, cell) and size.tolist() == [3, 3, 0, 1]


def test_sums_of_a_large_tile(spark, monkeypatch):
    """A tile is summed up in between, and pairs below the limit go only at the end."""
    made = [(int(c.placed(np.array([5]), np.array([9]))[0][0]), [0], [1]) for _ in range(50)] + [(int(c.placed(np.array([600]), np.array([9]))[0][0]), [k], [49]) for k in (3, 4, 4, 5)]
    tiles = spark.createDataFrame([(t, k, [0], n) for t, k, n in made], "tile long, low array<smallint>, high array<long>, n array<int>")
    found = c.sums(tiles, 50, at_once=4).collect()
    far = int(c.ranks_at(np.array([made[-1][0]]), np.array([4]))[0][0])
    assert sorted((r.i, r.j, r.n) for r in found) == [(5, 9, 50), (far, 9, 98)]


def test_frequent_pairs_come_back_a_row_for_a_block_and_a_task(spark):
    """Not a row for each; whatever their order and number, the same items have the same ranks."""
    rng = np.random.default_rng(3)
    found = [(rng.integers(0, 4, n), rng.permutation(n).astype(np.int64) + 7 * k * 1000, rng.integers(1, 2**31 - 1, n)) for k, n in enumerate((0, 500, 900))]
    want = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*found)), strict=True))
    for at_once in (1, 10**6):
        rows = [r for b in c.gathered(iter(found), at_once) for r in b.to_pylist()]
        assert len(rows) <= (8 if at_once == 1 else 4)
        assert sorted((r["block"], at, rank) for r in rows for at, rank in zip(np.cumsum(r["steps"]).tolist(), r["ranks"], strict=True)) == want
    assert not list(c.gathered(iter([(np.zeros(0, np.int64),) * 3])))
    i, j = np.repeat(np.arange(1, 41), 40), np.tile(np.arange(1, 41), 40)
    tile, cell, n, _ = c.tally(*c.placed(i, j))
    tiles = [(b, 1 + int(first), int(tile[first]), *(x.to_pylist()[0] for x in c.packed(cell[tile == tile[first]], np.array([0, (tile == tile[first]).sum()])))) for b in (5, 6) for first in np.flatnonzero(np.diff(tile, prepend=-1))]
    df = spark.createDataFrame(tiles, "block long, at long, tile long, low array<smallint>, high array<long>")
    left, right = c.ranks_at(tile, cell)
    frequent = spark.createDataFrame([(int(t), int(a), int(b), k) for k, (t, a, b) in enumerate(zip(tile, left, right), 1)], "tile long, i long, j long, rank long")
    back = c.met(df, frequent).collect()
    assert len(back) <= 2 * spark.sparkContext.defaultParallelism
    assert sorted((r.block, at, rank) for r in back for at, rank in zip(np.cumsum(r.steps).tolist(), r.ranks, strict=True)) == [(b, k, k) for b in (5, 6) for k in range(1, len(tile) + 1)]
