import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tonearm.llm import packing as m
from tonearm.llm.queries import vocabulary_file

WORDS = vocabulary_file("word_bpe_49k.json")


def holds(lengths, where, offset, fill, capacity):
    bins = defaultdict(list)
    for n, w, o, f in zip(lengths, where, offset, fill, strict=True):
        bins[w].append((o, n, f))
    for items in bins.values():
        at = 0
        for o, n, _ in sorted(items):
            assert o == at
            at += n
        assert at <= capacity and {f for _, _, f in items} == {at}
    return len(bins)


def test_bins_are_sound_and_few():
    rng = random.Random(2)
    for capacity, draw in ((100, lambda: rng.randint(1, 100)), (100, lambda: rng.randint(20, 50)), (2048, lambda: min(2048, int(rng.lognormvariate(6, 1)) + 1)), (10, lambda: 10)):
        lengths = [draw() for _ in range(3000)]
        n = holds(lengths, *m.pack(lengths, capacity), capacity)
        plain = m.Bins(lengths, capacity)
        plain.best_fit()
        assert -(-sum(lengths) // capacity) <= n <= len(plain.items)
    assert m.pack([], 10) == ([], [], [])


def test_local_search_empties_a_bin_by_exchanges():
    # best fit needs four bins: (7, 2), (6, 3), (5, 4), (3); exchanges reach the three that hold 30
    lengths = [7, 6, 5, 4, 3, 3, 2]
    bins = m.Bins(lengths, 10)
    for b, items in enumerate(((0, 6), (1, 4), (2, 3), (5,))):
        bins.items.append(list(items))
        bins.fill.append(sum(lengths[i] for i in items))
        bins._list(b)
    before = sum(f * f for f in bins.fill)
    bins.local_search()
    assert sum(f * f for f in bins.fill) >= before and max(bins.fill) <= 10
    assert sorted(i for b in bins.items for i in b) == list(range(7))
    assert sum(bool(b) for b in bins.items) == 3


def check(spark, rows, capacity, window=50_000):
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = m.packed(docs, WORDS, capacity=capacity, window=window).collect()
    tok = Tokenizer.from_file(WORDS)
    want = []
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, p, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), max(m.pack([r.length for r in got], capacity)[0]) + 1


def test_documents(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["alpha", "be", "gamma", "delta!"], k=rng.choice((1, 5, 30, 200)))), "x") for i in range(200)]
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "no id", "x"), (7, "twice", "x"), (7, "twice", "x")]
    n, together = check(spark, rows, 64)
    assert n <= together + 2  # the tasks' tails meet in the second round
    n, together = check(spark, rows, 64, window=40)
    assert n <= together * 1.05 + 2


def test_empty_table(spark):
    assert m.packed(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
