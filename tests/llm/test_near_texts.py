import random
import re

import numpy as np

import corpus_pipeline
from tonearm.llm import near_texts as m
from tonearm.llm.shared import read_table


def plain_shingles(text):
    text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Brute force over all pairs: the ids that are the smallest of their component."""
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                linked += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d for i, (d, _) in enumerate(rows) if d is None or d == least[find(i)]), key=str), linked


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def test_all_linked_documents_go(spark):
    rng = random.Random(8)
    line = "the same line stands at the head of every one of these texts"
    rows = [(None, "lone text without an id here"), (50, None), (40, ""), (41, "  "), (60, "One two"), (59, "one TWO"), (61, "one two three")]
    for i in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((30, 100, 400)))]
        rows.append((i * 20 + 100 + rng.randrange(20), f"{line} {' '.join(base)}"))
        for _ in range(rng.choice((0, 0, 1, 3))):
            rows.append((i * 20 + 100 + rng.randrange(20), f"{line} {' '.join(edited(rng, base, rng.randrange(1 + len(base) // 25)))}"))
    base = [f"h{i}" for i in range(120)]
    rows += [(9000 + i, " ".join(edited(rng, base, rng.randrange(4)))) for i in range(60)]  # a large cluster, linked over steps
    rows = list({d: (d, t) for d, t in rows}.values())
    want, linked = plain_kept(rows)
    for cell, sets in ((50_000, 2000), (8, 5)):  # buckets and clumps whole, and cut into many cells
        kept = m.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell, sets_in_cell=sets)
        assert linked > 100 and kept.columns == ["doc_id", "text"]
        assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_stage_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = corpus_pipeline.exact_dedup_stage(spark, read_table(spark, sf_dir, "documents"), sf_dir)
    want, linked = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert linked >= 5
    assert sorted((r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()), key=str) == want


def test_blocks_and_reach():
    assert m.reach(4, 5) == 59 and m.blocks(1000, 4, 5) == (8, 17)
    for n in (10, 10**5, 10**7, 10**10):
        width, tables = m.blocks(n, 4, 5)
        assert (1 - (1 - m.differing(4, 5)) ** width) ** tables <= 1 - m.RECALL and n >> width <= m.BY_CHANCE


def test_links_of_a_clump_equal_all_pairs():
    rng = np.random.default_rng(4)
    for wide in (3, 4096):
        base = rng.integers(0, 2**63, 60)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(40, 61), replace=False), rng.integers(0, 2**63, rng.integers(0, 6))]) for _ in range(30)] + [rng.integers(0, 2**63, 5), np.zeros(1, np.int64)]
        label = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 9 * k >= 4 * (len(sets[i]) + len(sets[j])):
                    m.joined(label, np.array([i]), np.array([j]))
        assert m.links_of(sets, 4, 5, wide).tolist() == label.tolist() and len(set(label)) < 30


def test_long_near_copies_are_cut_by_size(spark):
    """300 near copies of 20,000 words, and small ones: cells hold about as many hashes as asked for, and one of the long
    texts stays. The memory of a cell follows from its hashes."""
    import tracemalloc

    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 20_000)]
    rows = [(k, " ".join(base[:-1] + [f"end{k}"] if k % 2 else base[: 19_000 + k])) for k in range(300)] + [(1000 + k, f"only text {k} of its own kind here") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in m.drop_near_copies(docs, hashes_in_cell=400_000).select("doc_id").collect())
    assert kept == [0, *range(1000, 1020)]
    members = spark.createDataFrame([(0, 0, k, k % 7, 20_000 if k < 100 else 200) for k in range(3000)], "block int, part long, s long, c long, w int")
    for labelled in (members, members.drop("c")):
        held = labelled.transform(lambda df: m.in_cells(df, 400_000)).groupBy("cell").sum("w").collect()
        assert max(r[1] for r in held) < 1_000_000 and len(held) > 1
    sets = [np.unique(rng.integers(0, 2**63, 20_000)) for _ in range(50)]
    tracemalloc.start()
    m.links_of(sets, 4, 5, 512)
    assert tracemalloc.get_traced_memory()[1] < 80 * sum(map(len, sets))
    tracemalloc.stop()


def test_recall_at_the_limit():
    """Pairs of similarity 0.8 exactly: nearly all share a block and lie within reach."""
    rng, (width, tables) = np.random.default_rng(3), m.blocks(10**5, 4, 5)
    seeds = rng.integers(0, 2**64, max(4, -(-tables // (64 // width))), np.uint64)
    met = 0
    for _ in range(400):
        x = rng.integers(0, 2**64, 1000, np.uint64)
        a, b = m.fingerprints(x[:900], seeds), m.fingerprints(x[100:], seeds)
        d = a ^ b
        each = 64 // width
        blocks = [(int(d[t // each]) >> (t % each * width)) & ((1 << width) - 1) for t in range(tables)]
        met += 0 in blocks and np.bitwise_count(d[:4]).sum() <= m.reach(4, 5)
    assert met >= 0.97 * 400


def test_columns_that_clash(spark):
    names = ["__id", "row", "at", "gone", "id", "s", "f", "root"]
    docs = spark.createDataFrame([(i, t, *range(i, i + len(names))) for i, t in ((5, "a b"), (4, "A  b"), (9, "c"))], "doc_id long, text string, " + ", ".join(f"`{x}` int" for x in names))
    got = m.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(4, "A  b", *range(4, 12)), (9, "c", *range(9, 17))]


def test_empty_table(spark):
    assert m.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
