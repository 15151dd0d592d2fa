import random
import re

import numpy as np
import xxhash

from tonearm.llm import simhash as m


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, bits=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_matches_a_plain_version():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one two", "A b C d e", "ÄB äb\xa0x y z", "x " * 5000] + [" ".join(rng.choices("ab cd ef Gh ij éé".split(), k=n)) for n in range(1, 60)]
    for t in texts:
        assert m.fingerprint(t) == plain_fingerprint(t)
    long = " ".join(rng.choices("ab cd ef gh".split(), k=3000))
    assert m.fingerprint(long, chunk=100) == m.fingerprint(long)


def _clustered(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 2, 30))):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            out.append(base)
    return out[:n]


def test_index_finds_every_pair():
    for seed in range(5):
        fps = np.unique(np.array(_clustered(700, seed), np.uint64))
        index = m.GrayIndex(np.arange(len(fps)) % 3, fps)
        got = {tuple(sorted((int(index.fps[i]), int(index.fps[j])))) for a, b in index.pairs(4) for i, j in zip(a, b, strict=True)}
        want = {tuple(sorted((int(fps[i]), int(fps[j])))) for i in range(len(fps)) for j in range(i) if i % 3 == j % 3 and bin(int(fps[i]) ^ int(fps[j])).count("1") <= 4}
        assert got == want


def test_masks_cover_every_pair():
    rng = random.Random(1)
    for n in (10, 10**6, 10**8, 10**10):
        masks = m.masks(n, 4, 4096)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & k == 0 for k in masks)
    assert len(m.masks(10, 4, 4096)) < len(m.masks(10**10, 4, 4096))


def test_components_match_brute_force_also_with_split_buckets(spark):
    fps = _clustered(400, 9)
    want = plain_components(fps, list(range(len(fps))))
    nodes = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in set(fps)], "fp long")
    for cell, share in ((50_000, 4096), (6, 4096), (50_000, 1)):
        roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in m.components(m.links(nodes, share=share, cell=cell)).collect()}
        seen = {}
        for f, w in zip(fps, want, strict=True):
            assert seen.setdefault(roots.get(f, f), w) == w
        assert len(seen) == len(set(want))


def test_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "lone text without an id here", "c"), (50, None, "c"), (40, "", "c"), (41, "  ", "c")]
    for i in range(60):
        t = rng.choices(words, k=rng.choice((3, 80, 400)))
        rows.append((i * 10 + 100, " ".join(t), "c"))
        if i % 3 == 0:
            rows += [(i * 10 + 99, " ".join([*t, "tail"]), "c"), (i * 10 + 98, " ".join(t).upper(), "c"), (i * 10 + 98, " ".join(t).upper(), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in m.near_copies(docs).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    assert got == sorted(zip([r[0] for r in rows], fps, plain_components(fps, [r[0] for r in rows]), strict=True), key=str)
    kept = m.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _, c in got if i is None or i == c), key=str)


def test_empty_table(spark):
    assert m.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
