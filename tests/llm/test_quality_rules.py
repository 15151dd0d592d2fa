import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tonearm.llm import quality_rules as m

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def plain(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*base, len(w) < 10 or 100 * len(covered) > 20 * len(w))


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def test_counts_match_a_plain_version(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "a b c d e " * 2, "a b c d " * 3, "x " * 30, "l1\nl1\n \n\nl2\nl1", "é ü\xa0z # $$ <>|" * 4, "w" * 30_000, "one two three four five six " * 3000]
    texts += [" ".join(rng.choices("abc", k=rng.randint(1, 80))) for _ in range(60)] + [prose(rng, 200) + "\n" + prose(rng, 6) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in m.quality(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), (i, t and t[:50])
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(20, 2000)), "en", "a", "x") for i in range(300)]
    rows += [(1000 + i, " ".join(x + "###" for x in prose(rng, 200).split()), "en", "a", "x") for i in range(40)]
    got = {r.doc_id: r.kept for r in m.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(40))


def damaged(rng, n, percent):
    return " ".join(x + "#" * (len(x) * percent // 100 + 1) for x in prose(rng, n).split())


def test_nearly_half_of_a_group_may_be_damaged(spark):
    rng = random.Random(9)
    n, rows, bad = 400, [], set()
    for g, share in enumerate((0.1, 0.34, 0.45)):
        for i in range(n):
            broken = i < share * n
            bad |= {g * n + i} if broken else set()
            rows.append((g * n + i, damaged(rng, rng.randint(50, 800), rng.randint(10, 30)) if broken else prose(rng, rng.randint(20, 2000)), "en", f"s{g}", "x"))
    got = {r.doc_id: r.kept for r in m.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, kept in got.items() if not kept} == bad


def plain_statistics(text):
    n, chars, symbols, lines, repeats, _ = plain(text)
    s = (math.log1p(n), 4 * math.log1p(chars / max(n, 1)), 2 * math.log1p(100 * symbols / max(len(text), 1)), math.log1p(lines), math.log1p(100 * repeats / max(n, 1)))
    return [round(x * m.UNIT) / m.UNIT for x in s]


def plain_mcd(x, floor):
    """Squared distances of all rows to the regularised estimate of the nearest half: the better of two starts."""
    best, half, mad = None, -(-len(x) // 2), np.median(abs(x - np.median(x, axis=0)), axis=0)
    starts = [(x.mean(axis=0), np.cov(x.T, bias=True)), (np.median(x, axis=0), np.diag(np.square(1.4826 * mad)))]
    for mean, cov in starts:
        cov, near = cov + np.diag(np.square(floor)), None
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            after = set(np.argsort(d2, kind="stable")[:half])
            if after == near:
                break
            near, own = after, x[sorted(after)]
            mean, cov = own.mean(axis=0), m.CONSISTENCY * np.cov(own.T, bias=True) + np.diag(np.square(floor))
        found = (np.linalg.slogdet(cov)[1], d2)
        best = found if best is None or found[0] < best[0] else best
    return best[1]


def test_verdicts_equal_a_plain_estimate_of_least_determinant(spark):
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(15, 900)) + "".join("\n" + line for line in [prose(rng, 6)] * rng.choice((0, 0, 1, 2))) for _ in range(160)]
    texts += [damaged(rng, 100, rng.randint(1, 30)) for _ in range(70)]
    got = {r.doc_id: r for r in m.quality(spark.createDataFrame([(i, t, "en", "a", "x") for i, t in enumerate(texts)], SCHEMA)).collect()}
    judged = [i for i, t in enumerate(texts) if not plain(t)[-1]]
    want = plain_mcd(np.array([plain_statistics(texts[i]) for i in judged]), m.FLOOR)
    for i, d2 in zip(judged, want, strict=True):
        assert got[i].distance == pytest.approx(d2, rel=0.25, abs=2)
        assert got[i].kept == (d2 <= m.LIMIT) or abs(d2 / m.LIMIT - 1) < 0.1
    assert 60 <= sum(not got[i].kept for i in judged)


def test_equal_rows_single_rows_and_no_rows(spark):
    t = prose(random.Random(1), 50)
    rows = [(1, t, "en", "a", "x")] * 30 + [(2, t + " more", "de", "b", "x")]
    assert [r.kept for r in m.quality(spark.createDataFrame(rows, SCHEMA)).collect()] == [True] * 31
    assert m.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_factor_and_distance_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) * 1000).round().astype(int)
    rows = spark.createDataFrame([(1, *map(int, r)) for r in x], "g0 int, " + ", ".join(f"{s} long" for s in m.STATS))
    stats = m._factor(m._moments(rows.groupBy("g0").agg(*m._sums()), ["g0"]))
    got = sorted(r.d2 for r in m._distance(m._join(rows, stats, ["g0"])).collect())
    y = x / 1000
    cov = np.cov(y.T, bias=True) + np.diag(np.square(m.FLOOR))
    d = y - y.mean(axis=0)
    assert np.allclose(got, sorted(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
