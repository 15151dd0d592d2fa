"""The pair pipeline against a plain, nested-loop version."""

from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tonearm.functions import similarity
from tonearm.operators import names as nm
from tonearm.operators import pairs as p
from tonearm.operators import quality as q

TRACKS = (
    "root_ord int, folder_path string, folder_name string, parent_folder string, file string, ext string, pos int, size long, bitrate_bps long, bitrate_kbps int, "
    "tags map<string,string>, file_hash string, audio_fingerprint string, has_embedded_art boolean"
)


def folder(path, files, root=0):
    """files: (name, hash, kbps, tags)"""
    name, parent = path.split("/")[-1], path.split("/")[-2]
    return [(root, path, name, parent, f, "." + f.rsplit(".", 1)[1], i + 1, 10, (k or 0) * 1000, k, t, h, h, False) for i, (f, h, k, t) in enumerate(sorted(files, key=lambda x: x[0]))]


def tags(title, artist="זמר", album="אלבום", **more):
    return {"title": title, "artist": artist, "album": album, **more}


ROWS = [
    *folder("/m/a/one", [(f"0{i} שיר {c}.flac", f"h{i}", 320, tags(f"שיר {c}", lyrics="la")) for i, c in enumerate("אבגד", 1)]),
    *folder("/m/b/one", [(f"0{i} שיר {c}.flac", f"h{i}", 320, tags(f"שיר {c}", lyrics="la")) for i, c in enumerate("אבגד", 1)]),
    *folder("/m/c/One b", [(f"0{i} שיר {c}.mp3", f"h{i}" if i != 2 else "x", 128, tags(f"שיר {c}", genre="Pop")) for i, c in enumerate("אבגד", 1)]),
    *folder("/m/d/two", [(f"track 0{i}.mp3", None, 128, tags(f"Track {i}", "x", "y", genre="pop")) for i in range(1, 5)]),
    *folder("/m/e/three", [(f"{c}.mp3", None, 96, tags(c * 3, c, "z") if c != "b" else None) for c in "abcde"]),
    *folder("/m/f/tiny", [("a.mp3", "q", 128, tags("a")), ("b.mp3", "w", 128, tags("b"))]),
    *folder("/m/g/mixed", [("1.mp3", "r", 320, tags("a", "p", "k")), ("2.mp3", "s", 320, tags("b", "p", "l")), ("3.mp3", "t", 320, tags("", "p", "l")), ("4.mp3", "u", 0, tags("ùìåí", "p", "l"))]),
]
ART = [("/m/a/one", "cover.jpg", "A"), ("/m/b/one", "cover.jpg", "A"), ("/m/c/One b", "Folder.JPG", "A"), ("/m/d/two", "back.jpg", "B")]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def generic(names):
    import re

    plain = [re.sub(r"\d", "", n.rsplit(".", 1)[0] if "." in n[1:] else n) for n in names]
    found = [ratio(a, b) for a, b in combinations(plain, 2)]
    return sum(found) / len(found) if found else 0.0


def fixed(x):
    return "שלום"[:3] + "ם" if x == "ùìåí" else x


def plain_records():
    folders = {}
    for r in ROWS:
        folders.setdefault((r[0], r[1]), []).append(r)
    folders = {k: v for k, v in sorted(folders.items()) if len(v) > 2}
    info = {}
    for k, v in folders.items():
        read = [r for r in v if r[10] is not None]
        titles = [fixed(r[10]["title"]) for r in read if r[10]["title"]]
        covers = [h for f, n, h in sorted(ART) if f == k[1] and n.lower() in p_covers()]
        info[k] = read, generic([r[4] for r in v]), generic(titles), covers[0] if covers else None
    out = {}
    for a, b in combinations(folders, 2):
        (fa, sa, ta, ca), (fb, sb, tb, cb) = info[a], info[b]
        if len(fa) != len(fb):
            continue
        n = len(fa)
        hashes = sum(x[11] == y[11] for x, y in zip(fa, fb, strict=True)) / n
        if hashes == 1:
            out[a[1], b[1]] = 100.0
            continue
        adjust = lambda s: 1 - s * 0.5 if s > 0.7 else 1

        def mean(get, factor=1):
            both = [(get(x), get(y)) for x, y in zip(fa, fb, strict=True)]
            return sum(ratio(x.lower(), y.lower()) * factor if x and y else 0 for x, y in both) / n

        s = 5 * hashes + 3 * mean(lambda r: r[4], adjust(max(sa, sb))) + 2.5 * mean(lambda r: fixed(r[10]["title"]), adjust(max(ta, tb)))
        s += 2.5 * mean(lambda r: r[10]["album"]) + 1.5 * mean(lambda r: r[10]["artist"]) + 1.5 * ratio(a[1].split("/")[-1].lower(), b[1].split("/")[-1].lower()) + (1 if ca and ca == cb else 0)
        extra = {}
        for x, y in zip(fa, fb, strict=True):
            for key in (set(x[10]) & set(y[10])) - {"artist", "album", "title"}:
                if x[10][key].lower() == y[10][key].lower():
                    extra[key] = extra.get(key, 0) + 1 / n
        out[a[1], b[1]] = 100 * (s + 0.5 * sum(extra.values())) / (17 + 0.5 * len(extra))
    return out


def p_covers():
    from tonearm.operators.catalog import COVERS

    return COVERS


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, TRACKS), spark.createDataFrame(ART, "folder_path string, file string, art_hash string")


def test_weighted_scores_match_a_plain_version(data):
    want = plain_records()
    got = {(r.f1, r.f2): r for r in p.similar_pairs(*data, at_least=0).collect()}
    assert got.keys() == want.keys() and len(want) == 15
    for k, score in want.items():
        assert got[k].weighted_score == pytest.approx(score), k
    assert got["/m/a/one", "/m/b/one"].identical


@pytest.mark.parametrize("at_least", [30, 60, 85])
def test_pruning_loses_nothing(data, at_least):
    want = {k: s for k, s in plain_records().items() if s >= at_least}
    got = {(r.f1, r.f2): r.weighted_score for r in p.similar_pairs(*data, at_least=at_least).collect()}
    assert got == {k: pytest.approx(s) for k, s in want.items()}


def test_profiles_hold_their_files(data):
    got = {r.folder_path: r for r in p.profiles(*data, with_files=True).collect()}
    mixed = got["/m/g/mixed"]
    assert [(f.file, f.title, f.artist, f.album, f.bitrate, f.file_hash, f.extension) for f in mixed.files][-1] == ("4.mp3", fixed("ùìåí"), "p", "l", 0, "u", ".mp3")
    assert len(got["/m/e/three"].files) == 4 and got["/m/e/three"].n_files == 4 and mixed.files[0].metadata == tags("a", "p", "k")


def test_generic_scores_match_all_pairs(spark):
    folders = {"/x": ["track 1.mp3", "track 2.mp3", "intro.mp3", "track 3.mp3", "outro 4.mp3"], "/one": ["a.mp3"], "/same": [f"t{i}.mp3" for i in range(9)]}
    rows = spark.createDataFrame([(f, i, n) for f, names in folders.items() for i, n in enumerate(names)], "folder_path string, pos int, name string")
    assert {r.folder_path: r.score for r in p.generic_scores(rows).collect()} == {f: pytest.approx(generic(names)) for f, names in folders.items()}


def test_a_hot_key_meets_in_a_grid(spark):
    a, b = (spark.createDataFrame([(1 if i else 2, i) for i in range(60)] + [(3 if x == "x" else 4, 99)], f"n int, {x} int") for x in "xy")
    got = sorted((r.n, r.x, r.y) for r in nm.paired(a, b, "n", "x", "y", per_part=2).collect())
    assert got == sorted([(1, i, j) for i in range(1, 60) for j in range(1, 60)] + [(2, 0, 0)])
    plan = nm.paired(a, b, "n", "x", "y", per_part=2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scores_of_a_hot_second_string(spark):
    pairs = spark.createDataFrame([(f"name {i}", "name x") for i in range(50)] + [("a", "a"), (None, "b"), ("ab", "b"), ("ab", "b")], "a string, b string")
    got = {(r.a, r.b): r.ratio for r in similarity.scored(pairs, per_part=9).collect()}
    assert got == {(a, b): ratio(a, b) for a, b in [*[(f"name {i}", "name x") for i in range(50)], ("a", "a"), ("ab", "b")]}


def test_generic_scores_of_many_files_with_few_names(spark):
    """Pairs of files are never rows: 20,000 files with four names make 12."""
    import random

    rng = random.Random(3)
    names = [f"{rng.choice(['track', 'song', 'long name', 'x'])} {i}.mp3" for i in range(20_000)]
    rows = spark.createDataFrame([("/f", i, n) for i, n in enumerate(names)], "folder_path string, pos int, name string")
    plain, seen, total = [n.rsplit(".", 1)[0].rstrip("0123456789") for n in names], {}, 0.0
    for b in plain:
        total += sum(k * (1.0 if a == b else ratio(a, b)) for a, k in seen.items())
        seen[b] = seen.get(b, 0) + 1
    assert p.generic_scores(rows).first().score == pytest.approx(total / (20_000 * 19_999 / 2))


def test_index_keeps_ratios_few(spark):
    """Candidates of all turns are few, and hold every pair that reaches the gate."""
    import random

    rng = random.Random(7)
    parts = [["".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(3, 8))) for _ in range(60)] for _ in range(3)]
    names = sorted({" ".join(rng.choice(x) for x in parts) for _ in range(700)})
    own, _ = nm.bags(spark.createDataFrame([(n,) for n in names], "s string"))
    from pyspark.sql import functions as F

    got = {(r.a, r.b) for r in nm.candidates(own.withColumn("g", F.lit(0.8)), own, 0.8).collect()}
    assert {(a, b) for a in names[::7] for b in names if a != b and ratio(a, b) >= 0.8} <= got
    assert len(got) < len(names) ** 2 / 10


def test_nearest_of_another_list(spark):
    names = spark.createDataFrame([("abc", 0), ("", 1), ("qqq", 2), (None, 3)], "name string, ord int")
    others = spark.createDataFrame([("zz", 5), ("abd", 2), ("abc", 9), ("cab", 2), (None, 0)], "name string, ord int")
    got = {r.a: (r.b, r.ratio) for r in nm.nearest(names, others).collect()}
    assert got == {"abc": ("abd", ratio("abc", "abd")), "": ("abd", 0.0), "qqq": ("abd", 0.0)}


def test_a_hot_name_is_spread(spark):
    rows = spark.createDataFrame([(f"/{i}", "Hot" if i % 3 else f"name {i}", i) for i in range(90)], "folder_path string, folder_name string, ord int")
    names = {i: "hot" if i % 3 else f"name {i}" for i in range(90)}
    want = {(f"/{i}", f"/{j}") for i, j in combinations(range(90), 2) if ratio(names[i], names[j]) >= 0.8}
    assert {(r.f1, r.f2) for r in nm.similar_names(rows, per_part=3).collect()} == want


def test_reports(data):
    tracks, art = data
    pairs = p.similar_pairs(tracks, art, at_least=0).where("f1 = '/m/a/one'")
    got = {(r.f2, r.field): r.value for r in p.report(pairs).collect()}
    assert got["/m/b/one", "weighted_score"] == "100.00" and got["/m/b/one", "file_hash"] == "1.00"
    assert got["/m/c/One b", "file_hash"] == "0.75" and ("/m/c/One b", "tag genre") not in got
    quality = q.scores(tracks, p.profiles(tracks, art))
    parts = {(r.folder_path, r.part): r.percent for r in q.report(quality).collect()}
    assert parts["/m/a/one", "hebrew"] == 100 and parts["/m/g/mixed", "one_album"] == 0 and len(parts) == 9 * quality.count()


def test_second_comparison_matches_a_plain_version(spark, data):
    import re

    tracks, art = data
    alias = spark.createDataFrame([], "key string, value string")
    folders = {}
    for x in ROWS:
        folders.setdefault(x[1], []).append(x)
    covers = {f: h for f, n, h in ART if n.lower() in p_covers()}
    want = {}
    for (f1, a), (f2, b) in combinations(sorted(folders.items()), 2):
        n1, n2 = (f.split("/")[-1].lower() for f in (f1, f2))
        if n1 != n2 and ratio(n1, n2) < 0.8:
            continue
        clean = lambda rows: sorted(re.sub(r"[\W\d_]", "", r[4]) for r in rows)
        terms = [len(a) == len(b), ratio(clean(a), clean(b)), sum(x[10] == y[10] and x[10] is not None for x, y in zip(a, b, strict=False)) / min(len(a), len(b))]
        if f1 in covers and f2 in covers:
            terms.append(covers[f1] == covers[f2])
        for key in ("artist", "album"):
            v1, v2 = (next((r[10][key] for r in rows if r[10] and key in r[10]), None) for rows in (a, b))
            if v1 and v2:
                terms.append(v1.lower() == v2.lower())
        if sum(terms) / len(terms) >= 0.8:
            want[f1, f2] = round(sum(terms) / len(terms), 2)
    assert {(r.f1, r.f2): r.score for r in p.compare(tracks, art, alias).collect()} == want and want


def test_quality(data):
    tracks, art = data
    got = {r.folder_path: r for r in q.scores(tracks, p.profiles(tracks, art)).collect()}
    full = got["/m/a/one"]
    assert (full.hebrew, full.complete, full.cover, full.bitrate, full.one_artist, full.one_album, full.lossless, full.lyrics) == (1,) * 8
    assert full.quality == pytest.approx(100 * (13 + full.varied_names) / 14)
    assert (got["/m/g/mixed"].one_artist, got["/m/g/mixed"].one_album) == (1, 0)
    assert got["/m/g/mixed"].complete == 0.5 and got["/m/e/three"].complete == 1 and 0 < got["/m/d/two"].quality < 100
    assert "/m/f/tiny" not in got


def test_plans(spark):
    rows = spark.createDataFrame([("a", "b", 80.0, 90.0, 31.0), ("c", "d", 90.0, 90.0, 99.0)], "f1 string, f2 string, quality1 double, quality2 double, weighted_score double")
    assert sorted(tuple(r) for r in q.delete_plan(rows).collect()) == [("delete", "a", 31.0), ("manual", "c | d", 99.0)]


def test_preferred_copy(spark):
    rows = [(128.0, 256.0, 1.0, 0.0), (96.0, 64.0, 0.0, 1.0), (100.0, 128.0, 0.0, 0.0), (200.0, 150.0, 0.0, 0.0), (64.0, 96.0, 0.0, 1.0), (128.0, 128.0, 0.0, 1.0), (128.0, 128.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, bitrate1 double, bitrate2 double, quality1 double, quality2 double")
    got = [tuple(r)[1:] for r in df.select("i", q.prefers_first("high"), q.prefers_first("128"), q.prefers_first("other")).orderBy("i").collect()]
    assert got == [(False, True, False), (True, True, True), (False, False, False), (True, False, True), (False, True, False), (False, False, False), (True, True, True)]


def test_similar_names_match_all_pairs(spark):
    names = ["Best Of", "best of", "Best Off", "The Best", "Beast Of", "x", "xy", "", "Live 1999", "Live 1998"]
    rows = spark.createDataFrame([(f"/{i}", n, i) for i, n in enumerate(names)], "folder_path string, folder_name string, ord int")
    low = [n.lower() for n in names]
    want = {(f"/{i}", f"/{j}") for i, j in combinations(range(len(names)), 2) if low[i] == low[j] or ratio(low[i], low[j]) >= 0.8}
    assert {(r.f1, r.f2) for r in nm.similar_names(rows).collect()} == want


def test_nearest_names(spark):
    names = ["abc", "abd", "abe", "zzz", "abc"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")
    got = {r.a: (r.b, r.ratio) for r in nm.nearest(rows).collect()}
    for a in set(names):
        want = max(((ratio(a, b), -names.index(b)), b) for b in set(names) if b != a)
        assert got[a] == (want[1], want[0][0])
    assert nm.nearest(rows.where("name = 'zzz'")).count() == 0


def test_nearest_names_go_through_all_gates(spark):
    import random

    rng = random.Random(5)
    names = [f"{rng.choice(['red', 'blue', 'dark red'])} {rng.choice(['car', 'house', 'horse', 'mouse'])} {rng.randrange(30)}" for _ in range(60)] + ["q", "zz", "", "xylophone" * 5]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")
    got = {r.a: (r.b, r.ratio) for r in nm.nearest(rows).collect()}
    assert got.keys() == set(names)
    for a in set(names):
        want = max(((ratio(a, b), -names.index(b)), b) for b in set(names) if b != a)
        assert got[a] == (want[1], want[0][0])
    sure = {r.a: r.sure for r in nm.sure_matches(nm.nearest(rows)).collect()}
    assert sure == {a: x >= 1 - len(a.replace(" ", "")) * 0.01 for a, (_, x) in got.items()}


def test_pairs_and_positions_are_not_exchanged(data):
    """Whatever lies above the join of two folder rows runs in its tasks."""
    plan = p.similar_pairs(*data)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above and "HashAggregate" not in above and "ArrowEvalPython" in above


def test_sums_of_ratios(spark):
    rows = [(["abc", "x", "", None, "abcd"], ["abd", "x", "", "y", "bcda"]), (None, ["a"]), ([], []), (["ab" * 150], ["ba" * 140])]
    got = [r.s for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(similarity.ratio_sum("a", "b").alias("s")).collect()]
    assert got == [ratio("abc", "abd") + 1.0 + ratio("abcd", "bcda"), None, 0.0, ratio("ab" * 150, "ba" * 140)]


def test_high_thresholds_look_only_at_pairs_with_equal_hashes(spark):
    import random

    rng, rows, art = random.Random(4), [], []
    for i in range(60):
        more = {f"k{j}": "v" for j in range(40)} if i % 4 == 0 else {"lyrics": "la"}  # of 40 further tags hashes do not matter
        base = i // 12
        rows += folder(f"/m/{i}/same", [(f"{j} {base}.mp3", rng.choice([None, "hot", f"h{base}{j}", f"h{base}{j}", f"u{i}{j}"]), 128, tags(f"t{base}", **more)) for j in range(3 + base % 2)])
        art.append((f"/m/{i}/same", "cover.jpg", "A"))
    for c in "xy":
        rows += folder(f"/m/{c}/rich", [(f"{name}.mp3", f"{c}{name}", 128, tags(name, **{f"k{j}": "v" for j in range(60)})) for name in ("alpha", "quick", "zzz")])
        art.append((f"/m/{c}/rich", "cover.jpg", "A"))
    t, covers = spark.createDataFrame(rows, TRACKS), spark.createDataFrame(art, "folder_path string, file string, art_hash string")
    info = p.written(p.profiles(t, covers), "profiles")
    told = lambda df: sorted((r.f1, r.f2, r.n, r.identical, round(r.weighted_score, 9)) for r in df.collect())
    every = told(p.similar_pairs(t, covers, at_least=0.0, info=info))
    assert any(f1 == "/m/x/rich" and f2 == "/m/y/rich" and 85 < score < 90 for f1, f2, *_, score in every)
    for least in (85.0, 100.0):
        want = [x for x in every if x[-1] >= least]
        found = p.similar_pairs(t, covers, at_least=least, info=info)
        assert want and told(found) == want
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("\n") if "Join [" in x]
    assert joins and not any("Join [n#" in x for x in joins)  # not by count alone


def test_pairs_come_by_bundles(spark):
    """Within a cell a few folders of one side meet one of the other at a time: of 300 folders rows that follow each other hold few."""
    files = spark.range(300).select(F.format_string("/m/f%04d", "id").alias("folder_path"), F.lit(1).alias("pos"), F.format_string("%d.mp3", "id").alias("file"))
    met = p.same_count(files.withColumn("ord", F.struct(F.lit(0).alias("root_ord"), "folder_path")), "file")
    got = [(r.f1, r.f2, r.file1[0], r.file2[0]) for r in met.collect()]
    assert sorted(got) == [(f"/m/f{i:04d}", f"/m/f{j:04d}", f"{i}.mp3", f"{j}.mp3") for i in range(300) for j in range(i + 1, 300)]
    for k in range(0, len(got) - 1000, 500):
        for side in (0, 1):
            assert len({row[side] for row in got[k : k + 1000]}) < 3 * p.BUNDLE


def test_common_keys_are_told_in_order(spark):
    """Equal lists and others, whose texts may look alike."""
    rows = [("a", [["x", "b"], ["a, b"], []]), ("b", [["b", "x"], ["b", "a"], ["x"]]), ("c", [["x", "b"], ["a, b"], []])]
    files = spark.createDataFrame([(f, f, k, dict.fromkeys([*own, "title"], "v")) for f, lists in rows for k, own in enumerate(lists, 1)], "folder_path string, ord string, pos int, tags map<string,string>")
    keys = p.further_keys(F.col("tags"))
    told = p.common_keys_told(p.same_count(files.withColumns({"keys": keys, "told": p.listed_keys(keys)}), "keys", "told"))
    assert sorted(map(tuple, told.collect())) == [
        ("a", "b", 1, "[b, x]"), ("a", "b", 2, "[]"), ("a", "b", 3, "[]"), ("a", "c", 1, "[b, x]"), ("a", "c", 2, "[a, b]"), ("a", "c", 3, "[]"),
        ("b", "c", 1, "[b, x]"), ("b", "c", 2, "[]"), ("b", "c", 3, "[]"),
    ]
