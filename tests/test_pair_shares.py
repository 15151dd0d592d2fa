"""Shares of equal positions: told by numbers and marks of folders, with the results of a look at all values."""

import random

from pyspark.sql import functions as F

from tonearm.functions import similarity
from tonearm.operators import pairs as p
from tonearm.plans import registry

SF = "/root/testdata/sf0.001"


def library(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        base = rng.randrange(4)
        for k in range(1, 4):
            h = rng.choice([None, f"h{base}{k}", f"u{i}{k}", "hot"])
            tags = {"title": rng.choice([f"t{base}", f"t{i}"]), "genre": rng.choice(["Pop", "pop", ""]), **({"lyrics": "la"} if i % 3 else {})}
            rows.append((f"/m/f{i:02d}", k, h, tags))
    files = spark.createDataFrame(rows, "folder_path string, pos int, file_hash string, tags map<string,string>")
    return rows, files.withColumn("ord", F.struct(F.lit(0).alias("root_ord"), "folder_path"))


def plain(rows, alike):
    own = {}
    for f, _, h, t in rows:
        own.setdefault(f, []).append((h, t))
    return {(f, g): sum(alike(x, y) for x, y in zip(own[f], own[g], strict=True)) / 3 for f in own for g in own if f < g}


def test_numbers_stand_for_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a"), (5, "")], "i int, v string")
    got = {r.i: r.v for r in p.numbered_values(df, "v").collect()}
    assert got[1] == got[4] and got[2] is None and len({got[1], got[3], got[5]}) == 3 and len(got) == 5


def test_hashes_by_numbers_and_marks(spark):
    rows, files = library(spark)
    met = p.same_count(p.numbered_values(files.drop("tags"), "file_hash"), "file_hash", made=p.marks(F.col("file_hash")))
    got = {(r.f1, r.f2): r.file_hash for r in p.hash_fraction(met).collect()}
    assert got == plain(rows, lambda x, y: x[0] == y[0]) and 0.0 in got.values() and len(set(got.values())) > 2


def test_tags_by_numbers_and_marks(spark):
    rows, files = library(spark)
    entries = p.numbered_values(files.select("folder_path", "ord", "pos", p.tag_entries(F.col("tags")).alias("entries")), "entries")
    got = {(r.f1, r.f2): r.score for r in p.tag_equality(p.same_count(entries, "entries", made=p.marks(F.col("entries")))).collect()}
    assert got == plain(rows, lambda x, y: x[1] == y[1]) and len(set(got.values())) > 2


def test_extra_tags_of_folders_with_the_same_ones(spark):
    rows, files = library(spark)
    further = F.flatten("further")
    files = files.withColumn("further", p.further(F.col("tags"), F.col("pos")))
    met = p.same_count(files, "further", made={"further": further, "own": p.key_scores(further, further, F.col("n"))})
    got = {(r.f1, r.f2, r.key): r.score for r in p.extra_tags(met).collect()}
    want = {}
    for key in ("genre", "lyrics"):
        found = plain(rows, lambda x, y: bool(x[1].get(key)) and x[1][key].lower() == y[1].get(key, "").lower())  # noqa: B023
        want |= {(*k, key): x for k, x in found.items() if x}
    assert got == want


def test_lists_that_marks_tell_apart(spark):
    rng = random.Random(1)
    own = [sorted(rng.choices("abcdefghijklmnopqrst", k=rng.randint(0, 3))) for _ in range(30)]
    lists = spark.createDataFrame([(i, x) for i, x in enumerate(own)], "i int, l array<string>").withColumns(p.marks(F.col("l"), placed=False))
    side = lambda k: lists.select(*[F.col(c).alias(f"{c}{k}") for c in lists.columns])
    both = side(1).crossJoin(side(2))
    told = lambda df: sorted((r.i1, r.i2, r.ratio) for r in df.collect())
    assert told(similarity.list_ratios(both, "l1", "l2", p.apart())) == told(similarity.list_ratios(both, "l1", "l2"))


def test_values_stay_out_of_the_rows_that_meet(spark):
    """Numbers and marks meet, not hashes or tags; bundles that hold no earlier folder are left out before they are taken apart."""
    for name in ("hash_match_fraction", "tag_map_equality", "extra_tag_matches", "seq_ratio_list"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "ord1" not in plan and "least#" in plan, name
        assert name == "extra_tag_matches" or "mark01" in plan, name
