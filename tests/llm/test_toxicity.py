import random
import zlib

from tonearm.llm import toxicity as m

LIMITS = m.Limits(rows=2000, trees=4, depth=3)


def table(spark, n=600):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeiou", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = rng.choices(words, k=rng.randint(10, 60))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["scumbag", "M0ron", "zzquer" + rng.choice("abc")])
        rows.append((i, " ".join(t), "x"))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: b for i, _, b in labels}


def test_learns_and_holds_out(spark):
    docs, labels, truth = table(spark)
    got = m.scores(docs, labels, LIMITS).collect()
    assert len(got) == 600
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(m.learned_from(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = {r.doc_id: r.score for r in m.scores(docs, flipped, LIMITS).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got)
    kept = m.drop_toxic(docs, labels, LIMITS)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)


def test_nulls_repeats_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "text", "x"), (2, "w " * 50_000, "x")], "doc_id long, text string, score string")
    got = m.scores(docs, spark.createDataFrame([(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int"), LIMITS).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.0}
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert m.scores(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), LIMITS).count() == 0


def test_second_person_proximity(spark):
    docs = spark.createDataFrame([(1, "you are a scumbag indeed"), (2, "scumbag one two three four five six you"), (3, "nothing here")], "doc_id long, text string")
    near = {r.doc_id: r.f_near > 0 for r in m.with_features(docs, ["0scumbag"]).collect()}
    assert near == {1: True, 2: False, 3: False}
