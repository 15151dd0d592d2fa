import hashlib
import re
from collections import defaultdict

from tonearm.llm import exact_dedup as m

ROWS = [(5, "a  b", "x"), (2, "a\tb", "y"), (2, "a\tb", "y"), (9, None, "x"), (7, "", "x"), (None, "a b", "z"), (None, "lone", "z"), (3, "A b", None), (4, "wörd " * 3000, "x"), (1, "wörd\n" * 3000, "x"), (8, "A b", "q")]
SCHEMA = "doc_id long, text string, sha string"


def plain(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, taken = min(known, default=None), False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_match_a_plain_version(spark):
    got = [tuple(r) for r in m.exact_copies(spark.createDataFrame(ROWS, SCHEMA)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == plain(ROWS)


def test_rounds_do_not_change_the_result(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}", "s") for i in range(300)], SCHEMA)
    for runs, fan_in in ((1, 8), (2, 2), (20, 8), (10, 3), (9, 2)):
        got = {(r.keep_id, r.group_size) for r in m.exact_copies(docs.repartition(runs), fan_in=fan_in).collect()}
        assert got == {(i, len(range(i, 300, 7))) for i in range(7)}


def test_runs_are_sorted_and_merged_in_rounds(spark):
    rows = m.digest_runs(spark.createDataFrame([(i, f"text {i % 7}", "s") for i in range(300)], SCHEMA).repartition(9), "doc_id", "text")
    assert {r.run for r in rows.select("run").distinct().collect()} == set(range(9))
    plan = m.merge_runs(rows, fan_in=2)._jdf.queryExecution().executedPlan().toString()
    rounds = 1 + 4  # within each run, then 9, 5, 3, 2 runs become one
    assert plan.count("Exchange hashpartitioning(run") == rounds and plan.count("SortAggregate") == 2 * rounds and "HashAggregate" not in plan


def test_one_row_of_each_text_stays_with_all_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = m.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 7, None, 3, 1], key=str)


def test_columns_that_clash_come_back_unchanged(spark):
    names = ["__k", "__sha", "__keep", "__g", "row", "p", "at", "t", "run", "id", "sha", "repeats"]
    docs = spark.createDataFrame([(i, t, *range(n, n + len(names))) for n, (i, t) in enumerate([(1, "a"), (1, "a"), (2, "a "), (3, "b"), (None, "c"), (None, "c")])], "doc_id long, text string, " + ", ".join(f"`{x}` int" for x in names))
    got = sorted((tuple(r) for r in m.drop_exact_copies(docs).collect()), key=str)
    assert m.drop_exact_copies(docs).columns == docs.columns
    assert got == sorted([(1, "a", *range(12)), (2, "a ", *range(2, 14)), (3, "b", *range(3, 15)), (None, "c", *range(4, 16))], key=str)


def test_rows_with_maps_and_other_id_types(spark):
    docs = spark.createDataFrame([("x", "a", {"k": 1}), ("w", "a", {"k": 2}), ("w", "a", {"k": 2})], "doc_id string, text string, m map<string,int>")
    assert [tuple(r) for r in m.drop_exact_copies(docs).collect()] == [("w", "a", {"k": 2})]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert m.exact_copies(none).count() == 0 and m.drop_exact_copies(none).count() == 0
