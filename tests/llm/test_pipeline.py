"""Each stage of the pipeline against a plain version, over the smallest tables."""

import re
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_near_texts import plain_kept
from tonearm.llm import toxicity
from tonearm.llm.shared import read_table, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    # the smallest table holds no credential, so some texts, backwards, are added with one each
    docs = read_table(spark, SF, "documents")
    more = [(10**9 + r.doc_id, r.text[::-1] + f" password=q8w7e6r5t4y{r.doc_id:04d}", r.lang, r.source, r.n_chars) for r in docs.orderBy("doc_id").limit(8).collect()]
    docs = source = stored(docs.unionByName(spark.createDataFrame(more, docs.schema)), "test-documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        tables.append({r.doc_id: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect())
        assert name == "best_fit_packing" or docs.columns == columns
    clean, exact, near, blotted, packed = tables

    toxic = {r.doc_id for r in toxicity.scores(source, read_table(spark, SF, "labels")).collect() if r.predicted}
    assert set(clean) == set(before) - toxic

    first = {}
    for i in sorted(clean):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", clean[i].text or ""), i)
    assert set(exact) == set(first.values())

    assert set(near) == set(plain_kept([(i, exact[i].text) for i in sorted(exact)])[0])

    assert set(blotted) == set(near)
    for i, r in blotted.items():
        assert r.n_chars == len(r.text)
        parts = [re.escape(p) for p in r.text.split("<secret>")]
        assert re.fullmatch("(?s)" + ".+?".join(parts), near[i].text)
    assert any("<secret>" in r.text for r in blotted.values())

    assert {r.doc_id for r in packed} == set(blotted)
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_run_is_the_stages_in_order(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
