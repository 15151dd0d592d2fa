"""Each registered text query over the smallest tables: against its SQL, or against plain versions of its contract."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import test_quality_rules, test_simhash
from tests.test_registry import SF, TABLES, told
from tonearm.llm import queries
from tonearm.llm.shared import read_table


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in read_table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert sorted("|".join(told(r[c]) for c in columns) for r in found.collect()) == sorted("|".join(told(dict(zip(names, row, strict=True))[c]) for c in columns) for row in cursor.fetchall())


def test_token_queries(spark, docs):
    tok = Tokenizer.from_file(queries.vocabulary_file("word_bpe_49k.json"))
    ids = {i: tok.encode(r.text or "", add_special_tokens=False).ids for i, r in docs.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    start, want = 0, {}
    for i in sorted(ids):
        n = len(ids[i]) + 1
        want[i] = (start, n, crc([*ids[i], 2]))
        start += n
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, SF).collect()} == want

    pieces, bins = defaultdict(list), defaultdict(list)
    for r in queries.op9_best_fit_packing(spark, SF).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        own = [*x, 0]
        assert sorted(pieces[i]) == [(k, at, len(own[at : at + 2048]), crc(own[at : at + 2048])) for k, at in enumerate(range(0, len(own), 2048))]
    for items in bins.values():
        ends = [sum(n for _, n in sorted(items)[:k]) for k in range(len(items) + 1)]
        assert [o for o, _ in sorted(items)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= -(-sum(len(x) + 1 for x in ids.values()) // 2048) + 1

    coded = {r.doc_id: r for r in queries.op8_sentencepiece(spark, SF).collect()}
    assert coded.keys() == docs.keys() and all(r.same for r in coded.values())
    assert {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, SF).collect()} == {i: r.n_ids for i, r in coded.items()}


def test_rule_and_score_queries(spark, docs):
    found = {r.doc_id: r for r in queries.op4_quality_rules(spark, SF).collect()}
    assert found.keys() == docs.keys()
    for i, r in found.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == test_quality_rules.plain(docs[i].text)
        assert not (r.base_failed and r.kept)
    scores = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert scores.keys() == docs.keys()
    for i, r in scores.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_fingerprint_query(spark, docs):
    ids = sorted(docs)
    want = [test_simhash.plain_fingerprint(docs[i].text) for i in ids]
    roots = test_simhash.plain_components(want, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{fp:016x}", root) for i, fp, root in zip(ids, want, roots, strict=True)}
    assert all(re.fullmatch("[0-9a-f]{16}", fp) for fp, _ in got.values())
