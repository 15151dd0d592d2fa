"""Alignment against a plain version on whole texts, by the libraries alone."""

from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_byte_bpe import LONG, random_texts
from tonearm.llm import alignment
from tonearm.llm.queries import vocabulary_file

A, B = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model")


def plain(texts):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), from whole texts and all overlaps."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    cut, counts = [], Counter()
    for text in texts:
        cut.append(None)
        if not text:
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"" for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
            spans.append([(e - len(p), e) for e, p in zip(ends, parts, strict=True)])
        links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            to_i, to_j = [e for _, e in spans[0]].index(end) + 1, [e for _, e in spans[1]].index(end) + 1
            groups.append(",".join(map(str, ids_a[i:to_i])) + "|" + ",".join(map(str, ids_b[j:to_j])))
            i, j = to_i, to_j
        cut[-1] = (len(ids_a), len(ids_b), groups, links)
    most = Counter()
    for (_, second), n in counts.items():
        most[second] = max(most[second], n)
    return [(0, 0, 0, 0, 0, 0, "") if c is None else (c[0], c[1], len(c[2]), len(c[3]), sum(counts[x] == most[x[1]] for x in c[3]), sum(counts[x] for x in c[3]), ";".join(c[2])) for c in cut]


@pytest.mark.parametrize("block", [1, 500, 16 << 20])
def test_equals_plain(spark, block):
    texts = [None, "", "same words here", "same words here", "<|endoftext|> and </s> <unk>", "a▁b", *random_texts(120, seed=3), *[t[:400] for t in LONG], "Über naïve 東京 words, words", "word " * 300]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "`doc``id` long, text string, kind string, block int").repartition(3)
    found = {r["doc`id"]: tuple(r)[1:] for r in alignment.align(docs, A, B, "doc`id", block=block).collect()}
    assert [found[k] for k in range(len(texts))] == plain(texts)


def test_empty_and_nulls_alone(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(nothing, A, B).collect()), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_links_of_a_slice():
    """Ends 1, 4, 7 and 1, 5, 7 (the space stands alone): a slice of one link, then one of a chain of three."""
    own = alignment.Aligner(A, B)
    a, b = {v: k for k, v in enumerate(own.bytes_a)}, {v: k for k, v in enumerate(own.bytes_b)}

    class Said:
        def __init__(self, ids):
            self.ids = ids

        def encode_batch_fast(self, texts, add_special_tokens):
            return [self]

        def encode(self, text):
            return self.ids

    own.a, own.b = Said([a[b" "], a[b"the"], a[b"ing"]]), Said([b[b" "], b[b"thei"], b[b"ng"]]) if b"thei" in b else Said([b[b" "], b[b"the"], b[b"i"], b[b"ng"]])
    groups, pairs, numbers = own.aligned(["theing"])
    n = len(own.b.ids)
    assert numbers.tolist() == [[4, 3, n, 2 if n == 3 else 3]] and len(pairs) == 4 and groups[0].count(";") == numbers[0][3] - 1
