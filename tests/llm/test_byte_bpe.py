"""Merge replay against the tiktoken library, on the public file and on made-up ones, and the round trip."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import Row

from tonearm.llm import byte_bpe
from tonearm.llm.queries import vocabulary_file
from tonearm.llm.units import full, units

FILE = vocabulary_file("byte_bpe_multi_50k.tiktoken")
SIGNS = list("aaabbcdeth the  \n\n\t\r'sdDé ñ日本語שלום12٣½.,!?\x1c\x1f\x85\xa0 　_-🙂\x00ab▁")
LONG = ["a" * 5000, "ab" * 3000, "日" * 3000, " " * 300, "\n" * 50, "the\n\nend\n", " \nfoo", "\nfoo", "a \n b", "a\n "]


def random_texts(n, signs=SIGNS, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def library(codec):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=codec.ranks.tokens, special_tokens={})


def decoded(ids):
    return b"".join(map(byte_bpe.token_bytes(FILE).__getitem__, ids))


def ids_of(found):
    return None if found is None else np.frombuffer(found, "<u4").tolist()


def test_units_make_up_the_text():
    for text in random_texts(5000) + LONG:
        assert "".join(map(full, units(text))) == " " + text


def test_ids_are_those_of_the_library():
    codec = byte_bpe.ByteCodec(FILE)
    texts, own = [*random_texts(5000), *LONG, "aaaa", "aaaa"], library(codec)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids_of(ids) == own.encode_ordinary(text)
        assert decoded(ids_of(ids)) == text.encode()
    assert decoded(ids_of(*codec.encode(["xyx" * 100_000]))) == b"xyx" * 100_000


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_ranks(tmp_path, seed):
    """Files whose merges form pairs of lower ranks, pairs that overlap, and tokens that no merge makes."""
    rnd = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 330:
        new = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6)))
        if new not in tokens:
            tokens.append(new)
    tail = tokens[256:]
    rnd.shuffle(tail)
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens[:256] + tail)))
    codec = byte_bpe.ByteCodec(str(path), most_bytes=10_000)
    assert codec.ranks.early.any()
    for part in range(3):  # the cache is emptied in between
        texts = random_texts(400, list("abcabcabc c"), 10 * seed + part)
        own = library(codec)
        assert [ids_of(i) for i in codec.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_rows(spark):
    texts = [None, "", "same words", "same words", *random_texts(50), "word " * 20_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "no id", "x")], "`doc id` long, text string, ids string")
    codec = byte_bpe.ByteCodec(FILE)
    own = library(codec)
    found = byte_bpe.decode(byte_bpe.encode(docs, FILE, "doc id", block=100), FILE).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        text = "no id" if r["doc id"] is None else texts[r["doc id"]]
        want = None if text is None else own.encode_ordinary(text)
        assert r == Row(**{"doc id": r["doc id"], "n_tokens": len(want or ()), "ids": want, "bytes": None if text is None else bytearray(text.encode())})
    assert byte_bpe.encode(docs.limit(0), FILE, "doc id").count() == 0
    odd = spark.createDataFrame([(1, [0, 10**6], "kept")], "id long, `i``ds` array<int>, bytes string")
    assert byte_bpe.decode(odd, FILE, "i`ds").first() == Row(**{"id": 1, "i`ds": [0, 10**6], "bytes": bytearray(codec.ranks.bytes_of[0])})
