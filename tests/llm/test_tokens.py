import itertools
import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tonearm.llm import sentencepiece_codec as codec
from tonearm.llm import token_counts, token_files
from tonearm.llm.pieces import MARK, vocabulary
from tonearm.llm.queries import vocabulary_file
from tonearm.llm.shared import fresh_path
from tonearm.llm.wordbpe import WordEncoder

WORDS, PIECES = vocabulary_file("word_bpe_49k.json"), vocabulary_file("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello, World!", "a.b,c", "x\n\ny  z", "don't I'LL we've", "Ünïcödé Straße ÉCOLE", "İstanbul ΣΑΣ ς", "tab\there\x1cfs\x85nel\xa0nbsp", "<|endoftext|> A<|startoftext|>b", "e\u0301 cafe\u0301", "日本語 テスト", "12345 3.14", "***!!! --", "😀😀 ok", "K Å µ ß", "word." * 50, "A" * 5000, "end'", "it's.'s ?'s"]


def direct(text):
    return Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_word_encoder_equals_the_library():
    enc = WordEncoder(WORDS, most_bytes=2000)
    rng = random.Random(1)
    pieces = [*"aB éÉß.,!'s\n\t \u0301\xa0", "the ", "'ll", "<|endoftext|>", "ﬁ", "1", "Σ"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(400)]
    for at in range(0, len(texts), 7):
        for t, got in zip(texts[at : at + 7], enc.encode(texts[at : at + 7]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == direct(t), repr(t)
    assert enc.encode([None]) == [b""]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), max_size=70)), "<u4")
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert token_files.unpack(packed, width, len(ids)).tolist() == ids.tolist()


def test_widths():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("width", [7, 16])
def test_random_access(tmp_path, width):
    from pyarrow import fs

    rng = np.random.default_rng(0)
    local = fs.LocalFileSystem()
    writer = token_files.TokenFileWriter(local.open_output_stream(f"{tmp_path}/f"), width)
    parts = [rng.integers(0, 2**width, n).astype("<u4") for n in (0, 5, 9000, 1, 4096, 0, 12_345)]
    for i, p in enumerate(parts):
        writer.add(i or None, p)
    writer.close()
    every = np.concatenate(parts)
    f = token_files.TokenFile(local.open_input_file(f"{tmp_path}/f"))
    for a, b in ((0, 0), (0, 1), (4095, 4097), (8192, 8192), (17, 20_000), (0, len(every))):
        assert f.read(a, b).tolist() == every[a:b].tolist()
    for most in (1, 5000, 1 << 20):
        assert [(i, s, x.tolist()) for i, s, x in f.documents(most)] == [(i or None, int(sum(map(len, parts[:i]))), p.tolist()) for i, p in enumerate(parts)]


def test_files_round_trip_in_id_order(spark):
    rows = [(i * 7 % 23, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (100, None, "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = fresh_path(spark, "test-tokens")
    manifest = token_files.write_token_files(docs, folder, WORDS, end_id=2, files=3)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)]
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*direct(t or ""), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want and sum(r.n_tokens for r in manifest.collect()) == at


def test_token_files_of_an_empty_table(spark):
    folder = fresh_path(spark, "test-tokens")
    assert token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, WORDS, end_id=2).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0


# --- unigram pieces ---------------------------------------------------------------------------------------------------


def library():
    """The same pieces and scores as a unigram model of the SentencePiece library."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    known = vocabulary(PIECES).pieces
    for p in proto.pieces:
        if p.piece in known and p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = known[p.piece][0]
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def brute(word, vocab):
    """Best score over all segmentations of a short word."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, start = [], 0
        for k, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(word[start:k])
                start = k
        if all(x in vocab.pieces or len(x) == 1 for x in parts):
            score = sum(vocab.pieces[x][0] if x in vocab.pieces else vocab.unknown for x in parts)
            best = score if best is None else max(best, score)
    return best


def test_best_paths_score_as_brute_force():
    vocab = vocabulary(PIECES)
    rng = random.Random(3)
    words = sorted({MARK + "".join(rng.choices("theranéu\n☃", k=rng.randint(1, 9))) for _ in range(150)})
    score_of = {i: s for s, i in vocab.pieces.values()}
    for word, ids in codec.best_paths(words, vocab).items():
        total, left = 0.0, np.frombuffer(ids, "<u4").tolist()
        while left:
            if left[0] in score_of:
                total += score_of[left.pop(0)]
            else:
                n = next(k for k in range(1, 5) if bytes(vocab.bytes_of[i][0] for i in left[:k]).decode("utf-8", "ignore"))
                total, left = total + vocab.unknown, left[n:]
        assert math.isclose(total, brute(word, vocab)), word


def test_words_equal_the_library():
    lib, vocab = library(), vocabulary(PIECES)
    rng = random.Random(4)
    words = ["hello", "Überraschung", "anheitung", "entretionerly", "a", "the"] + ["".join(rng.choices("abcdehinorst", k=rng.randint(1, 14))) for _ in range(300)]
    found = codec.best_paths([MARK + w for w in words], vocab)
    for w in words:
        assert np.frombuffer(found[MARK + w], "<u4").tolist() == lib.encode(w), w


SHAPES = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\na", "a \nb", "a\n b", "x\ty", "😀 ☃", "▁", "a▁b", "word " * 3000, "w" * 3000, "Ünï cödé"]


def test_file_scores_are_taken_as_they_are():
    vocab = vocabulary(PIECES, "file")
    raw = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(raw.get_score(i) == s for s, i in vocab.pieces.values())


def test_common_words_are_whole_pieces_as_in_the_library_itself():
    raw, vocab = sentencepiece.SentencePieceProcessor(model_file=PIECES), vocabulary(PIECES)
    words = "the quick brown fox over lazy dog international government understanding because between".split()
    found = codec.best_paths([MARK + w for w in words], vocab)
    assert [np.frombuffer(found[MARK + w], "<u4").tolist() for w in words] == [raw.encode(w) for w in words]


def test_units_make_up_the_text():
    vocab = vocabulary(PIECES)
    for t in SHAPES:
        whole = codec.best_paths([MARK + t.replace(" ", MARK)], vocab).popitem()[1] if t else b""
        assert codec.Codec(vocab).encode([t]) == [whole], repr(t)


def test_codec_round_trip_and_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate([*SHAPES, *TEXTS, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = codec.decode(codec.encode(docs, PIECES), PIECES).collect()
    back = {r.doc_id: r for r in found}
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, PIECES).collect()}
    for i, t, _ in rows:
        assert back[i].text == (t.replace("▁", " ") if t is not None else None), repr(t)
        assert back[i].n_ids == counts[i].n_tokens, repr(t)
        assert counts[i].n_pretokens == len(vocabulary(PIECES).units(t))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(empty, PIECES).count() == 0 and codec.decode(codec.encode(empty, PIECES), PIECES).count() == 0


def test_trie_counts_survive_its_bounds():
    vocab = vocabulary(PIECES)
    small, large = token_counts.CountTrie(vocab, most_nodes=20, most_bytes=1000), token_counts.CountTrie(vocab)
    rng = random.Random(5)
    for _ in range(50):
        t = " ".join("".join(rng.choices("abéz", k=rng.randint(1, 6))) for _ in range(9))
        assert small.count(t) == large.count(t)
