"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a batch are sorted, which is the depth-first order of their trie: two neighbours share the
prefix that their tries' paths share. The walk keeps one forward score and one back pointer per depth; for each word
only the positions beyond the shared prefix are computed. Words already seen by the worker are looked up.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonearm.llm.pieces import Vocabulary, vocabulary
from tonearm.llm.shared import bound_batches, column

#: About what a kept word takes beside its letters and ids.
ENTRY = 150


def best_paths(words: list[str], vocab: Vocabulary) -> dict[str, bytes]:
    """Ids (little-endian unsigned 32-bit integers) of each word's best segmentation."""
    pieces, endings, unknown = vocab.pieces, vocab.endings[0], vocab.unknown
    score, back = [0.0], [(0, None)]
    out, before = {}, ""
    for word in sorted(words):
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, via, below, start = float("-inf"), None, endings, end
            while below and start:  # pieces that end here, the shortest first: of equal scores the longer one wins
                start -= 1
                found = below.get(word[start])
                if found is None:
                    break
                below, known = found
                if known is not None:
                    s = score[start] + known[0]
                    if s >= best:
                        best, via = s, (start, known[1])
            if via is None or (word[end - 1] not in pieces and score[end - 1] + unknown > best):
                best, via = score[end - 1] + unknown, (end - 1, None)
            score.append(best)
            back.append(via)
        ids, at = [], len(word)
        while at:
            start, piece = back[at]
            ids.append([piece] if piece is not None else vocab.fallback(word[start]))
            at = start
        out[word] = np.array([i for part in reversed(ids) for i in part], "<u4").tobytes()
        before = word
    return out


class Codec:
    """Encodes and decodes, and keeps the ids of words met before, up to about `most_bytes`."""

    def __init__(self, vocab: Vocabulary, most_bytes: int = 64 << 20):
        self.vocab, self.most_bytes, self.kept, self.held = vocab, most_bytes, {}, 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        units = [self.vocab.units(t) for t in texts]
        if self.held > self.most_bytes:
            self.kept, self.held = {}, 0
        missing = set().union(*units).difference(self.kept)
        if missing:
            full = {self.vocab.marked(u): u for u in missing}
            short = {}
            for u in missing:
                short.setdefault(self.vocab.marked(u), []).append(u)
            for word, ids in best_paths(list(full), self.vocab).items():
                for u in short[word]:
                    self.kept[u] = ids
                    self.held += ENTRY + len(u) + len(ids)
        get = self.kept.__getitem__
        return [b"".join(map(get, u)) for u in units]

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        get = self.vocab.bytes_of.get
        text = b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def codec(model: str) -> Codec:
    """The codec of this worker process; it lives as long as the worker."""
    return Codec(vocabulary(model))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_ids, ids (binary, little-endian unsigned 32-bit integers).

    Nulls: a null text has null ids and n_ids 0, an empty one has no ids; row ids pass as they are. Repeated rows are
    encoded one by one. An empty table gives no rows. Other columns are not read; nothing is exchanged.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [None if t is None else i for t, i in zip(texts, codec(model).encode(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i or b"") // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_ids", "ids"])

    source = docs.select(column(id_col), column(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, n_ids long, ids binary")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with a column of texts added (or replaced). The mark in front is dropped and other marks become spaces, so
    a text comes back as it was, but for U+2581 itself, which comes back as a space. Unknown ids stand for nothing, null
    ids give a null text."""
    bound_batches(encoded.sparkSession)
    names = [c for c in encoded.columns if c != text_col]
    kept = encoded.select(*map(column, names))
    at = names.index(ids_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + f", `{text_col}` string"

    def run(batches):
        for b in batches:
            texts = [codec(model).decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    return kept.mapInArrow(run, schema)
