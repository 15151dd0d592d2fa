"""Ids of a word-level BPE tokenizer file (lower case, white space dropped), by the tokenizers library.

White space always separates pre-tokens in such a file, and so does a letter from the punctuation after it, so a text's
ids are the ids of its chunks in order. Each worker encodes a chunk once and keeps it, up to a bound in bytes; chunks of plain
Latin letters go through the model in one call for a whole batch, all others through the full tokenizer.
"""

from __future__ import annotations

import re

import numpy as np

#: Lower-case letters of Latin-1: each is its own NFC form and its own lower case.
_LETTERS = "a-zß-öø-ÿ"
_plain = re.compile(f"[{_LETTERS}]+").fullmatch
_before_punctuation = re.compile(f"(?<=[{_LETTERS}])([!-/:-@\\[-`{{-~]+)(?=[ \\n]|$)")

_encoders: dict[tuple[str, int], WordEncoder] = {}
#: About what a kept chunk takes beside its letters and ids.
ENTRY = 150


class WordEncoder:
    """encode(texts) -> one bytes object per text: its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most_bytes: int = 64 << 20):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.most_bytes, self.kept, self.held = Tokenizer.from_file(path), most_bytes, {}, 0
        self.fast = Tokenizer(self.full.model)
        self.fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        suffix = self.full.model.end_of_word_suffix
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def chunks(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if not any(s in text for s in self.special):  # a special token is looked for before letters are lowered
            text = _before_punctuation.sub(r" \1", text.lower())
        return text.replace("\n", " ").split(" ")

    def learn(self, missing: list[str]) -> None:
        plain = [c for c in missing if _plain(c)]
        if plain:
            ids = np.array(self.fast.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                data, at = ids.tobytes(), 0
                for c, cut in zip(plain, (4 * cuts).tolist(), strict=True):
                    self.kept[c], at = data[at:cut], cut
            else:  # the file marks word ends in another way
                plain = []
        rest = list(set(missing).difference(plain))
        for c, e in zip(rest, self.full.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.kept[c] = np.array(e.ids, "<u4").tobytes()
        self.held += sum(ENTRY + len(c) + len(self.kept[c]) for c in missing)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.chunks(t) if t else [] for t in texts]
        if self.held > self.most_bytes:
            self.kept, self.held = {}, 0
        missing = set().union(*cut).difference(self.kept)
        if missing:
            self.learn(list(missing))
        get = self.kept.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def encoder(path: str, most_bytes: int = 64 << 20) -> WordEncoder:
    """The encoder of this worker process for a tokenizer file; it lives as long as the worker."""
    if (path, most_bytes) not in _encoders:
        _encoders[path, most_bytes] = WordEncoder(path, most_bytes)
    return _encoders[path, most_bytes]
