"""A SentencePiece vocabulary read as a unigram model, and the units that its texts fall into.

The score of a piece is the logarithm of a probability. A file of the unigram kind holds it (scores="file"). One of the
merge kind holds only ranks, whose sums would favour early merges whatever their number; there (scores="rank") the
probability follows the rank by Zipf's law, 1 / ((rank + 1) * H) with H the sum of 1 / (rank + 1) over all pieces.

A segmentation's score is the sum of its pieces' scores; the best one wins. Of equal scores, the one whose last piece is
longer wins, at every position. A character that is no piece itself costs the least score less UNKNOWN and stands for
its UTF-8 bytes. White space: a text is marked by U+2581 in front and in place of each space, as the vocabulary's own
files do (dummy prefix, no other normalisation).

No piece has a mark after another character, or a line feed, so a marked text falls apart into units (a run of marks
with what follows) whose segmentations do not depend on each other.
"""

from __future__ import annotations

import math
import re
from functools import cache

MARK, UNKNOWN = "▁", 10.0
_units = re.compile(f"{MARK}+[^{MARK}]*").findall


class Vocabulary:
    def __init__(self, path: str, scores: str = "rank"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: piece -> (score, id)
        self.pieces = {model.id_to_piece(i): (model.get_score(i), i) for i in plain}
        if scores == "rank":
            order = sorted(self.pieces, key=lambda p: -self.pieces[p][0])  # stable: of equal scores, the lower id first
            total = sum(1 / (rank + 1) for rank in range(len(order)))
            self.pieces = {p: (-math.log((rank + 1) * total), self.pieces[p][1]) for rank, p in enumerate(order)}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN
        self.longest = max(map(len, self.pieces))
        #: a trie of the pieces read backwards: [below by character or None, (score, id) or None]
        self.endings: list = [None, None]
        for piece, known in self.pieces.items():
            node = self.endings
            for char in reversed(piece):
                if node[0] is None:
                    node[0] = {}
                node = node[0].setdefault(char, [None, None])
            node[1] = known
        self.whole = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces)
        #: what each id stands for; ids that stand for nothing are absent
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, (_, i) in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}

    def fallback(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        found = [self.byte_ids.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown_id] if None in found else found

    def units(self, text: str | None) -> list[str]:
        """The units of a text in order, in short form: without their mark if they have just one, and from a line feed on
        a unit of its own. `marked` gives the full form."""
        if not text:
            return []
        if not self.whole:
            return [MARK + text.replace(" ", MARK)]
        if MARK not in text and text[0] != "\n":
            found = text.replace("\n", " \n").split(" ")
            if "" not in found:
                return found
        return _units(MARK + text.replace(" ", MARK))

    @staticmethod
    def marked(unit: str) -> str:
        return unit if unit[0] in (MARK, "\n") else MARK + unit


@cache
def vocabulary(path: str, scores: str = "rank") -> Vocabulary:
    """The vocabulary of this worker process; it lives as long as the worker."""
    return Vocabulary(path, scores)
