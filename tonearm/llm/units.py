"""Units: pieces of a text that byte-level BPE files encode apart from each other, so that each is encoded once.

The pattern that cuts a text before the merges (public_tokenizers.PATTERN) never joins what stands before a single space
between two other characters to what follows, nor what stands before a run of white space that begins with a line feed.
A text is cut there. White space is taken in the widest sense (str.isspace), so that no engine's idea of it matters.

A unit is told in short form: `word` stands for ` word`; one that begins with a space or a line feed stands for itself.
"""

from __future__ import annotations

import re

_other_space = re.compile(r"[^\S \n]").search
_cut = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n))").split


def units(text: str) -> list[str]:
    """The units of a space and the text, in order; the first one has that space."""
    if text and text[0] not in " \n" and "\n\n" not in text and not _other_space(text):
        found = text.replace("\n", " \n").split(" ")
        if "" not in found:
            return found
    first, *rest = _cut(" " + text)
    return [short(first), *[u if u[:1] == "\n" else short(" " + u) for u in rest]]


def short(unit: str) -> str:
    return unit[1:] if unit[1:2] not in ("", " ", "\n") else unit


def full(unit: str) -> str:
    return unit if unit[0] in " \n" else " " + unit
