"""Token counts by trie-shared dynamic programming.

Each task inserts the distinct pre-tokens of its texts in a trie. A node holds the forward score of its prefix, the best
sum of unigram scores over all segmentations, and how many tokens that one has; both are computed once, when the node is
made, from the nodes above it. The count at a pre-token's last node is its count in every text, so a text's count is a
sum of look-ups. Texts stay where they are read: nothing is exchanged.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tonearm.llm.pieces import Vocabulary, vocabulary
from tonearm.llm.shared import bound_batches, column

#: About what a kept count takes beside its letters.
ENTRY = 150


class CountTrie:
    """Terminal counts of pre-tokens. A node is [children or None, forward score, tokens]. Beyond `most_nodes` nodes or
    about `most_bytes` of kept counts it starts anew, which costs time only. A pre-token of over `deepest` characters (text
    without spaces) shares no prefix with others in practice: it is scored in plain lists and not kept."""

    def __init__(self, vocab: Vocabulary, most_nodes: int = 300_000, most_bytes: int = 96 << 20, deepest: int = 500):
        self.vocab, self.most_nodes, self.most_bytes, self.deepest = vocab, most_nodes, most_bytes, deepest
        self.counts: dict[str, int] = {}
        self.held = 0
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = [None, 0.0, 0], 1

    def step(self, word: str, end: int, before: list) -> list:
        """A node for word[:end], from those of up to `longest` prefixes before it. Of equal scores the longer last piece wins."""
        below, at, score, tokens = self.vocab.endings[0], len(before), float("-inf"), 0
        while below and at:
            at -= 1
            found = below.get(word[end - len(before) + at])
            if found is None:
                break
            below, known = found
            if known is not None:
                s = before[at][1] + known[0]
                if s >= score:
                    score, tokens = s, before[at][2] + 1
        if word[end - 1] not in self.vocab.pieces:
            s = before[-1][1] + self.vocab.unknown
            if s > score:
                score, tokens = s, before[-1][2] + len(self.vocab.fallback(word[end - 1]))
        return [None, score, tokens]

    def insert(self, word: str) -> int:
        """The token count of a marked pre-token."""
        if len(word) > self.deepest:
            before = [self.root]
            for end in range(1, len(word) + 1):
                before = [*before[1 - self.vocab.longest :], self.step(word, end, before)]
            return before[-1][2]
        node, path = self.root, [self.root]
        endings, pieces = self.vocab.endings[0], self.vocab.pieces
        for end, char in enumerate(word):
            if node[0] is None:
                node[0] = {}
            made = node[0].get(char)
            if made is None:  # as in step, which costs a call more
                below, at, score, tokens = endings, end, float("-inf"), 0
                while at >= 0 and below:
                    found = below.get(word[at])
                    if found is None:
                        break
                    below, known = found
                    if known is not None:
                        _, s, n = path[at]
                        s += known[0]
                        if s >= score:
                            score, tokens = s, n + 1
                    at -= 1
                made = node[0][char] = [None, score, tokens] if char in pieces else self.step(word, end + 1, path)
                self.nodes += 1
            node = made
            path.append(node)
        return node[2]

    def count(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        units = self.vocab.units(text)
        missing = set(units).difference(self.counts)
        if missing:
            if self.held > self.most_bytes:
                self.counts, self.held, missing = {}, 0, set(units)
            for u in missing:
                if self.nodes > self.most_nodes:
                    self.clear()
                self.counts[u] = self.insert(self.vocab.marked(u))
            self.held += sum(ENTRY + len(u) for u in missing)
        return len(units), sum(map(self.counts.__getitem__, units))


@cache
def worker_trie(model: str) -> CountTrie:
    """The trie of this worker process; it lives as long as the worker."""
    return CountTrie(vocabulary(model))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_pretokens, n_tokens (long).

    Nulls: a null text, like an empty one, has none; ids pass as they are. Repeated rows are counted one by one. An
    empty table gives no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        trie = worker_trie(model)
        for b in batches:
            found = [trie.count(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_pretokens", "n_tokens"])

    source = docs.select(column(id_col), column(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, n_pretokens long, n_tokens long")
