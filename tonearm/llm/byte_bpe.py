"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task gathers the distinct pre-tokens of a block of texts (a slice of the corpus of `block` bytes) that it has not met
before, lays their bytes out in one array, and keeps an inverted index from each token pair, by its rank, to the positions
where it stands. Merges are applied in rank order, each to all its positions in all pre-tokens at once; only the pairs on
both sides of a merge are looked up anew and enter the index. Texts stay where they are read: nothing is exchanged.

Merging everywhere at once gives what merging the leftmost pair of the lowest rank gives, one at a time, since pre-tokens do
not touch and equal pairs that overlap are taken from the left. The one exception is a merge whose result forms a pair of a
lower rank, which then goes before the other positions: a pre-token where that happens goes on alone, position by position,
with an index of its own. A pre-token that is itself in the file is its own token, without merges, as in the tiktoken library.
"""

from __future__ import annotations

import base64
from functools import cache, cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tonearm.llm.shared import bound_batches, column
from tonearm.llm.units import full, units

#: The pattern that cuts a text into pre-tokens (fixed; public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: About what a kept unit takes beside its letters and ids; no pair.
ENTRY, NONE = 150, np.iinfo(np.int32).max


class Ranks:
    """A rank file: its tokens, and the rank of every pair of tokens that makes a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {rank: token for token, rank in self.tokens.items()}
        self.size = size = max(self.bytes_of) + 1
        pairs = [(left, right, rank) for token, rank in self.tokens.items() for at in range(1, len(token)) if (left := self.tokens.get(token[:at])) is not None and (right := self.tokens.get(token[at:])) is not None]
        left, right, rank = np.array(pairs or np.empty((0, 3)), np.int64).reshape(-1, 3).T
        order = np.argsort(left * size + right)
        self.keys, self.made = np.r_[(left * size + right)[order], np.iinfo(np.int64).max], np.r_[rank[order], NONE].astype(np.int32)
        self.of_byte = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)
        #: ranks whose token forms a pair of a lower rank with some token
        lower = np.zeros(size, bool)
        lower[left[rank < left]] = True
        lower[right[rank < right]] = True
        self.early = lower

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    @cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))

    def alone(self, tokens: np.ndarray) -> np.ndarray:
        """One word's tokens (-1 where there is none) after all merges, the leftmost of the lowest rank first."""
        token, made, size = tokens.tolist(), self.table, self.size
        at = [k for k, t in enumerate(token) if t >= 0]
        after, before = dict(zip(at, [*at[1:], -1], strict=True)), dict(zip(at, [-1, *at[:-1]], strict=True))
        rank = {k: made.get(token[k] * size + token[n], NONE) for k, n in after.items() if n >= 0}
        todo = [(r, k) for k, r in rank.items() if r < NONE]
        heapify(todo)
        while todo:
            r, k = heappop(todo)
            if rank.get(k) != r:
                continue
            gone = after[k]
            token[k], token[gone] = r, -1
            rank.pop(gone, None)
            far = after[k] = after[gone]
            if far >= 0:
                before[far] = k
            else:
                del rank[k]
            for p in (before[k], k):
                if p >= 0 and after[p] >= 0:
                    rank[p] = made.get(token[p] * size + token[after[p]], NONE)
                    if rank[p] < NONE:
                        heappush(todo, (rank[p], p))
        return np.array(token, tokens.dtype)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit integers) of each word; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = -1, -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair(token[inner], token[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        todo: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put positions under the rank of the pair that stands there."""
            own = rank[at]
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, first, end in zip(own[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
                if r in index:
                    index[r].append(at[first:end])
                else:
                    index[r] = [at[first:end]]
                    heappush(todo, r)

        def early(at: np.ndarray, r: int) -> list[int]:
            """The words where a merge at one of these positions, but not the last, forms a pair of a lower rank than r."""
            left, right = before[at], after[after[at]]
            merged = np.r_[False, (word[at[1:]] == word[at[:-1]]) & (after[at[:-1]] == left[1:])]
            lower = (left >= 0) & (self.pair(np.where(merged, r, token[left]), np.full(len(at), r)) < r)
            lower |= (right >= 0) & (self.pair(np.full(len(at), r), token[right]) < r)
            return np.unique(word[at[:-1][lower[:-1] & (word[at[1:]] == word[at[:-1]])]]).tolist()

        inner = inner[rank[inner] < NONE]
        if len(inner):
            enter(inner)
            heapify(todo)
        while todo:
            r = heappop(todo)
            at = np.concatenate(index.pop(r))
            at = at[rank[at] == r]  # others have changed since
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.r_[True, at[1:] != at[:-1]]]
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                if chained.any():  # of a chain of overlapping pairs every second one is taken
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
                if self.early[r] and (odd := early(at, r)):
                    for w in odd:
                        first, end = ends[w] - sizes[w], ends[w]
                        token[first:end] = self.alone(token[first:end])
                        rank[first:end] = NONE
                    at = at[~np.isin(word[at], odd)]
                    if not len(at):
                        continue
            gone = after[at]
            token[at], token[gone], rank[gone] = r, -1, NONE
            far = after[gone]
            after[at] = far
            before[far[far >= 0]] = at[far >= 0]
            near = before[at]
            touched = np.concatenate((at, near[near >= 0]))
            beyond = after[touched]
            open_ = beyond >= 0
            rank[touched[~open_]] = NONE
            touched, beyond = touched[open_], beyond[open_]
            rank[touched] = self.pair(token[touched], token[beyond])
            touched = touched[rank[touched] < NONE]
            if len(touched):
                enter(touched)
        left = token >= 0
        ids, cuts = token[left].astype("<u4").tobytes(), (4 * np.cumsum(np.add.reduceat(left, ends - sizes)) if len(words) else ends).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class ByteCodec:
    """Encodes; keeps the ids of the units met before, up to about `most_bytes`."""

    def __init__(self, path: str, most_bytes: int = 24 << 20):
        import regex

        self.ranks, self.most_bytes = Ranks(path), most_bytes
        self.cut = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.kept, self.opening, self.held = {}, {}, 0

    def pretokens(self, unit: str) -> list[str]:
        """The pre-tokens of a unit; plain words, with a sign at their end or without, need no pattern."""
        if unit.isascii():
            if unit.isalpha():
                return [" " + unit]
            if unit[-1] in ".,;:!?" and unit[:-1].isalpha():
                return [" " + unit[:-1], unit[-1]]
        return self.cut(full(unit))

    def learn(self, rest: set[str], first: set[str]) -> None:
        """Encode units by one replay of all their distinct pre-tokens."""
        flat, sizes = [], []
        for u in rest:
            found = self.pretokens(u)
            flat += found
            sizes.append(len(found))
        for u in first:
            found = self.cut(full(u)[1:])
            flat += found
            sizes.append(len(found))
        known, new = {}, []
        for w in set(flat):
            word = w.encode()
            rank = self.ranks.tokens.get(word)
            if rank is None:
                new.append(word)
            else:
                known[w] = rank.to_bytes(4, "little")
        replayed = dict(zip(new, self.ranks.replay(new), strict=True))
        ids, at = [known.get(w) or replayed[w.encode()] for w in flat], 0
        for u, n, kept in zip((*rest, *first), sizes, (self.kept,) * len(rest) + (self.opening,) * len(first), strict=True):
            kept[u] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            self.held += ENTRY + len(u) + 4 * n
            at += n

    def encode(self, texts) -> list[bytes | None]:
        """The ids of each text as little-endian unsigned 32-bit integers; those of null are null. texts: any iterable; of a
        text only the numbers of its units are held until all units are known."""
        place, cut = Numbered(), []
        for t in texts:
            if t:
                first, *rest = units(t)
                cut.append((first, np.fromiter(map(place.__getitem__, rest), np.int32, len(rest))))
            else:
                cut.append(t)
        if self.held > self.most_bytes:
            self.clear()
        rest, first = {u for u in place if u not in self.kept}, {c[0] for c in cut if c and c[0] not in self.opening}
        if rest or first:
            self.learn(rest, first)
        ids = [self.kept[u] for u in place]
        return [self.opening[c[0]] + b"".join([ids[k] for k in c[1].tolist()]) if c else None if c is None else b"" for c in cut]


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; the last entry, of no bytes, is for ids without a token."""
    with open(path, "rb") as f:
        known = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [known.get(i, b"") for i in range(max(known) + 2)]


@cache
def codec(path: str) -> ByteCodec:
    """The codec of this worker process; it lives as long as the worker."""
    return ByteCodec(path)


class Numbered(dict):
    """Keys numbered in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def blocks(batches, of: int, size: int):
    """Lists of batches of about `size` bytes in column `of`, so that what a block's texts share is done once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(of).nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = 6 << 20) -> DataFrame:
    """One row per row of docs: id, n_tokens (long), ids (array of int).

    Nulls: a null text has null ids and no tokens, an empty one has no ids; row ids pass as they are. Long texts are encoded
    whole. Repeated rows are encoded one by one. An empty table gives no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for held in blocks(batches, 1, block):
            ids = codec(path).encode(t.as_py() for b in held for t in b.column(1))
            at = 0
            for b in held:
                own, at = ids[at : at + b.num_rows], at + b.num_rows
                sizes = [len(i or b"") // 4 for i in own]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.frombuffer(b"".join(i or b"" for i in own), np.int32)), mask=pa.array([i is None for i in own]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), lists], names=[id_col, "n_tokens", "ids"])

    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return source.mapInArrow(run, StructType([StructField(id_col, source.schema[0].dataType), StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """encoded with a column of bytes added (or replaced): those of the tokens of ids_col, joined. They are the text's UTF-8, whole.
    Null ids give null, no ids give no bytes, an id without a token stands for nothing."""
    bound_batches(encoded.sparkSession)
    names = [c for c in encoded.columns if c != bytes_col]
    kept = encoded.select(*map(column, names))
    at = names.index(ids_col)

    def run(batches):
        for b in batches:
            table, ids = token_bytes(path), b.column(at)
            flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = np.where((flat >= 0) & (flat < len(table)), flat, len(table) - 1).tolist()
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
            texts = [b"".join([table[i] for i in flat[x:y]]) if there else None for x, y, there in zip([0, *ends], ends, ids.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*names, bytes_col])

    numbered = kept.toDF(*[f"c{k}" for k in range(len(names))])  # mapInArrow takes no name with a backtick
    return numbered.mapInArrow(run, StructType([*kept.schema.fields, StructField(bytes_col, BinaryType())]))
