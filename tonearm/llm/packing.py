"""Best-fit packing with swap-based local search.

Texts are encoded where they are read; only small rows (piece, length) go on. Each task packs its own pieces in windows
of bounded size: best fit on falling lengths, then local search over the underfull bins: a document moves to a fuller
bin, or changes places one for one or two for one with a shorter one there, whenever that raises the sum of squared
fills, until bins run empty. The search ends when no step is left, or when no fewer bins could hold the tokens. What stays
in underfull bins is dealt out once more in bounded groups and packed again, so that the tails of all tasks meet. No text,
and no whole set of lengths, goes to one task or to the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.shared import bound_batches, column, stored
from tonearm.llm.wordbpe import encoder

#: Columns of a packed piece behind its document's id.
PIECES = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "fill": pa.int64()}


class Bins:
    """Bins of one capacity over items with lengths; underfull bins are found by gap through a bit mask of gaps."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.by_gap: dict[int, set[int]] = defaultdict(set)
        self.mask = 0

    def _list(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if gap and self.items[b]:
            self.by_gap[gap].add(b)
            self.mask |= 1 << gap

    def _unlist(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if gap and b in self.by_gap[gap]:
            self.by_gap[gap].discard(b)
            if not self.by_gap[gap]:
                self.mask &= ~(1 << gap)

    def best(self, length: int) -> int | None:
        """The fullest bin that has room for `length`."""
        m = self.mask >> length
        return min(self.by_gap[length + (m & -m).bit_length() - 1]) if m else None

    def change(self, b: int, out: list[int], into: list[int]) -> None:
        self._unlist(b)
        self.items[b] = [i for i in self.items[b] if i not in out] + into
        self.fill[b] = sum(self.lengths[i] for i in self.items[b])
        self._list(b)

    def best_fit(self) -> None:
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            b = self.best(self.lengths[i])
            if b is None:
                b = len(self.items)
                self.items.append([])
                self.fill.append(0)
            self._unlist(b)
            self.items[b].append(i)
            self.fill[b] += self.lengths[i]
            self._list(b)

    def local_search(self) -> None:
        """Passes over the underfull bins, emptiest first, until none changes anything (each step raises the sum of squared
        fills, so they end) or as few bins are left as the items' lengths need."""
        least = -(-sum(self.lengths) // self.capacity)
        left = sum(map(bool, self.items))
        changed = True
        while changed and left > least:
            underfull = sorted((b for at in self.by_gap.values() for b in at), key=lambda b: (self.fill[b], b))
            # takes[v]: by length, (bin, item) such that the bin holds at most v more if the item leaves; offered: the v there are
            self.takes: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
            self.offered = 0
            for b in underfull:
                self._offer(b)
            changed = False
            for b in underfull:
                changed |= self._empty(b)
                left -= not self.items[b]
                if left <= least:
                    break

    def _distinct(self, b: int) -> list[int]:
        """An item of each length in the bin, longest first."""
        return sorted({self.lengths[i]: i for i in self.items[b]}.values(), key=lambda i: -self.lengths[i])

    def _offer(self, b: int) -> None:
        for i in self._distinct(b):
            v = self.capacity - self.fill[b] + self.lengths[i]
            self.takes[v][self.lengths[i]].append((b, i))
            self.offered |= 1 << v

    def _empty(self, b: int) -> bool:
        changed = False
        for i in sorted(self.items[b], key=lambda i: -self.lengths[i]):  # moves
            self._unlist(b)
            to = self.best(self.lengths[i])
            self._list(b)
            if to is not None and self.fill[to] + self.lengths[i] > self.fill[b]:
                self.change(b, [i], [])
                self.change(to, [], [i])
                self._offer(to)
                changed = True
        swapped = True
        while self.items[b] and swapped:  # one for one, two for one
            own = self._distinct(b)
            more = {self.lengths[i]: i for i in self.items[b] if i not in own}  # a second item of a length
            pairs = [(i, j) for n, i in enumerate(own) for j in own[n + 1 :]] + [(i, more[self.lengths[i]]) for i in own if self.lengths[i] in more]
            swapped = any(self._swap(b, give) for give in [(i,) for i in own] + pairs)
            changed |= swapped
        return changed

    def _swap(self, b: int, give: tuple[int, ...]) -> bool:
        """Exchange `give` for one shorter item of a bin that is fuller afterwards than this one is now; the tightest fit."""
        size = sum(self.lengths[i] for i in give)
        end = self.capacity + size - self.fill[b]  # a bin that takes more than this stays emptier
        m = self.offered >> size
        while m:
            v = size + (m & -m).bit_length() - 1
            if v >= end:
                return False
            m &= m - 1
            at = self.takes[v]
            for length in [x for x in sorted(at) if x < size]:
                offers, passed = at[length], []
                while offers:
                    to, x = offers.pop()
                    if x not in self.items[to] or self.capacity - self.fill[to] + length != v:
                        continue  # out of date
                    if to == b:
                        passed.append((to, x))
                        continue
                    offers.extend(passed)
                    self.change(b, list(give), [x])
                    self.change(to, [x], list(give))
                    self._offer(to)
                    self._offer(b)
                    return True
                offers.extend(passed)
                if not offers:
                    del at[length]
            if not at:
                self.offered &= ~(1 << v)
        return False


def pack(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset in it, fill of it) of each item; lengths lie between 0 and capacity. Bins are numbered without gaps."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.local_search()
    where, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    n = 0
    for b, items in enumerate(bins.items):
        at = 0
        for i in items:
            where[i], offset[i], fill[i] = n, at, bins.fill[b]
            at += lengths[i]
        n += bool(items)
    return where, offset, fill


def _placed(rows: dict[str, list], kind: pa.DataType, capacity: int, first: int) -> pa.RecordBatch:
    where, offset, fill = pack(rows["length"], capacity)
    placed = rows | {"sequence_id": [first + w for w in where], "offset": offset, "fill": fill}
    return pa.RecordBatch.from_arrays([pa.array(placed["doc_id"], kind), *[pa.array(placed[c], t) for c, t in PIECES.items()]], names=["doc_id", *PIECES])


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", window: int = 50_000, rounds: tuple[float, ...] = (0.97, 1.0)) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its text's ids and
    end_id; longer ones are cut every `capacity` tokens, the others stay whole.

    `rounds`: after the first round in each task, sequences that are filled less than this share are packed anew together,
    and then those that are not quite full; rounds end early when the number of sequences is the least there can be.

    Nulls: a null text is a document of end_id alone; a null id is packed like any other; ids are of any type. Repeated rows
    are packed one by one. An empty table gives no rows. Other columns are not read. A text of any length is cut as it comes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    source = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, " + ", ".join(f"{c} long" for c in list(PIECES)[1:])

    def first_round(batches):
        enc, end, rows, n, kind = encoder(tokenizer), end_id.to_bytes(4, "little"), {k: [] for k in keys}, 0, pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in zip(keys, (i, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        rows[k].append(v)
            if len(rows["piece"]) >= window:
                yield _placed(rows, kind, capacity, (TaskContext.get().partitionId() << 36) + n)
                n, rows = n + len(rows["piece"]), {k: [] for k in keys}
        if rows["piece"]:
            yield _placed(rows, kind, capacity, (TaskContext.get().partitionId() << 36) + n)

    def again(number):
        def run(batches):
            """Pack anew what a task got, in windows; a window that needs no fewer sequences so stays as it was."""
            held, size, n = [], 0, 0

            def out():
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                rows = {c: t.column(c).to_pylist() for c in t.schema.names}
                new = _placed({k: rows[k] for k in keys}, t.schema.field(0).type, capacity, (number << 58) + (TaskContext.get().partitionId() << 36) + n)
                return new if len(set(new.column("sequence_id").to_pylist())) < len(set(rows["sequence_id"])) else t

            for b in batches:
                if not b.num_rows:
                    continue
                if size >= window:
                    at = b.column("sequence_id").to_pylist()
                    last = held[-1].column("sequence_id")[-1].as_py()
                    cut = next((k for k, x in enumerate(at) if x != last), len(at))  # sequences are not cut
                    if cut < len(at):
                        held.append(b.slice(0, cut))
                        yield out()
                        n, held, size, b = n + size + cut, [], 0, b.slice(cut)
                held.append(b)
                size += b.num_rows
            if held:
                yield out()

        return run

    now = stored(source.mapInArrow(first_round, schema), "packed")
    for number, share in enumerate(rounds, 1):
        tokens, sequences, loose = now.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("n")).agg(
            F.coalesce(F.sum("t"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("t") < share * capacity, F.col("n"))), F.lit(0))
        ).first()
        if sequences <= -(-tokens // capacity):
            break
        rest = F.col("fill") < share * capacity
        parts = max(1, -(-loose // (2 * window)))
        # all pieces of a sequence go to one task, which mixes the sequences of many
        mixed = now.where(rest).repartition(parts, F.xxhash64("sequence_id")).sortWithinPartitions(F.xxhash64("sequence_id"), "sequence_id", "offset").mapInArrow(again(number), schema)
        now = stored(now.where(~rest).unionByName(mixed), "packed")
    return now.drop("fill")
