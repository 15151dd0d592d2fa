"""Alignment of two tokenizers by the hash-set intersection of their cumulative ends.

1. Each task takes blocks of texts, cuts them into units that both tokenizers encode apart from each other (a unit ends where a
   token of either ends) and aligns each distinct unit of a block once, many in one run: a dictionary leads from each
   cumulative end to the token's index, for either tokenizer; the sorted common keys of the two slice both id lists into
   groups; the slices are expanded into links, the pairs of tokens whose byte ranges overlap.
2. A block tells each pair of ids once, with the number of its links there. Sums over all blocks give the corpus-wide
   counts, and the largest of each second id. The counts go back to the blocks that hold the pair.
3. Block by block, units get the sums of their links and texts those of their units.

What is exchanged: a block's texts as numbers of its units, its units once, its distinct pairs once. A pair that stands
everywhere is one row a block, so no key gathers more rows than there are blocks. A task holds one block at a time.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tonearm.llm.byte_bpe import Numbered, blocks
from tonearm.llm.shared import bound_batches, column, stored
from tonearm.llm.units import full, units

PAIRS, UNITS, TEXT = 0, 1, 2
#: Units told in one row.
CHUNK = 5000


@cache
def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(plain)))}


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters, b, vocab = byte_letters(), self.b, self.a.get_vocab(with_added_tokens=True)
        if not letters.keys() <= vocab.keys():
            raise ValueError(f"{path_a} is not of the byte-level kind")
        bytes_a = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.characters = None if sum(map(b.is_byte, range(len(pieces)))) == 256 else {p for p in pieces if len(p) == 1}

    def cut(self, text: str | None) -> list[str] | None:
        """The units of a text; None if it is empty or its pieces do not give back its bytes."""
        if not text or "▁" in text or self.b.normalize(text) != "▁" + text.replace(" ", "▁"):
            return None
        if self.characters is not None and not {"▁", *text} <= self.characters | {" "}:
            return None
        return units(text) if self.apart else [text if text[0] not in " \n" else " " + text]

    def runs(self, own: list[str], most: int):
        """own in order, cut into lists that can be encoded in one run each: of about `most` characters, or one odd unit alone."""
        run, size = [], 0
        for u in own:
            odd = u[-1].isspace() or (u[0].isspace() and u[0] != "\n")
            if run and (odd or size > most):
                yield run
                run, size = [], 0
            if odd:
                yield [u]
            else:
                run.append(u)
                size += len(u)
        if run:
            yield run

    def aligned(self, own: list[str], most: int = 50_000):
        """(groups of each unit, pairs of ids of all links, for each unit its links, tokens of either, and groups)."""
        told, pairs, numbers = [], [], []
        for run in self.runs(own, most):
            whole = [full(u) for u in run]
            text, begins = "".join(whole), whole[0][0] == " "
            a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
            b = self.b.encode(text[1:]) if begins else self.b.encode(text)[1:]
            own_a, own_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            if not b"".join(own_a) == b"".join(own_b) == text.encode():
                raise ValueError(f"tokens are not the bytes of {text[:200]!r}")
            ends_a, ends_b = np.cumsum(list(map(len, own_a))), np.cumsum(list(map(len, own_b)))
            index_a, index_b = {e: k for k, e in enumerate(ends_a.tolist(), 1)}, {e: k for k, e in enumerate(ends_b.tolist(), 1)}
            common = sorted(index_a.keys() & index_b.keys())
            to_a, to_b = list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))
            name_a, name_b = list(map(str, a)), list(map(str, b))
            groups = [f"{name_a[i]}|{name_b[j]}" if x - i == 1 == y - j else f"{','.join(name_a[i:x])}|{','.join(name_b[j:y])}" for i, x, j, y in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
            every = np.union1d(ends_a, ends_b)  # the tokens that hold what ends here overlap in it, so that each end is a link
            pairs.append(np.array(a, np.int64)[np.searchsorted(ends_a, every)] << 32 | np.array(b, np.int64)[np.searchsorted(ends_b, every)])
            ends = np.cumsum([len(u.encode()) for u in whole])
            four = np.column_stack([np.searchsorted(x, ends, "right") for x in (every, ends_a, ends_b, common)])
            numbers.append(np.diff(four, axis=0, prepend=np.zeros((1, 4), np.int64)))
            cuts = four[:, 3].tolist()
            told += [";".join(groups[x:y]) for x, y in zip([0, *cuts], cuts, strict=False)]
        return told, np.concatenate(pairs or [np.empty(0, np.int64)]), np.concatenate(numbers or [np.empty((0, 4), np.int64)])


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker process; it lives as long as the worker."""
    return Aligner(path_a, path_b)


def lists(sizes, values) -> pa.ListArray:
    """A list array; a size of None is a null list."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([s or 0 for s in sizes])].astype(np.int32)), pa.array(values), mask=pa.array([s is None for s in sizes], pa.bool_()))


def in_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, block: int) -> DataFrame:
    """The rows of all blocks. PAIRS: pairs, n, numbered from `at`; UNITS: groups, numbers (three a unit: links, tokens of a,
    groups), links (numbers of pairs); TEXT: id, units as two planes of bytes, the low 16 bits and the rest."""
    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = StructType([StructField("block", LongType()), StructField("kind", IntegerType()), StructField("at", IntegerType()), StructField("id", source.schema[0].dataType), StructField("low", BinaryType()), StructField("high", BinaryType()), StructField("pairs", ArrayType(LongType())), StructField("n", ArrayType(LongType())), StructField("numbers", ArrayType(IntegerType())), StructField("links", ArrayType(IntegerType())), StructField("groups", StringType())])

    def run(batches):
        number, own = TaskContext.get().partitionId() << 32, aligner(path_a, path_b)
        types = {"block": pa.int64(), "kind": pa.int32(), "at": pa.int32(), "id": None, "low": pa.binary(), "high": pa.binary(), "pairs": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "numbers": pa.list_(pa.int32()), "links": pa.list_(pa.int32()), "groups": pa.string()}

        def told(kind, at, **given):
            given |= {"block": pa.array(np.full(len(at), number)), "kind": pa.array(np.full(len(at), kind, np.int32)), "at": pa.array(at, pa.int32())}
            return pa.RecordBatch.from_arrays([given[f] if f in given else pa.nulls(len(at), types[f]) for f in types], names=list(types))

        for held in blocks(batches, 1, block):
            types["id"], place = held[0].column(0).type, Numbered()
            texts = [None if (u := own.cut(t.as_py())) is None else np.fromiter(map(place.__getitem__, u), np.int32, len(u)) for b in held for t in b.column(1)]
            held = [b.column(0) for b in held]
            uses = np.bincount(np.concatenate([np.empty(0, np.int32), *[x for x in texts if x is not None]]), minlength=len(place))
            order = np.argsort(-uses, kind="stable")  # frequent ones get small numbers
            renumbered = np.empty_like(order)
            renumbered[order] = np.arange(len(order))
            names = list(place)
            groups, pairs, numbers = own.aligned([names[k] for k in order])
            del place, names
            pairs, links = np.unique(pairs, return_inverse=True)
            counts = np.bincount(links, np.repeat(uses[order], numbers[:, 0]), len(pairs)).astype(np.int64)
            for at in range(0, len(pairs), CHUNK):
                part = pairs[at : at + CHUNK]
                yield told(PAIRS, [at], pairs=lists([len(part)], part), n=lists([len(part)], counts[at : at + CHUNK]))
            ends = np.r_[0, np.cumsum(numbers[:, 0])]
            for at in range(0, len(groups), CHUNK):
                part = numbers[at : at + CHUNK]
                flat = links[ends[at] : ends[at + len(part)]].astype(np.int32)
                yield told(UNITS, [at], groups=pa.array(["\n".join(groups[at : at + CHUNK])]), numbers=lists([3 * len(part)], part[:, [0, 1, 3]].astype(np.int32).ravel()), links=lists([len(flat)], flat))
            at = 0
            for ids in held:
                part = [None if x is None else renumbered[x].astype("<u4") for x in texts[at : at + len(ids)]]
                yield told(TEXT, np.arange(at, at + len(ids)), id=ids, low=pa.array([None if x is None else x.astype("<u2").tobytes() for x in part], pa.binary()), high=pa.array([None if x is None else (x >> 16).astype("<u2").tobytes() for x in part], pa.binary()))
                at += len(ids)
            number += 1

    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best) of the whole corpus; best: no pair with the same second id has more."""
    told = rows.where(F.col("kind") == PAIRS).select(F.inline(F.arrays_zip("pairs", "n")))
    totals = stored(told.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = totals.groupBy(second.alias("second")).agg(F.max("count").alias("most"))
    return totals.join(most.select(F.expr("second ^ 0L").alias("second"), "most"), second == F.col("second")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = 12 << 20) -> DataFrame:
    """One row per row of docs: id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair no other pair with the same b
    outnumbers), count_sum (corpus-wide counts of all links), groups (`a1,a2|b1;a3|b2,b3`, ids in order).

    a is a byte-level tokenizers file, which encodes a space and the text; b is a sentencepiece model, which adds the space.
    Special tokens in a text are plain text. Nulls: a text that is null or empty, or whose bytes one of the two does not give
    back (U+2581 in it), has zeros and empty groups; row ids pass as they are. Repeated rows are aligned one by one and counted
    one by one. Long texts are whole: a block is at least one text. An empty table gives no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = stored(in_blocks(docs, path_a, path_b, id_col, text_col, block), "aligned", "zstd")
    asked = rows.where(F.col("kind") == PAIRS).select("block", "at", F.posexplode("pairs").alias("k", "pair")).select("block", (F.col("at") + F.col("k")).alias("at"), "pair")
    counted = asked.join(pair_counts(rows).select(F.expr("pair ^ 0L").alias("pair"), "count", "best"), "pair").select("block", F.lit(PAIRS).alias("kind"), "at", "count", "best")
    both = rows.where(F.col("kind") != PAIRS).drop("pairs", "n").unionByName(counted, allowMissingColumns=True)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches):
        block, counts, units, sums, groups = None, [], [], None, []
        for whole in batches:
            if not whole.num_rows:
                continue
            column_of = dict(zip(whole.schema.names, whole.columns, strict=True))
            key = column_of["block"].to_numpy() * 4 + column_of["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                own, number, kind = {n: c.slice(first, end - first) for n, c in column_of.items()}, int(key[first]) >> 2, int(key[first]) & 3
                if number != block:
                    block, counts, units, sums, groups = number, [], [], None, []
                if kind == PAIRS:
                    counts.append((own["count"].to_numpy(), own["best"].to_numpy(zero_copy_only=False)))
                elif kind == UNITS:
                    if isinstance(counts, list):  # all pairs are there, in the order of their numbers
                        counts = np.column_stack([np.concatenate(x).astype(np.int64) for x in zip(*counts, strict=True)])
                    links, three = own["links"].flatten().to_numpy(), own["numbers"].flatten().to_numpy().reshape(-1, 3).astype(np.int64)
                    total = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(counts[links], axis=0)])
                    to = np.cumsum(three[:, 0])
                    sum_, best = (total[to] - total[to - three[:, 0]]).T
                    n_links, n_a, n_groups = three.T
                    units.append(np.column_stack([n_a, n_links + n_groups - n_a, n_groups, n_links, best, sum_]))
                    groups += [g for text in own["groups"].to_pylist() for g in text.split("\n")]
                else:
                    if sums is None:
                        sums, units = np.concatenate([np.zeros((0, 6), np.int64), *units]), []
                    low, high = ([x or b"" for x in own[c].to_pylist()] for c in ("low", "high"))
                    flat = np.frombuffer(b"".join(low), "<u2").astype(np.int64) | np.frombuffer(b"".join(high), "<u2").astype(np.int64) << 16
                    ends = np.r_[0, np.cumsum([len(x) // 2 for x in low])]
                    total = np.vstack([np.zeros((1, 6), np.int64), np.cumsum(sums[flat], axis=0)])
                    out = total[ends[1:]] - total[ends[:-1]]
                    for at in range(0, len(out), 100):  # groups take more room than texts
                        part = out[at : at + 100]
                        joined = [";".join([groups[k] for k in flat[x:y].tolist()]) for x, y in zip(ends[at:], ends[at + 1 : at + 101], strict=False)]
                        yield pa.RecordBatch.from_arrays([own["id"].slice(at, len(part)), *map(pa.array, part.T), pa.array(joined, pa.string())], names=[id_col, *names, "groups"])

    schema = StructType([StructField(id_col, rows.schema["id"].dataType), *[StructField(n, LongType()) for n in names], StructField("groups", StringType())])
    return both.repartition("block").sortWithinPartitions("block", "kind", "at").mapInArrow(run, schema)
