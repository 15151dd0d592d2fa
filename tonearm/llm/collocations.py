"""Phrase collocations by direct-address tiling.

1. Words are counted by language. Those with `least` occurrences or more are numbered by frequency, over all languages at once.
2. A corpus is held in blocks: the texts of one task, `block` bytes at a time, as one sequence of numbers with gaps where a
   piece ends or a rare word stands. Neighbours in a sequence are a pair. Ranks are split into bands, eight to a doubling,
   and pairs into tiles of two bands, which under Zipf's law hold about as many pairs each, so that no tile is hot. In a block a
   tile with as many pairs as a quarter of its cells or more is counted by direct address, with a dense bincount over the
   cells of all such tiles; the others as sorted coordinates. A block tells each pair once.
3. Tiles are summed over all blocks, again dense or sorted, and pairs of `least` or more are numbered by frequency in turn. The
   blocks are rewritten in these numbers, and neighbours in the new sequence are phrases of one word more: step 2 again.

All parts of a phrase are at least as frequent as it, so nothing is lost. What is exchanged shrinks with each length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonearm.llm.byte_bpe import Numbered, blocks
from tonearm.llm.shared import bound_batches, column, discard, stored

#: Bands to a doubling of ranks; numbers and pairs told in one row; pairs that a task sums at once.
BANDS, CHUNK, AT_ONCE = 8, 200_000, 2_000_000
ITEMS, SEQUENCE, TILE = 0, 1, 2
#: A-Z lower-cased; signs that end a piece become line feeds, and tabs spaces.
_table = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text, and a line feed after each piece."""
    return [w for w in text.encode().translate(_table).replace(b"\n", b" \n ").split(b" ") if w]


def bands(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, its first rank, its width) of each rank, from 1 on: a doubling of ranks is cut into BANDS bands."""
    low = np.log2(BANDS).astype(np.int64)
    octave = np.maximum(np.frexp(rank.astype(np.float64))[1].astype(np.int64) - 1 - low, 0)  # ranks below 2 * BANDS have bands of their own
    step = rank >> octave
    return octave * BANDS + step, step << octave, np.int64(1) << octave


def corner(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rank, width) of a band."""
    octave = np.maximum(band // BANDS - 1, 0)
    return (band - octave * BANDS) << octave, np.int64(1) << octave


def placed(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tile, cell) of pairs of ranks."""
    (band_i, first_i, _), (band_j, first_j, wide) = bands(i), bands(j)
    return band_i << 16 | band_j, (i - first_i) * wide + (j - first_j)


def ranks_at(tile: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ranks again."""
    (first_i, _), (first_j, wide) = corner(tile >> 16), corner(tile & 0xFFFF)
    return first_i + cell // wide, first_j + cell % wide


def tally(tile: np.ndarray, cell: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile, cell, count) of the distinct pairs, each tile's together and in order, and the place there of each pair given."""
    order = np.argsort(tile, kind="stable")
    begins = np.flatnonzero(np.diff(tile[order], prepend=-1))
    size = np.diff(np.r_[begins, len(tile)])
    cells = corner(tile[order[begins]] >> 16)[1] * corner(tile[order[begins]] & 0xFFFF)[1]
    dense = cells <= 4 * size
    # a direct address for each cell of a dense tile, one tile after the other
    offset = np.where(dense, np.cumsum(np.where(dense, cells, 0)) - np.where(dense, cells, 0), -1)
    nth = np.empty(len(tile), np.int64)
    nth[order] = np.repeat(np.arange(len(begins)), size)
    direct = dense[nth]
    place = np.empty(len(tile), np.int64)
    address = offset[nth[direct]] + cell[direct]
    room = int(cells[dense].sum())
    summed = np.bincount(address, None if n is None else n[direct], room)
    taken = np.bincount(address, minlength=room) > 0 if n is not None else summed > 0
    rank = np.cumsum(taken) - 1
    place[direct] = rank[address]
    firsts = np.empty(int(taken.sum()), np.int64)
    firsts[place[direct]] = np.flatnonzero(direct)
    counts = [summed[taken].astype(np.int64)]
    at = np.flatnonzero(~direct)  # sorted coordinates for the rest
    sort = np.lexsort((cell[at], nth[at]))
    at = at[sort]
    new = np.r_[True, (nth[at[1:]] != nth[at[:-1]]) | (cell[at[1:]] != cell[at[:-1]])][: len(at)]
    place[at] = len(firsts) + np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    counts.append(np.add.reduceat(n[at], starts) if n is not None and len(at) else np.diff(np.r_[starts, len(at)]))
    firsts = np.r_[firsts, at[starts]]
    return tile[firsts], cell[firsts], np.concatenate(counts).astype(np.int64), place


def lists(ends: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def packed(cell: np.ndarray, ends: np.ndarray) -> list[pa.ListArray]:
    """Cells of tiles, sorted within each, as steps: their low 16 bits and the rest, which is mostly zeros."""
    step = np.diff(cell, prepend=0)
    step[ends[:-1]] = cell[ends[:-1]]
    return [lists(ends, (step & 0xFFFF).astype(np.uint16).view(np.int16)), lists(ends, step >> 16)]


def summed(step: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums of steps, for each row of the sizes given anew."""
    total = np.cumsum(step, dtype=np.int64)
    return total - np.repeat(np.r_[0, total][np.cumsum(size) - size], size)


def unpacked(low: pa.ListArray, high: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, number of each row's)."""
    size = low.value_lengths().to_numpy().astype(np.int64)
    return summed(low.flatten().to_numpy().view(np.uint16).astype(np.int64) | high.flatten().to_numpy() << 16, size), size


def gathered(found, at_once: int = AT_ONCE):
    """Rows (block, steps, ranks) from arrays (block, at, rank): of `at_once` items or what a task has, those of a block together, in order."""

    def told():
        block, at, rank = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, block))
        block, at, rank = block[order], at[order], rank[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        step = np.diff(at, prepend=0)
        step[first] = at[first]
        ends = np.r_[first, len(block)]
        return pa.RecordBatch.from_arrays([pa.array(block[first]), lists(ends, step.astype(np.int32)), lists(ends, rank.astype(np.int32))], names=["block", "steps", "ranks"])

    held, size = [], 0
    for part in found:
        held.append(part)
        size += len(part[0])
        if size >= at_once:
            yield told()
            held, size = [], 0
    if size:
        yield told()


RANKS = "block long, steps array<int>, ranks array<int>"


def frequent_items(items: DataFrame) -> DataFrame:
    """Items (block, at, rank), rank 0 for rare ones, as rows of RANKS without these."""

    def run(batches):
        def often():
            for b in batches:
                block, at, rank = (x.to_numpy() for x in b.columns)
                yield block[rank > 0], at[rank > 0], rank[rank > 0]

        yield from gathered(often())

    return items.select("block", "at", "rank").mapInArrow(run, RANKS)


def first_blocks(docs: DataFrame, text_col: str, lang_col: str, block: int) -> DataFrame:
    """(block, kind, lang, word, n, at, numbers): the distinct words of each block and language, numbered, and its sequence."""
    source = docs.select(column(text_col).alias("text"), F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        names = ["block", "kind", "lang", "word", "n", "at", "numbers"]
        for held in blocks(batches, 0, block):
            known: dict[str, tuple[Numbered, list]] = {}
            for b in held:
                for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    place, parts = known.setdefault(lang, (Numbered({b"\n": 0}), []))
                    own = words(text.as_py() or "")
                    parts += (np.fromiter(map(place.__getitem__, own), np.int32, len(own)), np.zeros(1, np.int32))
            for lang, (place, parts) in known.items():
                sequence, told = np.concatenate(parts), list(place)[1:]
                counts = np.bincount(sequence, minlength=len(place))[1:]
                for at in range(0, len(told), 10_000):
                    part = told[at : at + 10_000]
                    size = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, number)), pa.array(np.full(size, ITEMS, np.int32)), pa.array([lang] * size), pa.array(part, pa.binary()).cast(pa.string()), pa.array(counts[at : at + size]), pa.array(np.arange(at + 1, at + size + 1)), pa.nulls(size, pa.list_(pa.int32()))], names=names)
                for at in range(0, len(sequence), CHUNK):
                    part = sequence[at : at + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([SEQUENCE], pa.int32()), pa.array([lang]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([at]), lists(np.array([0, len(part)]), part)], names=names)
                number += 1

    return source.mapInArrow(run, "block long, kind int, lang string, word string, n long, at long, numbers array<int>")


def numbered(items: DataFrame, order: list) -> DataFrame:
    """items with rank (long, from 1 on), in this order. Ranges are sorted apart and moved on by what earlier ones hold."""
    ranged = stored(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # one row for each range
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(before, part == F.col("part")).withColumn("rank", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1).drop("at", "part", "before")


def paired(sequences: DataFrame, ranks: DataFrame) -> DataFrame:
    """The blocks of phrases one word longer. sequences: (block, at, numbers), numbers of a block's items, 0 for a gap;
    ranks: rows of RANKS, the ranks of its frequent items. Gives SEQUENCE rows in numbers of pairs, and TILE rows:
    (block, at, tile, low, high, n), the pairs of a tile, numbered from `at` on."""
    merged = sequences.select("block", F.lit(SEQUENCE).alias("kind"), "at", "numbers", F.lit(None).cast("array<int>").alias("ranks")).unionByName(ranks.select("block", F.lit(ITEMS).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("steps").alias("numbers"), "ranks"))
    names = ["block", "kind", "at", "numbers", "tile", "low", "high", "n"]

    def told(block, at, ranks, parts):
        if not ranks or not parts:
            return
        at, ranks, sequence = np.concatenate(at), np.concatenate(ranks), np.concatenate(parts)
        rank_of = np.zeros(max(int(sequence.max(initial=0)), int(at.max(initial=0))) + 1, np.int64)
        rank_of[at] = ranks
        x = rank_of[sequence]
        pair = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        if not len(pair):
            return
        tile, cell, n, place = tally(*placed(x[pair], x[pair + 1]))
        new = np.zeros(len(x), np.int32)
        new[pair] = place + 1
        kept = np.flatnonzero((new > 0) | np.r_[True, new[:-1] > 0])  # of a run of gaps one is enough
        new = new[kept]
        for k in range(0, len(new), CHUNK):
            part = new[k : k + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([SEQUENCE], pa.int32()), pa.array([k]), lists(np.array([0, len(part)]), part), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int16())), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32()))], names=names)
        begins = np.flatnonzero(np.diff(tile, prepend=-1))
        for k in range(0, len(begins), 2000):
            first = begins[k : k + 2000]
            ends = np.r_[first, begins[k + 2000] if k + 2000 < len(begins) else len(tile)]
            own, size = slice(ends[0], ends[-1]), len(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), pa.array(np.full(size, TILE, np.int32)), pa.array(first + 1), pa.nulls(size, pa.list_(pa.int32())), pa.array(tile[first]), *packed(cell[own], ends - ends[0]), lists(ends - ends[0], n[own].astype(np.int32))], names=names)

    def run(batches):
        block, at, ranks, parts = None, [], [], []
        for b in batches:
            number, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
            for first, end in zip(cuts, [*cuts[1:], len(number)], strict=True):
                if number[first] != block:
                    yield from told(block, at, ranks, parts)
                    block, at, ranks, parts = number[first], [], [], []
                own = b.slice(first, end - first)
                if kind[first] == ITEMS:
                    steps = own.column(3)
                    at.append(summed(steps.flatten().to_numpy(), steps.value_lengths().to_numpy().astype(np.int64)))
                    ranks.append(own.column(4).flatten().to_numpy())
                else:
                    parts.append(own.column(3).flatten().to_numpy())
        yield from told(block, at, ranks, parts)

    return merged.repartition("block").sortWithinPartitions("block", "kind", "at").mapInArrow(run, "block long, kind int, at long, numbers array<int>, tile long, low array<smallint>, high array<long>, n array<int>")


def sums(tiles: DataFrame, least: int, at_once: int = AT_ONCE) -> DataFrame:
    """(tile, i, j, n) of the pairs of at least `least` occurrences over all blocks. A task holds some tiles, of about `at_once`
    pairs, at a time; those of a tile that is larger are summed up in between."""

    def run(batches):
        held, size, most, last = [], 0, 4 * at_once, None

        def added():
            return tally(*(np.concatenate(x) for x in zip(*held, strict=True)))[:3]

        def told():
            tile, cell, n = added()
            often = n >= least
            tile, cell, n = tile[often], cell[often], n[often]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (tile, *ranks_at(tile, cell), n)], names=["tile", "i", "j", "n"])

        for b in batches:
            tile = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(tile, prepend=-1)).tolist()
            for first, end in zip(cuts, [*cuts[1:], len(tile)], strict=True):
                if tile[first] != last and size >= at_once:
                    yield told()
                    held, size, most = [], 0, 4 * at_once
                elif size >= most:
                    held = [added()]
                    size = len(held[0][0])
                    most = max(4 * at_once, 2 * size)
                low, high, n = (b.column(k).slice(first, end - first) for k in (1, 2, 3))
                cells, n = unpacked(low, high)[0], n.flatten().to_numpy()
                held.append((np.full(len(cells), tile[first]), cells, n.astype(np.int64)))
                size, last = size + len(cells), tile[first]
        if held:
            yield told()

    return tiles.select("tile", "low", "high", "n").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "tile long, i long, j long, n long")


def met(tiles: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows of RANKS: which items of each block are frequent, a row for a block and a task. The frequent pairs of a tile come before the
    blocks' rows."""
    told = frequent.select("tile", F.lit(0).alias("kind"), F.col("i").alias("block"), F.col("j").alias("at"), F.lit(None).cast("array<smallint>").alias("low"), F.array("rank").alias("high"))
    rows = told.unionByName(tiles.select("tile", F.lit(1).alias("kind"), "block", "at", "low", "high"))

    def found(batches):
        last, known, cell, rank = None, [], None, None
        for b in batches:
            tile, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(tile, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
            for first, end in zip(cuts, [*cuts[1:], len(tile)], strict=True):
                _, _, block, at, low, high = b.slice(first, end - first).columns
                block, at = block.to_numpy(), at.to_numpy()
                if tile[first] != last:
                    last, known, cell = tile[first], [], None
                if not kind[first]:
                    known.append((placed(block, at)[1], high.flatten().to_numpy()))
                    continue
                if not known:
                    continue
                if cell is None:
                    cell, rank = (np.concatenate(x) for x in zip(*known, strict=True))
                    order = np.argsort(cell)
                    cell, rank = cell[order], rank[order]
                own, size = unpacked(low, high)
                at = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(own))
                k = np.minimum(np.searchsorted(cell, own), len(cell) - 1)
                hit = cell[k] == own
                yield np.repeat(block, size)[hit], at[hit], rank[k[hit]]

    return rows.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(lambda batches: gathered(found(batches)), RANKS)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, block: int = 32 << 20) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, total) and, for each length from 1 on, stored tables (rank, i, j, lang, phrase, n, before, after): the phrases of
    `least` or more occurrences, the ranks of their parts without the last and without the first word, and the counts of their
    first 1, 2, .. and of their last 1, 2, .. words."""
    bound_batches(docs.sparkSession, rows=10_000)
    rows = stored(first_blocks(docs, text_col, lang_col, block), "word-blocks")
    items = rows.where(F.col("kind") == ITEMS)
    counts = stored(items.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    nothing = F.array().cast("array<long>")
    ranked = numbered(counts.where(F.col("n") >= least), [F.desc("n"), "lang", "word"])
    found = [stored(ranked.select("rank", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "lang", F.col("word").alias("phrase"), "n", nothing.alias("before"), nothing.alias("after")), "phrases")]
    own = found[0].select(F.concat("lang", F.lit("")).alias("lang"), F.col("phrase").alias("word"), "rank")
    ranks, sequences = frequent_items(items.select("block", "at", "lang", "word").join(own, ["lang", "word"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))), rows.where(F.col("kind") == SEQUENCE)
    for _ in range(longest - 1):
        old, rows = rows, stored(paired(sequences.select("block", "at", "numbers"), ranks), "pair-blocks")
        discard(old)
        tiles = rows.where(F.col("kind") == TILE)
        pairs = stored(numbered(sums(tiles, least), [F.desc("n"), "i", "j"]), "pairs")
        ranks, sequences = met(tiles, pairs), rows.where(F.col("kind") == SEQUENCE)
        side = lambda name: found[-1].select(F.expr("rank ^ 0L").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("lang", "phrase", "n", "before", "after")])  # noqa: B023, E731
        phrase = F.concat_ws(" ", "phrase_i", F.substring_index("phrase_j", " ", -1))
        joined = pairs.join(side("i"), "i").join(side("j"), "j")
        found.append(stored(joined.select("rank", "i", "j", F.col("lang_i").alias("lang"), phrase.alias("phrase"), "n", F.concat("before_i", F.array("n_i")).alias("before"), F.concat("after_j", F.array("n_j")).alias("after")), "phrases"))
    discard(rows)
    return totals, found


def score(a: str, n: str, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), on decimals of 38 digits: counts of up to 10^15 are exact."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(F.col(a)) * whole(F.col(n)), whole(left) * whole(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, first: int = 2000, block: int = 32 << 20) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the `first` phrases of each language by score, then by a, both descending,
    then by phrase.

    A phrase is 2 to `longest` words of one piece (a text without [.,;:!?], line feed to carriage return; A-Z lower-cased; words are
    parted by spaces and tabs) with a = its occurrences, overlaps included, of at least `least`. Cut in two, with l and r
    occurrences of the parts, it scores floor(1000 a n / (l r)), n the words of the language; its lowest cut counts, of equals the
    first. A phrase is dropped if one that is longer and holds it is as frequent (one of one word more then is: counts only
    fall with length). The arithmetic is on decimals of 38 digits.

    Nulls: a null text, like an empty one, has no words; a null language is `und`. Long texts are whole, repeated rows count
    each. An empty table gives no rows. Other columns are not read.
    """
    totals, found = phrase_counts(docs, text_col, lang_col, least, longest, block)
    kept = None
    for size, phrases in enumerate(found[1:], 2):
        if size < longest:
            longer = found[size].select(F.explode(F.array("i", "j")).alias("part"), F.col("n").alias("longer"))
            most = longer.groupBy("part").agg(F.max("longer").alias("longer")).select(F.expr("part ^ 0L").alias("part"), "longer")
            phrases = phrases.join(most, (F.col("rank") == F.col("part")) & (F.col("longer") >= F.col("n")), "left_anti")
        kept = phrases if kept is None else kept.unionByName(phrases)
    named = kept.select("lang", "phrase", F.col("n").alias("a"), "before", "after").join(totals.select(F.col("lang"), F.col("total").alias("n")), "lang")

    def cut(k):
        left, right = F.get("before", k), F.get("after", F.size("after") - 1 - k)
        return F.struct(score("a", "n", left, right).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    lowest = named.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(0), F.size("before") - 1), cut)))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
