"""The one function Catalyst lacks: the sequence-matching ratio, and exact bounds that keep it off most pairs.

The ratio depends on the order of its arguments, and on characters that are frequent in a second argument of 200 or
more; both are kept, since the standard library's matcher is what computes it.
"""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Sequences up to this length are matched many pairs at a time, a bit for each place of the second one.
SHORT = 63
#: Pairs that are matched together, numbers in a table of characters, and common blocks that are looked at together, at most.
TOGETHER, TABLE, BLOCKS = 8192, 4_000_000, 2_000_000


#: Once it has given back a block of this size, glibc keeps freed memory up to twice as much, and does not ask for pages again and again.
np.empty(31 << 20, "u1")
_kept: dict[str, np.ndarray] = {}


def _room(name: str, shape: tuple[int, int], dtype: np.dtype) -> np.ndarray:
    """An array to write to, of memory that the next call with this name takes again: new memory costs as much as the work on it."""
    size = shape[0] * shape[1] * np.dtype(dtype).itemsize
    if name not in _kept or len(_kept[name]) < size:
        _kept[name] = np.empty(size, "u1")
    return _kept[name][:size].view(dtype).reshape(shape)


def _blocks(equal: np.ndarray, words: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, place in a, place in b, size), by pairs: the common blocks that begin at the given bits of words of `equal`, as long
    as they can be; counts: of bits a word."""
    one, width, flat = equal.dtype.type(1), np.int32(equal.shape[1]), equal.ravel()
    at = np.repeat(words.astype("i4"), counts)
    j, to = np.empty(len(at), "i4"), np.cumsum(counts, dtype="i4") - counts
    while len(bits):
        rest = bits & (bits - one)  # without the lowest
        j[to] = np.bitwise_count((bits ^ rest) - one)
        more = np.flatnonzero(rest)
        bits, to = rest[more], to[more] + 1
    pair = at // width
    size, k = np.full(len(at), 2, "i4"), 2
    left, ahead, bit = np.arange(len(at), dtype="i4"), at + 2, one << (j + 2).astype(equal.dtype)
    while True:
        more = np.flatnonzero(flat[ahead] & bit)
        if not len(more):
            return pair, at - pair * width, j, size
        left, ahead, bit, k = left[more], ahead[more] + 1, bit[more] << one, k + 1
        size[left] = k


def _matched(equal: np.ndarray) -> np.ndarray:
    """How many places the standard matcher pairs, for each row of `equal`, which holds for each place of a the places of b that
    are the same, as bits, the highest of which is free, and 0 at its end.

    The matcher takes the longest common block, of equals the first in a, then in b, and so on at both sides of it. These sides
    do not depend on each other, so the longest block of a pair is taken again and again, and the others are cut to what is open then:
    a block no longer than the one taken has a rest at one side of it at most. Single places come last, in one pass over
    a: before the first one of a side there is none, and the next ones lie after it."""
    pairs, places = equal.shape
    kind = equal.dtype.type
    one, found = kind(1), np.zeros(pairs, "i8")
    starts, more = _room("starts", equal.shape, kind), _room("more", equal.shape, kind)
    np.right_shift(equal[:, 1:], one, out=starts[:, :-1])
    starts[:, -1] = 0
    starts &= equal  # of two or more,
    np.left_shift(equal[:, :-1], one, out=more[:, 1:])
    more[:, 0] = 0
    np.invert(more, out=more)
    starts &= more  # that do not go on from the place before
    words = np.flatnonzero(starts)
    bits = starts.ravel()[words]
    counts = np.bitwise_count(bits)
    if pairs > 1 and counts.sum(dtype="i8") > BLOCKS:
        return np.concatenate([_matched(x.copy()) for x in (equal[: pairs // 2], equal[pairs // 2 :])])
    since, until = _room("starts", (places, pairs), kind), _room("more", (places, pairs), kind)  # places of b that are open from a's place on, and up to it
    since[:], until[:] = 0, ~kind(0)
    pair, i, j, size = _blocks(equal, words, bits, counts)
    ahead = j - i
    while len(pair):
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        best = np.maximum.reduceat((size << 12) | ((63 - i) << 6) | (63 - i - ahead), first)
        own, n, bi, bj = pair[first], best >> 12, 63 - ((best >> 6) & 63), 63 - (best & 63)
        found[own] += n
        since[bi, own] = one << (bj + n).astype(kind)
        until[bi + n - 1, own] = (one << bj.astype(kind)) - one
        of = np.repeat(np.arange(len(first)), np.diff(first, append=len(pair)))
        off, bi, n, end = (bj - bi)[of] - ahead, bi[of], n[of], i + size
        before = np.minimum(end, bi + np.minimum(off, 0)) - i
        later = np.maximum(i, bi + n + np.maximum(off, 0))
        i = np.where(before > 0, i, later)
        size = np.where(before > 0, before, end - later)
        some = np.flatnonzero(size > 1)
        pair, i, ahead, size = pair[some], i[some], ahead[some], size[some]
    for r in range(places - 1, 0, -1):
        until[r - 1] &= until[r]
    until &= equal.T
    least, x, y, singles = np.ones(pairs, kind), np.empty(pairs, kind), np.empty(pairs, kind), np.zeros(pairs, "u1")
    for r in range(places - 1):
        np.maximum(least, since[r], out=least)
        np.negative(least, out=x)
        x &= until[r]
        singles += x != 0
        np.negative(x, out=y)
        x &= y
        x <<= one
        np.maximum(least, x, out=least)
    return found + singles


class _Texts:
    """Strings or arrays of numbers; short ones as columns of numbers of their characters, `signs` where there is none."""

    def __init__(self, texts: list):
        self.texts, self.sizes = texts, np.fromiter(map(len, texts), "i8", len(texts))
        short = np.flatnonzero(self.sizes <= SHORT)
        width = int(self.sizes[short].max(initial=0)) + 1  # the last place is empty
        full = np.zeros((len(texts), width), "i8")
        there = np.arange(width) < self.sizes[short, None]
        if not len(short):
            pass
        elif isinstance(texts[0], str):
            full[short] = np.array([texts[i] for i in short], f"U{width}").view("u4").reshape(len(short), width)
        else:
            full[np.repeat(short, self.sizes[short]), np.nonzero(there)[1]] = np.concatenate([texts[i] for i in short])
        seen = np.zeros(int(full.max(initial=0)) + 1, bool)
        seen[full[short][there]] = True
        self.signs = int(seen.sum())
        full = (np.cumsum(seen) - 1)[full]
        full[np.arange(width) >= np.where(self.sizes <= SHORT, self.sizes, 0)[:, None]] = self.signs
        self.codes = full

    def matched(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places that the matcher pairs, for pairs of short ones given by their numbers. Pairs with one b after the other share its table."""
        found, step = np.zeros(len(a), "i8"), max(min(TOGETHER, TABLE // (self.signs + 1)), 1)
        for lo in range(0, len(a), step):
            x, y = a[lo : lo + step], b[lo : lo + step]
            new = np.append(True, y[1:] != y[:-1])
            own = y[new]
            wide, rows = int(self.sizes[own].max()), np.arange(len(own))
            table = np.zeros((len(own), self.signs + 1), "u4" if wide < 32 else "u8")
            for j in range(wide):
                table[rows, self.codes[own, j]] |= table.dtype.type(1 << j)
            table[:, self.signs] = 0
            width = int(self.sizes[x].max()) + 1
            at = self.codes[:, :width].take(x, 0, out=_room("at", (len(x), width), np.int64), mode="clip")
            at += ((np.cumsum(new) - 1) * (self.signs + 1))[:, None]
            found[lo : lo + step] = _matched(table.ravel().take(at, out=_room("equal", at.shape, table.dtype), mode="clip"))
        return found

    def ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The standard matcher's ratios of pairs given by their numbers: short ones many at a time, the others by it."""
        n_a, n_b = self.sizes[a], self.sizes[b]
        out, some = np.ones(len(a)), (n_a > 0) & (n_b > 0)
        out[(n_a > 0) ^ (n_b > 0)] = 0.0
        short = some & (n_a <= SHORT) & (n_b <= SHORT)
        for at in (np.flatnonzero(short & (n_b < 32)), np.flatnonzero(short & (n_b >= 32))):
            out[at] = 2.0 * self.matched(a[at], b[at]) / (n_a[at] + n_b[at])
        matcher, last = SequenceMatcher(None), -1
        for i in np.flatnonzero(some & ~short):
            x, y = self.texts[a[i]], self.texts[b[i]]
            x, y = (x, y) if isinstance(x, str) else (x.tolist(), y.tolist())
            if b[i] != last:
                matcher.set_seq2(y)
                last = b[i]
            matcher.set_seq1(x)
            out[i] = matcher.ratio()
        return out


def _ratios_of(a: list, b: list) -> np.ndarray:
    """The standard matcher's ratios of two lists of strings, or of arrays of numbers."""
    if not a:
        return np.zeros(0)
    if isinstance(b[0], str):
        told = pa.array([*a, *b], pa.string()).dictionary_encode()
        codes = told.indices.to_numpy()
        return _Texts(told.dictionary.to_pylist()).ratios(codes[: len(a)], codes[len(a) :])
    return _Texts([*a, *b]).ratios(np.arange(len(a)), len(a) + np.arange(len(b)))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    at = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    left, right = [a.iloc[i] for i in at], [b.iloc[i] for i in at]
    if at and not isinstance(left[0], str):
        numbers: dict = {}
        left, right = ([np.array([numbers.setdefault(v, len(numbers)) for v in x], "i8") for x in side] for side in (left, right))
    if at:
        out[at] = _ratios_of(left, right)
    return pd.Series([None if np.isnan(x) else x for x in out], dtype="float64")


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two strings, or of two lists of strings; two empty ones give 1, null gives null."""
    return _ratios(a, b)


@F.pandas_udf(DoubleType())
def list_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same, asked once for a row, whatever filter stands above."""
    return _ratios(a, b)


@F.pandas_udf(DoubleType())
def ratio_sum(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sum of the ratios of two arrays of strings, place by place; a place where either is null or empty counts 0, and equal ones
    are not asked for. Of a batch each distinct pair is scored once, in the order of the second strings."""
    places = np.array([0 if x is None or y is None else min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    out = np.where([x is None or y is None for x, y in zip(a, b, strict=True)], np.nan, 0.0)
    if places.sum():
        told = pa.array([s for side in (a, b) for x, n in zip(side, places, strict=True) if n for s in x[:n]], pa.string()).dictionary_encode()
        codes, strings = told.indices.fill_null(-1).to_numpy(), told.dictionary.to_pylist()
        x, y = codes[: places.sum()], codes[places.sum() :]
        full = np.append([s != "" for s in strings], False)  # the last one: null
        both = full[x] & full[y]
        ratio = (both & (x == y)).astype("f8")
        asked = np.flatnonzero(both & (x != y))
        pairs, which = np.unique(y[asked].astype("i8") * len(strings) + x[asked], return_inverse=True)
        ratio[asked] = _ratios_of([strings[i] for i in pairs % len(strings)], [strings[i] for i in pairs // len(strings)])[which]
        out += np.bincount(np.repeat(np.arange(len(a)), places), ratio, len(a))
    return pd.Series(out, dtype="float64")


class _Lists:
    """Lists of strings: distinct ones once, as numbers of distinct strings one after the other."""

    def __init__(self, lists: list):
        known: dict = {}
        self.number = np.array([known.setdefault(tuple(x), len(known)) for x in lists], "i8")
        told = pa.array([s for x in known for s in x], pa.string()).dictionary_encode()
        self.texts, self.code = _Texts(told.dictionary.to_pylist()), told.indices.to_numpy().astype("i8")
        self.sizes = np.array([len(x) for x in known], "i8")
        self.since = np.cumsum(self.sizes) - self.sizes

    def places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pair, string of a, string of b) for each place of pairs of lists."""
        n = np.minimum(self.sizes[a], self.sizes[b])
        pair = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(pair)) - (np.cumsum(n) - n)[pair]
        return pair, self.code[self.since[a][pair] + at], self.code[self.since[b][pair] + at]

    def _once(self, a: np.ndarray, b: np.ndarray, count: int, f) -> np.ndarray:
        """f of the distinct pairs of numbers under `count`, by the second ones, told for all."""
        pairs = pa.array(b * count + a).dictionary_encode()
        key = pairs.dictionary.to_numpy()
        order, out = np.argsort(key), np.empty(len(key))
        out[order] = f(key[order] % count, key[order] // count)
        return out[pairs.indices.to_numpy()]

    def sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of the ratios of pairs of lists, place by place; a place where either is empty counts 0."""

        def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pair, x, y = self.places(a, b)
            both = (self.texts.sizes[x] > 0) & (self.texts.sizes[y] > 0)
            ratio, asked = (both & (x == y)).astype("f8"), np.flatnonzero(both & (x != y))
            ratio[asked] = self._once(x[asked], y[asked], len(self.texts.texts), self.texts.ratios)
            return np.bincount(pair, ratio, len(a))

        return self._once(self.number[a], self.number[b], len(self.sizes), of)

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What `sums` can be at most, by the lengths of the strings."""
        pair, x, y = self.places(self.number[a], self.number[b])
        x, y = self.texts.sizes[x], self.texts.sizes[y]
        return np.bincount(pair, np.where((x > 0) & (y > 0), 2.0 * np.minimum(x, y) / np.maximum(x + y, 1), 0.0), len(a))


@F.arrow_udf(ArrayType(DoubleType()))
def ratio_sums(a: pa.Array, b: pa.Array, weights: pa.Array, least: pa.Array) -> pa.Array:
    """Sums of the ratios of two folders' strings, field by field and place by place as in `ratio_sum`. A folder is one text, the JSON
    of a list of its fields, each a list of strings, so that a folder that meets many is read once a batch. Null gives null, as
    does a pair whose sums, each times its weight, stay under `least` all together: fields are asked for from the last to
    the first, and a pair ends where the rest, by its lengths, cannot bring it there."""
    rows = np.flatnonzero(a.is_valid().to_numpy(False) & b.is_valid().to_numpy(False))
    if not len(rows):
        return pa.nulls(len(a), pa.list_(pa.float64()))
    told = pa.concat_arrays([a.take(pa.array(rows)), b.take(pa.array(rows))]).dictionary_encode()
    folders = [json.loads(x) for x in told.dictionary.to_pylist()]
    number = told.indices.to_numpy()
    left, right = number[: len(rows)], number[len(rows) :]
    fields = [_Lists(list(x)) for x in zip(*folders, strict=True)]
    sums = np.zeros((len(rows), len(fields)))
    weight = weights.flatten().to_numpy(False).reshape(len(a), -1)[rows] if least.null_count < len(a) else None
    bound = least.fill_null(-np.inf).to_numpy(False)[rows]
    pruned, kept = bool(np.isfinite(bound).any()), np.arange(len(rows))
    if pruned:
        most = np.stack([f.most(left, right) for f in fields], 1) * weight
        kept = np.flatnonzero(most.sum(1) >= bound)
    for c in range(len(fields) - 1, -1, -1):
        sums[kept, c] = fields[c].sums(left[kept], right[kept])
        if pruned and len(kept):
            most[kept, c] = sums[kept, c] * weight[kept, c]
            kept = kept[most[kept].sum(1) >= bound[kept]]
    rows = rows[kept]
    some = np.zeros(len(a), bool)
    some[rows] = True
    ends = np.append(0, np.cumsum(some * len(fields))).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[kept].ravel()), mask=pa.array(~some))


#: Not to be asked twice for a row: a filter on what follows from it stays above it.
ratio_sum, ratio_sums, list_ratio = ratio_sum.asNondeterministic(), ratio_sums.asNondeterministic(), list_ratio.asNondeterministic()


def list_ratios(rows: DataFrame, a: str, b: str, surely_apart: Column | None = None) -> DataFrame:
    """rows with ratio, that of two arrays of strings. Arrays that share no string, which most are, have 0 (two empty ones 1) and
    never reach the matcher; the rows are read once for either kind. Nulls give null. surely_apart: what tells, without a look
    at the strings, that none is shared."""
    apart = F.coalesce(~F.arrays_overlap(a, b), F.lit(True))
    if surely_apart is not None:
        apart = F.when(surely_apart, F.lit(True)).otherwise(apart)
    plain = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(0.0))
    return rows.where(apart).withColumn("ratio", plain).unionByName(rows.where(~apart).withColumn("ratio", seq_ratio(a, b)))


def length_bound(a: Column, b: Column) -> Column:
    """The ratio of two strings is never above this."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.least(F.length(a), F.length(b)) / total)


def bag(text: Column) -> Column:
    """The characters of a text, each numbered among its equals, as an array of hashes; null is empty."""
    chars = F.array_sort(F.array_remove(F.split(F.coalesce(text, F.lit("")), ""), ""))
    return F.transform(F.array(chars), lambda x: F.transform(x, lambda c, i: F.xxhash64(c, i - F.array_position(x, c))))[0]


def multiset_bound(a: Column, b: Column) -> Column:
    """Nor above this: shared characters, counted with repeats. Tighter, and dearer."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(bag(a), bag(b))) / total)


#: Distinct first strings of one second string that a task scores; a second string with more is cut.
PER_PART = 20_000


def scored(pairs: DataFrame, a: str = "a", b: str = "b", per_part: int = PER_PART) -> DataFrame:
    """(a, b, ratio) for the distinct pairs given: each is scored once, however often it occurs; equal ones not at all. Pairs are
    dealt by b and come sorted by it, so that the matcher indexes a second argument once; a b with very many is dealt by a too."""
    own = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    same = own.where("a = b").withColumn("ratio", F.lit(1.0))
    other = own.where("a <> b")
    hot = other.groupBy("b").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts")).where("parts > 1").select(F.concat("b", F.lit("")).alias("hot"), "parts")
    part = F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"), F.lit(0))
    other = other.join(hot, F.col("b") == F.col("hot"), "left").select("a", "b", part.alias("part")).repartition("b", "part").sortWithinPartitions("b", "a").drop("part")
    return same.unionByName(other.withColumn("ratio", seq_ratio("a", "b")))
