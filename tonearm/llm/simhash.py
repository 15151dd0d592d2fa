"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Each text gets a 64-bit fingerprint (4-word shingles, XXH64 with seed 42, majority per bit).
2. Distinct fingerprints are dealt out by masked bits: with b blocks of bits, two fingerprints that differ in at most d
   bits agree on some b-d whole blocks, so every linked pair meets under at least one mask. b is the least number of
   blocks for which an even share of the fingerprints stays under `share` rows; a bucket that is larger than `cell`
   all the same is cut into chunks, and every pair of chunks meets in a cell of its own. No pair is lost.
3. In a task, the fingerprints of each bucket are sorted by Gray rank and put under a tree: a node holds the bits that
   all its members share (mask and pattern). A self-join walks pairs of nodes from the top; the differences that the
   shared bits show add up on the way down, and a pair of groups whose sum passes d is pruned whole.
4. A task gives one link from each fingerprint to the smallest of its local component, never all pairs of a cluster.
5. The links of all tasks are joined into components by alternating large-star and small-star rounds, each written to
   the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.shared import bound_batches, column, discard, stored, whole

LEAF, FAN_OUT, FRONTIER = 16, 8, 100_000


def fingerprint(text: str | None, shingle: int = 4, chunk: int = 65_536) -> int:
    """Unsigned 64-bit SimHash of one text; 0 if it has no words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return digest(b" ".join(found), 42)
    parts = zip(*(found[i:] for i in range(shingle)), strict=False)
    hashes = np.fromiter((digest(b" ".join(p), 42) for p in parts), np.uint64, len(found) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        ones += np.unpackbits(hashes[at : at + chunk].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row of docs, fp the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.dtypes[0][1]}, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the order of the reflected Gray code."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchical index over fingerprints of one or more words each, sorted by bucket and then by the Gray rank of each
    word. levels[0] are the leaves' parents. Pairs of one `group` are not asked for: the nodes hold their common group too."""

    def __init__(self, bucket: np.ndarray, fps: np.ndarray, group: np.ndarray | None = None):
        fps = fps.reshape(len(bucket), -1)
        group = np.arange(len(bucket)) if group is None else group
        order = np.lexsort((*[gray_rank(fps[:, k]) for k in reversed(range(fps.shape[1]))], bucket))
        self.order, self.fps, self.group = order, fps[order], group[order]
        owner, low, high, width = bucket[order], self.fps, self.fps, LEAF
        first_group = last_group = self.group
        self.levels = []  # (first child, end child, shared mask, pattern, common group or -1)
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            first = np.flatnonzero(place % width == 0)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            first_group, last_group = np.minimum.reduceat(first_group, first), np.maximum.reduceat(last_group, first)
            self.levels.append((first, np.r_[first[1:], len(owner)], ~(low ^ high), low, np.where(first_group == last_group, first_group, -1)))
            owner, width = owner[first], FAN_OUT
            if len(starts) == len(first):
                break

    def pairs(self, bits: int):
        """Batches of (i, j), i < j in index order: all pairs of one bucket and different groups that differ in at most `bits` bits."""
        top, most = len(self.levels) - 1, 8 * FRONTIER // self.fps.shape[1]
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots[at : at + FRONTIER], roots[at : at + FRONTIER]) for at in range(0, len(roots), FRONTIER)]
        while stack:
            level, a, b = stack.pop()
            first, end = self.levels[level][:2]
            sizes = (end[a] - first[a]) * (end[b] - first[b])
            if sizes.sum() > most and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            at = np.repeat(np.arange(len(a)), sizes)
            k = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            wide = (end[b] - first[b])[at]
            i, j = first[a][at] + k // wide, first[b][at] + k % wide
            if level:
                _, _, shared, pattern, group = self.levels[level - 1]
                asked = (i <= j) & ((group[i] != group[j]) | (group[i] < 0))
                i, j = i[asked], j[asked]
                near = np.bitwise_count((pattern[i] ^ pattern[j]) & shared[i] & shared[j]).sum(axis=1) <= bits
                if near.any():
                    stack.append((level - 1, i[near], j[near]))
            else:
                asked = (i < j) & (self.group[i] != self.group[j])
                i, j = i[asked], j[asked]
                near = np.bitwise_count(self.fps[i] ^ self.fps[j]).sum(axis=1) <= bits
                if near.any():
                    yield i[near], j[near]


def local_links(bucket: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its component) for what links inside the buckets given."""
    index = GrayIndex(bucket, fps)
    values, label = np.unique(index.fps[:, 0], return_inverse=True)  # by value, so that copies under several masks agree
    parent = np.arange(len(values))
    for i, j in index.pairs(bits):
        a, b = label[i], label[j]
        while True:
            ra, rb = parent[a], parent[b]
            differs = ra != rb
            if not differs.any():
                break
            a, b = a[differs], b[differs]
            np.minimum.at(parent, np.maximum(ra, rb)[differs], np.minimum(ra, rb)[differs])
            while (parent[parent] != parent).any():
                parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(values)))
    return values[moved], values[parent[moved]]


def masks(n: int, bits: int, share: int) -> list[int]:
    """Masks over 64 bits: each pair within `bits` bits agrees under at least one. The more fingerprints, the finer."""
    for blocks in range(bits + 1, 2 * bits + 1):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        if n >> (64 * (blocks - bits) // blocks) <= share:
            break
    return [sum(c) for c in combinations(part, blocks - bits)]


def whole_buckets(batches, by: tuple[str, ...], least: int):
    """(table, bucket number of each row) of at least `least` rows each, cut between buckets; the batches come sorted by the
    columns that tell buckets apart."""

    def told(rows):
        t = pa.Table.from_batches(rows)
        key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in by])
        return t, np.cumsum(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if size >= least:  # go on to the end of the bucket
            last = [held[-1].column(c)[-1].as_py() for c in by]
            same = np.logical_and.reduce([b.column(c).to_numpy() == x for c, x in zip(by, last, strict=True)])
            cut = int(b.num_rows if same.all() else np.argmin(same))
            if cut < b.num_rows:
                yield told([*held, b.slice(0, cut)])
                held, size, b = [], 0, b.slice(cut)
        held.append(b)
        size += b.num_rows
    if held:
        yield told(held)


def links(nodes: DataFrame, bits: int = 4, share: int = 4096, cell: int = 50_000) -> DataFrame:
    """(u, v) fingerprints as signed longs, u <> v: within each meeting place, a star for every local component.
    nodes: one row per distinct fingerprint, column fp."""
    n = nodes.count()
    by = [m - (1 << 64) if m >> 63 else m for m in masks(n, bits, share)]
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(by)])).alias("k")).select("fp", "k.*")
    large = keyed.groupBy("mask", "part").count().where(F.col("count") > cell).withColumn("chunks", F.ceil(F.col("count") * 2 / cell).cast("int")).drop("count")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != mine)
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.transform(others, lambda c: F.least(c, mine) * F.col("chunks") + F.greatest(c, mine)))
    dealt = keyed.join(large, ["mask", "part"], "left").select("fp", "mask", "part", F.explode(cells).alias("cell"))

    def run(batches):
        for t, bucket in whole_buckets(batches, ("mask", "part", "cell"), 4 * cell):
            u, v = local_links(bucket, t.column("fp").to_numpy().view(np.uint64).copy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    parts = ["mask", "part", "cell"]
    return dealt.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(run, "u long, v long").where("u <> v")


def components(edges: DataFrame, name: str = "star") -> DataFrame:
    """(node, root): root is the smallest node reachable. Large-star and small-star rounds until nothing changes."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    def signature(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def smallest(of):  # "^ 0" hides that the sums are dealt by u: the join then exchanges both sides and can split a hot node
        return of.select(F.expr("u ^ 0L").alias("w"), "m")

    state = signature(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = smallest(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = smallest(large.groupBy("u").agg(F.min("v").alias("m")))
        ends = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        small = large.join(lower, F.col("u") == F.col("w")).select(ends).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        old, edges = edges, stored(small, name)
        discard(old)
        before, state = state, signature(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, shingle: int = 4, share: int = 4096, cell: int = 50_000) -> DataFrame:
    """One row per row of docs: id, fp (signed long), component_id: the smallest id reachable over links of at most `bits` bits.

    Nulls: a null text has no words and fingerprint 0, which links like any other; a null id gets a component but never
    names one that has other ids. Repeated rows share a fingerprint and a component. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), bits, share, cell))
    rooted = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_texts")).where("n_texts > 1").drop("n_texts"), "names")
    named = rooted.join(names, "root", "left").select(F.col("fp").alias("node"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, rows.fp == named.node).select(F.col("id").alias(id_col), "fp", "component_id")


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs, all columns as they are, without the rows whose id is in `gone` (one column, distinct)."""
    left = docs.select(whole(docs), column(id_col).alias("at")).join(gone.toDF("gone"), F.col("at") == F.col("gone"), "left_anti")
    return left.select("row.*")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns as they are, whatever their names, without those that are linked to a smaller id by their
    fingerprints. Rows without an id stay, and rows that repeat an id stay or go together. An empty table gives no rows."""
    found = near_copies(docs, id_col, text_col, **how)
    return without(docs, found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), id_col)
