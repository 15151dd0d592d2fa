"""Near copies by several SimHash fingerprints in the Gray-order index, each link verified exactly.

1. A text is the set of the hashes of its five-word shingles (XXH64; words as in simhash). Rows with equal sets are one node.
2. A node has several 64-bit fingerprints, one for each of some independent seeds. Two sets of similarity 0.8 differ in 15 %
   of all bits. Nodes are dealt out by blocks of bits, `tables` of them; the blocks grow with the number of nodes, so that
   chance meetings stay few, and their number with the blocks, so that a pair at 0.8 meets under at least one of them with
   probability RECALL. Under a block the Gray-order index finds the pairs that differ in at most REACH of the first 256 bits.
3. First each node goes with the first near node of its bucket (its leader); these pairs are compared on their whole sets,
   by a join, and only a similarity of `over` / `of` or more makes a link. What the links join is a component.
4. Nodes of different components that are near, over any number of steps, form a clump. The sets of a clump are brought
   together once for each node and compared there, all with all, by a product of matrices; a large clump is cut into cells.
   So rows grow with the nodes, not with the pairs of a cluster, and no pair that could join two components is left out.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.shared import bound_batches, column, discard, stored
from tonearm.llm.simhash import GrayIndex, components, whole_buckets, without

SHINGLE, COMPARED = 5, 4
#: Chance that a pair exactly at the limit shares a block; nodes that may meet by chance under a block; most standard
#: deviations of the number of differing bits that a pair at the limit may lie above its mean.
RECALL, BY_CHANCE, SPREAD = 0.995, 256, 3.5


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes; fewer words are one shingle, no words are the set of 0 alone."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(1, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(found) - shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + shingle]), 42) for i in range(n)), np.uint64, n))


def fingerprints(of: np.ndarray, seeds: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """A 64-bit SimHash of a set for each seed: the hashes are mixed with the seed, bits set in over half of them are 1."""
    ones = np.zeros(64 * len(seeds), np.int64)
    for at in range(0, len(of), chunk):
        x = (of[at : at + chunk, None] ^ seeds) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(of)).view(">u8").astype(np.uint64)


def differing(over: int, of: int) -> float:
    """Share of differing bits of two sets with this similarity, as for two vectors at that angle."""
    return acos(2 * over / (over + of)) / pi


def reach(over: int, of: int) -> int:
    p, n = differing(over, of), 64 * COMPARED
    return ceil(n * p + SPREAD * (n * p * (1 - p)) ** 0.5)


def blocks(n: int, over: int, of: int) -> tuple[int, int]:
    """(bits of a block, number of blocks) for n nodes."""
    width = min(32, max(8, ceil(log2(max(n, 1) / BY_CHANCE)))) if n > BY_CHANCE else 8
    return width, ceil(log(1 - RECALL) / log(1 - (1 - differing(over, of)) ** width))


def mapped(docs: DataFrame, id_col: str, text_col: str, name: str, of) -> DataFrame:
    """(id, s, name): one row per row of docs; s is a hash of the set, name what `of` gives for it."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):  # a batch of sets is larger than its texts
                part = b.slice(at, 200)
                sets = [grams(t) for t in part.column(1).to_pylist()]
                s = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64).view(np.int64)
                told = [of(x) for x in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in told])].astype(np.int32)), pa.array(np.concatenate(told).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), lists], names=["id", "s", name])

    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.dtypes[0][1]}, s long, {name} array<long>")


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, s, f): the fingerprints of each row."""
    seeds = np.random.default_rng(5).integers(0, 2**64, words, np.uint64)
    return mapped(docs, id_col, text_col, "f", lambda x: fingerprints(x, seeds))


def dealt(nodes: DataFrame, width: int, tables: int) -> DataFrame:
    """(block, part, s, f0..): each node once for every block, with the bits that it has there. Blocks do not cross words."""
    each, mask = 64 // width, (1 << width) - 1
    parts = [F.struct(F.lit(t).alias("block"), F.shiftrightunsigned(F.col("f")[t // each], t % each * width).bitwiseAND(F.lit(mask)).alias("part")) for t in range(tables)]
    kept = [c for c in nodes.columns if c not in ("s", "f")]
    return nodes.select("s", *kept, *[F.col("f")[k].alias(f"f{k}") for k in range(COMPARED)], F.explode(F.array(*parts)).alias("p")).select("p.*", "s", *kept, *[f"f{k}" for k in range(COMPARED)])


def leaders(bucket: np.ndarray, fps: np.ndarray, bits: int, rounds: int = 3) -> np.ndarray:
    """For each row the place of the first row near to it, found in some rounds over all buckets at once; else its own."""
    group, left = np.arange(len(bucket)), np.arange(len(bucket))
    for _ in range(rounds):
        b = bucket[left]
        begins = np.r_[True, b[1:] != b[:-1]]
        first = left[begins][np.cumsum(begins) - 1]
        near = np.bitwise_count(fps[left] ^ fps[first]).sum(axis=1) <= bits
        group[left[near]] = first[near]
        left = left[~near]
        if not len(left):
            break
    return group


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the rows a and b, in place; a component is labelled by its least row."""
    while True:
        ra, rb = label[a], label[b]
        differs = ra != rb
        if not differs.any():
            return
        a, b = a[differs], b[differs]
        np.minimum.at(label, np.maximum(ra, rb)[differs], np.minimum(ra, rb)[differs])
        while (label[label] != label).any():
            label[:] = label[label]


def in_cells(rows: DataFrame, cell: int) -> DataFrame:
    """rows with a cell of their bucket; a bucket that weighs over `cell` has many, so that no task holds it whole. A row weighs
    what its column w says, else 1.

    Without components (c) a row goes to one cell by a hash of its node. With them the bucket's largest component is cut
    apart from its other nodes: each part of the others meets each part of either, and parts of the largest component
    do not meet each other."""
    by = ["block", "part"]
    own, weight = F.xxhash64("s"), F.sum("w" if "w" in rows.columns else F.lit(1)).alias("count")
    if "c" not in rows.columns:
        large = rows.groupBy(*by).agg(weight).where(F.col("count") > cell).select("block", hidden("part", "part"), F.ceil(F.col("count") * 2 / cell).cast("int").alias("n"))
        return rows.join(large, by, "left").withColumn("cell", F.coalesce(F.pmod(own, F.col("n")).cast("int"), F.lit(0))).drop("n")
    sizes = rows.groupBy(*by, "c").agg(weight).groupBy(*by).agg(F.sum("count").alias("n"), F.max("count").alias("n_top"), F.max_by("c", F.struct("count", "c")).alias("top")).where(F.col("n") > cell)
    parts = lambda n: F.greatest(F.ceil(n * 2 / cell), F.lit(1)).cast("int")
    large = sizes.select("block", hidden("part", "part"), "top", parts(F.col("n_top")).alias("tops"), parts(F.col("n") - F.col("n_top")).alias("rests"))
    rest, top = F.pmod(own, F.col("rests")).cast("int"), F.pmod(own, F.col("tops")).cast("int")
    mixed = lambda r, t: F.col("rests") * F.col("rests") + r * F.col("tops") + t
    with_top = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda t: mixed(rest, t))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: F.least(r, rest) * F.col("rests") + F.greatest(r, rest))
    cells = F.when(F.col("top").isNull(), F.array(F.lit(0))).when(F.col("c") == F.col("top"), F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: mixed(r, top))).otherwise(F.concat(with_top, with_rest))
    return rows.join(large, by, "left").withColumn("cell", F.explode(cells)).drop("top", "tops", "rests")


def clumps(rows: DataFrame, bits: int, cell: int = 50_000) -> DataFrame:
    """(clump, s, c, leader): the nodes of a cell that lie within `bits` bits of a node of another component (column c of rows),
    over any number of steps, under a common number. Without c every node is a component, leader is the first node near to
    it, and c is null. A node is told once for each of its cells, however many others are near."""
    labelled, by = "c" in rows.columns, ["block", "part", "cell"]

    def run(batches):
        for t, bucket in whole_buckets(batches, tuple(by), 4 * cell):
            s = t.column("s").to_numpy()
            fps = np.stack([t.column(f"f{k}").to_numpy().view(np.uint64) for k in range(COMPARED)], axis=1)
            group = np.unique(t.column("c").to_numpy(), return_inverse=True)[1] if labelled else leaders(bucket, fps, bits)
            index = GrayIndex(bucket, fps, group)
            label = np.arange(len(s))
            if not labelled:
                joined(label, np.arange(len(s)), group)
            for i, j in index.pairs(bits):
                joined(label, index.order[i], index.order[j])
            many = np.bincount(label, minlength=len(s))[label] > 1
            c = pa.array(t.column("c").to_numpy()[many]) if labelled else pa.nulls(int(many.sum()), pa.int64())
            leader = s[many] if labelled else s[group][many]
            yield pa.RecordBatch.from_arrays([pa.array(s[label][many]), pa.array(s[many]), c, pa.array(leader)], names=["clump", "s", "c", "leader"])

    return in_cells(rows, cell).repartition(*by).sortWithinPartitions(*by, "s").mapInArrow(run, "clump long, s long, c long, leader long").distinct()


def links_of(sets: list[np.ndarray], over: int, of: int, wide: int = 4096) -> np.ndarray:
    """For each set the first one that it is linked with, over any number of steps. Common hashes are counted for all pairs at
    once, as a product of matrices over the hashes that more than one set has."""
    n = np.array([len(x) for x in sets])
    what = np.concatenate(sets)
    order = np.argsort(what)
    what, who = what[order], np.repeat(np.arange(len(sets), dtype=np.int32), n)[order]
    del order
    run = np.cumsum(np.r_[False, what[1:] != what[:-1]])
    often = np.bincount(run) > 1
    who, what = who[often[run]], (np.cumsum(often) - 1)[run[often[run]]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(what[-1]) + 1 if len(what) else 0, wide):
        first, end = np.searchsorted(what, (at, at + wide))
        x = np.zeros((len(sets), wide), np.float32)
        x[who[first:end], what[first:end] - at] = 1
        common += x @ x.T
    i, j = np.nonzero(np.triu((over + of) * common >= over * (n[:, None] + n[None, :]), 1))
    label = np.arange(len(sets))
    joined(label, i, j)
    return label


def verified_clumps(members: DataFrame, sets: DataFrame, over: int, of: int, cell: int, hashes: int) -> DataFrame:
    """(u, v), stored: enough links to give the components of every clump (clump, s, c). The sets of a clump meet in cells, and
    are compared there on the whole; a row is one node, never a pair. A cell holds about `hashes` hashes at most, and `cell`
    sets: a set weighs its size, and no less than their quotient."""
    by = ["block", "part", "cell"]
    sizes = sets.select(hidden("s", "s"), F.greatest("n", F.lit(max(hashes // cell, 1))).alias("w"))
    weighed = members.join(sizes, "s").select(F.lit(0).alias("block"), F.col("clump").alias("part"), "s", "c", "w")
    placed = in_cells(weighed, hashes)
    rows = placed.join(sets.select(hidden("s", "s"), "grams"), "s").select(*by, "s", "grams")

    def run(batches):
        for t, bucket in whole_buckets(batches, tuple(by), 1):
            s, grams_ = t.column("s").to_numpy(), t.column("grams").combine_chunks()
            ends, flat = grams_.offsets.to_numpy(), grams_.values.to_numpy()
            for k in np.unique(bucket):
                own = np.flatnonzero(bucket == k)
                root = links_of([flat[ends[i] : ends[i + 1]] for i in own], over, of)
                linked = root != np.arange(len(own))
                yield pa.RecordBatch.from_arrays([pa.array(s[own][linked]), pa.array(s[own][root[linked]])], names=["u", "v"])

    return stored(rows.repartition(*by).sortWithinPartitions(*by, "s").mapInArrow(run, "u long, v long").distinct(), "links")


def hidden(name: str, alias: str):
    """A long that Spark does not know its rows to be dealt by, so that a join exchanges them and can split a hot one."""
    return F.expr(f"{name} ^ 0L").alias(alias)


def sets_of(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, met: DataFrame) -> DataFrame:
    """(s, grams, n): the sets and their sizes of the nodes that met another, read again from one text of each."""
    ids = rows.join(met.select(hidden("s", "s")), "s", "left_semi").groupBy("s").agg(F.min("id").alias("of")).select("of").distinct()
    own = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    again = own.join(stored(ids, "ids"), F.col("id").eqNullSafe(F.col("of")), "left_semi")
    return stored(mapped(again, "id", "text", "grams", lambda x: x).select("s", "grams", F.size("grams").alias("n")).dropDuplicates(["s"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, over: int, of: int) -> DataFrame:
    """(u, v) of the pairs whose sets have a Jaccard similarity of at least over / of. Each set is read by the join."""
    side = lambda name: sets.select(hidden("s", name), F.col("grams").alias(f"g{name}"))
    sizes = lambda name: sets.select(hidden("s", name), F.col("n").alias(f"n{name}"))
    fit = pairs.join(sizes("u"), "u").join(sizes("v"), "v").where(of * F.least("nu", "nv") >= over * F.greatest("nu", "nv"))  # others cannot reach it
    both = stored(fit, "pairs").join(side("u"), "u").join(side("v"), "v")
    return stored(both.where((over + of) * F.size(F.array_intersect("gu", "gv")) >= over * (F.col("nu") + F.col("nv"))).select("u", "v"), "links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", over: int = 4, of: int = 5, cell: int = 50_000, sets_in_cell: int = 2000, hashes_in_cell: int = 2_000_000) -> DataFrame:
    """(id, s, root), stored: one row per row of docs; root names the component of its node."""
    width, tables = blocks(docs.count(), over, of)
    bits = reach(over, of)
    rows = stored(sketches(docs, id_col, text_col, max(COMPARED, -(-tables // (64 // width)))), "sketches")
    nodes = stored(rows.groupBy("s").agg(F.min("f").alias("f")), "nodes")
    first = stored(clumps(dealt(nodes, width, tables), bits, cell), "clumps")
    met = stored(first.select("s").distinct(), "met")
    sets = sets_of(docs, id_col, text_col, rows, met)
    links = verified(first.select(F.col("s").alias("u"), F.col("leader").alias("v")).where("u <> v").distinct(), sets, over, of)
    asked, roots = nodes.join(met.select(hidden("s", "s")), "s", "left_semi"), components(links)
    for step in ("first", "every"):
        labelled = asked.join(roots.select(hidden("node", "s"), "root"), "s", "left").select("s", "f", F.coalesce("root", "s").alias("c"))
        placed = stored(dealt(labelled, width, tables), "placed")
        mixed = placed.groupBy("block", "part").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high")
        if step == "first":  # of cells that did not meet, the first node of each component stands for it
            mixed = stored(mixed.where(F.col("n") > cell), "mixed")
            if mixed.isEmpty():
                discard(placed, mixed)
                continue
        own = placed.join(mixed.select("block", hidden("part", "part")), ["block", "part"], "left_semi")
        if step == "first":
            kept = [f"f{k}" for k in range(COMPARED)]
            own = own.groupBy("block", "part", "c").agg(F.min(F.struct("s", *kept)).alias("first")).select("block", "part", "first.s", "c", *[F.col("first")[k].alias(k) for k in kept])
        again = stored(clumps(own, bits, cell), "clumps")
        more = verified_clumps(again, sets, over, of, sets_in_cell, hashes_in_cell)
        discard(placed)
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
    return stored(rows.select("id", "s").join(roots.select(hidden("node", "s"), "root"), "s", "left").select("id", "s", F.coalesce("root", "s").alias("root")), "rooted")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", over: int = 4, of: int = 5, cell: int = 50_000, sets_in_cell: int = 2000, hashes_in_cell: int = 2_000_000) -> DataFrame:
    """docs, all columns as they are, whatever their names, without those that are linked, over any number of steps, to a
    smaller id.

    Nulls: a null text has no words, and texts without words are copies of each other; rows without an id stay and never
    drop others; rows that repeat an id stay or go together. An empty table gives no rows. Long texts are whole sets. `cell`
    bounds the fingerprints, `sets_in_cell` and `hashes_in_cell` the whole sets and their hashes that a task compares at once.
    """
    named = near_components(docs, id_col, text_col, over, of, cell, sets_in_cell, hashes_in_cell)
    least = named.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select(hidden("root", "root"), "least")
    return without(docs, stored(named.join(least, "root").where("id <> least").select("id").distinct(), "gone"), id_col)
