"""Like names: pairs on a hot key in a grid, and an inverted index over characters that finds near names.

A name is the bag of its characters, each numbered among its equals. Two names of a and b characters that share m such
tokens have a ratio of at most 2 m / (a + b); so a ratio of `gate` takes m >= gate (a + b) / 2. With all bags sorted by how
rare a token is, names that share that many have a token in common among the first few of each (a prefix). The index leads
from tokens of prefixes to names; frequent characters hardly ever stand in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions import similarity, text
from tonearm.sources.tables import written

NAME_GATE = 0.8
#: A key with more rows than this is cut into parts.
PER_PART = 2000
#: Tasks for each core where small rows make many pairs.
TASKS_PER_CORE = 8
#: Texts that a name is shortened to, for names of one length, at most.
SHORTENINGS = 500
#: For rounding: no bound is drawn tighter than this.
SLACK = 1e-9


def tasks(df: DataFrame) -> int:
    """Tasks for work that follows pairs and not bytes: TASKS_PER_CORE for each core, at least the shuffle partitions."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def paired(a: DataFrame, b: DataFrame, key: str, own: str, theirs: str, per_part: int = PER_PART, dealt: bool = False, bundle: int = 0, rising: tuple[str, str] | None = None) -> DataFrame:
    """a joined with b on `key`. Of a key with many rows either side is cut into parts, by hashes of a's column `own` and b's
    column `theirs`, and all parts meet in a grid of cells: a row is copied once for each part of the other side, of which there
    are as many as the square root of its rows over `per_part`. dealt: cells are dealt over the tasks even where a and b are small,
    a fixed number that is not merged by their size, for work on each pair that costs more than the exchange.
    bundle: within a cell about that many rows of a, tied into one, meet a row of b at a time, so that what follows each other repeats
    few values, however large the cell; files of the result then stay small. With it, of `rising`, a column of either, a's must be the
    smaller one; bundles follow its order, so that most of those that hold no such row never meet. Columns of a and b but `key`
    differ in name."""
    counts = a.groupBy(key).agg(F.count("*").alias("rows1")).join(b.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("rows2")), F.col(key).eqNullSafe(F.col("k")))
    parts = lambda rows: F.ceil(F.sqrt(F.col(rows) / per_part)).cast("int")
    hot = counts.select("k", parts("rows1").alias("parts1"), parts("rows2").alias("parts2")).where("parts1 > 1 or parts2 > 1")

    def cut(df: DataFrame, by: str, mine: str, other: str) -> DataFrame:
        met = df.join(hot, df[key].eqNullSafe(F.col("k")), "left")
        cells = F.sequence(F.lit(0), F.coalesce(F.col(f"parts{other}"), F.lit(1)) - 1)
        placed = met.withColumns({f"cell{mine}": F.coalesce(F.pmod(F.xxhash64(by), F.col(f"parts{mine}")).cast("int"), F.lit(0)), f"cell{other}": F.explode(cells)})
        return placed.drop("k", "parts1", "parts2")

    cells = [key, "cell1", "cell2"]
    left, right = cut(a, own, "1", "2"), cut(b, theirs, "2", "1")
    if dealt:
        n = tasks(a)
        left, right = left.repartition(n, *cells), right.repartition(n, *cells).hint("merge")
    if not bundle:
        return left.join(right, cells).drop("cell1", "cell2")
    # rows of a cell are in one task already and stay there
    small, large = rising
    every = F.array_sort(F.collect_list(F.struct(*[c for c in a.columns if c != key])), lambda x, y: F.when(x[small] < y[small], -1).when(x[small] > y[small], 1).otherwise(0))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("every") - 1) / bundle).cast("int")), lambda i: F.slice("every", i * bundle + 1, bundle))
    tied = left.groupBy(*cells).agg(every.alias("every")).select(*cells, F.explode(slices).alias("tied")).withColumn("least", F.col("tied")[0][small])
    met = tied.join(right, cells).where(F.col("least") < F.col(large)).drop("cell1", "cell2", "least")
    return met.select(*[c for c in met.columns if c != "tied"], F.inline("tied")).where(F.col(small) < F.col(large))


def bags(names: DataFrame, rarity: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(s, len, bag), written, for the distinct names given (column s), the rarest tokens first; and (letter, nth, n), in how
    many of them each token is. With `rarity` the order is that of another list, in which a token that it lacks is rarest."""
    letters = names.select("s", F.explode(F.array_remove(F.split("s", ""), "")).alias("letter")).groupBy("s", "letter").agg(F.count("*").cast("int").alias("c"))
    tokens = written(letters.select("s", "letter", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("nth")), "tokens")
    if rarity is None:
        rarity = written(tokens.groupBy("letter", "nth").agg(F.count("*").alias("n")), "rarity")
    ranked = tokens.join(rarity.select(F.concat("letter", F.lit("")).alias("letter"), "nth", "n"), ["letter", "nth"], "left")
    sorted_ = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.concat("letter", F.col("nth").cast("string")).alias("t"))))
    bag = ranked.groupBy("s").agg(F.transform(sorted_, lambda x: x["t"]).alias("bag"))
    full = names.join(bag.select(F.concat("s", F.lit("")).alias("s"), "bag"), "s", "left").select("s", F.length("s").alias("len"), F.coalesce("bag", F.array().cast("array<string>")).alias("bag"))
    return written(full, "bags"), rarity


def prefix(gate: Column) -> Column:
    """As many of the rarest tokens of a name as one with a ratio of at least `gate` to it must share a token of."""
    shared = F.greatest(F.ceil(F.col("len") * gate / (2 - gate) - SLACK), F.lit(1))
    return F.slice("bag", 1, F.greatest(F.col("len") - shared + 1, F.lit(0)).cast("int"))


def candidates(own: DataFrame, others: DataFrame, gate: float) -> DataFrame:
    """(a, b): all pairs of different names that can have a ratio of at least a's column g (itself at least `gate`), and few
    others. own: s, len, bag, g; others: s, len, bag."""
    a = own.select(F.col("s").alias("a"), F.col("len").alias("len_a"), "g", F.explode(prefix(F.col("g"))).alias("t"))
    b = others.select(F.col("s").alias("b"), F.col("len").alias("len_b"), F.explode(prefix(F.lit(gate))).alias("t"))
    total = F.col("len_a") + F.col("len_b")
    met = paired(a, b, "t", "a", "b").where((F.col("a") != F.col("b")) & (2 * F.least("len_a", "len_b") >= F.col("g") * total - SLACK)).select("a", "b", "g").distinct()
    bag = lambda side, name: side.select(F.concat("s", F.lit("")).alias(name), F.col("bag").alias(f"bag_{name}"))
    both = met.join(bag(own, "a"), "a").join(bag(others, "b"), "b")
    enough = 2 * F.size(F.array_intersect("bag_a", "bag_b")) >= F.col("g") * (F.size("bag_a") + F.size("bag_b")) - SLACK
    return both.where(enough).select("a", "b")


def nearest(names: DataFrame, others: DataFrame | None = None, gates: tuple[float, ...] = (0.8, 0.6, 0.4, 0.2)) -> DataFrame:
    """(a, b, ratio): for each name the most similar other name; ties go to the first in order, then by name. names, others: one
    column name, and ord.

    The index is asked with falling thresholds: first for names that reach the highest gate; a name whose best so far stays
    under its threshold comes again with the next gate or with that best ratio, whichever is higher. In the last turn any
    common character is enough; who has none is nearest to the first other name, with 0. No turn looks at all pairs."""
    distinct = names.select(F.col("name").alias("s")).where("s is not null").distinct()
    listed = (others if others is not None else names).where("name is not null").groupBy("name").agg(F.min("ord").alias("ord"))
    listed = written(listed.select(F.col("name").alias("s"), "ord"), "others")
    known, rarity = bags(listed.select("s"))
    own = known if others is None else bags(distinct, rarity)[0]
    best_of = F.min_by(F.struct("b", "ratio"), F.struct(-F.col("ratio"), F.col("ord"), F.col("b"))).alias("m")
    left, found = own.withColumn("g", F.lit(gates[0])), None
    turns = (*gates, SLACK)
    for gate, lower in zip(turns, (*turns[1:], None), strict=True):
        close = candidates(left, known, gate)
        scored = similarity.scored(close).join(listed.select(F.concat("s", F.lit("")).alias("b"), "ord"), "b")
        best = scored.groupBy("a").agg(best_of).select(F.col("a").alias("s"), "m.b", "m.ratio")
        told = written(left.join(best, "s", "left"), "nearest")
        done = told.where(F.coalesce(F.col("ratio") >= F.col("g"), F.lit(False))).select(F.col("s").alias("a"), "b", "ratio")
        found = done if found is None else found.unionByName(done)
        left = told.where(F.coalesce(F.col("ratio") < F.col("g"), F.lit(True))).select("s", "len", "bag", F.greatest(F.lit(lower or 0.0), F.coalesce("ratio", F.lit(0.0))).alias("g"))
        if left.isEmpty():
            return found
    first = [r.s for r in listed.orderBy("ord", "s").limit(2).collect()]  # of all names the first, and the one after it
    other = F.lit(None).cast("string")
    for s in reversed(first):
        other = F.when(F.col("s") != s, F.lit(s)).otherwise(other)
    return found.unionByName(left.select(F.col("s").alias("a"), other.alias("b"), F.lit(0.0).alias("ratio")).where("b is not null"))


def sure_matches(found: DataFrame, strict: bool = True) -> DataFrame:
    """Nearest names that agree as much as their length asks for."""
    return found.withColumn("sure", F.col("ratio") >= text.required_similarity(F.col("a"), strict))


def shared(a: str, b: str, gate: float) -> Column:
    """How many characters names of lengths a and b have in common, in order, at a ratio of at least `gate`."""
    return F.greatest(F.ceil(gate * (F.col(a) + F.col(b)) / 2 - SLACK), F.lit(1)).cast("int")


def shortenings(a: str, m: Column) -> Column:
    """How many ways there are to leave m of a characters."""
    k = F.col(a) - m
    return F.when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda total, i: total * (F.col(a) - k + i) / i))


def shortened(s: str, k: str) -> Column:
    """The distinct texts that are left of s without any k characters."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    step = lambda xs: F.array_distinct(F.flatten(F.transform(xs, without)))
    return F.when(F.col(k) == 0, F.array(s)).otherwise(F.aggregate(F.sequence(F.lit(1), k), F.array(s), lambda xs, _: step(xs)))


def like_names(names: DataFrame, gate: float = NAME_GATE) -> DataFrame:
    """(a, b): ordered pairs of different names (column s, distinct) whose ratio is at least `gate`.

    The matcher pairs characters in order, so such names leave the same text when each loses the characters that it has too many.
    Pairs of lengths with at most SHORTENINGS such texts a name meet under them: who meets shares enough, whatever the alphabet. (In
    names of digits every bag holds the same few characters.) The others, long names, meet by the index."""
    sized = written(names.select("s", F.length("s").alias("len")).where("len > 0"), "sized")
    lengths = sized.select("len").distinct()
    both = lengths.select(F.col("len").alias("l1")).crossJoin(lengths.select(F.col("len").alias("l2"))).withColumn("m", shared("l1", "l2", gate)).where("m <= l1 and m <= l2")
    ways = written(both.withColumn("short", F.greatest(shortenings("l1", F.col("m")), shortenings("l2", F.col("m"))) <= SHORTENINGS), "lengths")  # a row for two lengths
    short = ways.where("short")
    side = lambda name, own: sized.join(short, F.col("len") == F.col(own)).select(F.col("s").alias(name), "l1", "l2", (F.col(own) - F.col("m")).alias("k")).select(name, "l1", "l2", F.explode(shortened(name, "k")).alias("t"))
    close = side("a", "l1").join(side("b", "l2"), ["l1", "l2", "t"]).where("a <> b").select("a", "b")
    long = ways.where(~F.col("short")).select("l1", "l2")
    if not long.isEmpty():
        own, _ = bags(sized.join(long, F.col("len") == F.col("l1"), "left_semi").select("s"))
        met = candidates(own.withColumn("g", F.lit(gate)), own, gate)
        close = close.unionByName(met.join(long, (F.length("a") == F.col("l1")) & (F.length("b") == F.col("l2")), "left_semi"))
    return similarity.scored(written(close.distinct(), "close")).where(F.col("ratio") >= gate).select("a", "b")


def similar_names(folders: DataFrame, gate: float = NAME_GATE, per_part: int = PER_PART) -> DataFrame:
    """(f1, f2, name1, name2): pairs in folder order whose lower-case names are equal or have a ratio of at least `gate`.
    folders: folder_path, folder_name, ord.

    Each distinct pair of names is scored once. Folders stay apart from names until the end: those of a pair of names meet in a
    grid, so that a name of very many folders is spread over many tasks."""
    members = folders.select("folder_path", F.lower("folder_name").alias("s"), "ord")
    names = members.groupBy("s").agg(F.count("*").alias("n")).where("s is not null")
    names = written(names, "names")
    good = like_names(names.select("s"), gate).unionByName(names.where("n > 1").select(F.col("s").alias("a"), F.col("s").alias("b")))
    parts = lambda n: F.ceil(F.sqrt(F.col(n) / per_part)).cast("int")
    size = lambda name, n: names.select(F.concat("s", F.lit("")).alias(name), F.col("n").alias(n))
    grid = good.join(size("a", "n1"), "a").join(size("b", "n2"), "b").select("a", "b", parts("n1").alias("parts1"), parts("n2").alias("parts2"))
    cells = written(grid.select("a", "b", "parts1", "parts2", F.explode(F.sequence(F.lit(0), F.col("parts1") - 1)).alias("cell1")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)).alias("cell2")), "cells")
    numbered = members.join(names.select(F.concat("s", F.lit("")).alias("s"), parts("n").alias("parts")), "s").withColumn("cell", F.pmod(F.xxhash64("folder_path"), F.col("parts")).cast("int"))
    side = lambda k, name: numbered.select(F.col("s").alias(name), F.col("cell").alias(f"cell{k}"), F.col("folder_path").alias(f"f{k}"), F.col("ord").alias(f"ord{k}"))
    met = cells.select("a", "b", "cell1", "cell2").join(side(1, "a"), ["a", "cell1"]).join(side(2, "b"), ["b", "cell2"])
    return met.where("ord1 < ord2").select("f1", "f2", F.col("a").alias("name1"), F.col("b").alias("name2"))
