"""Comparing folders: candidate pairs, position-wise similarity, the weighted score, ranks and reports.

Folders are compared only with folders of as many files. Every string term has an exact upper bound, so a pair whose
bounded score stays under the threshold never reaches the ratio; the strings of what is left are scored where the pair met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions import similarity, text
from tonearm.operators.catalog import tag
from tonearm.operators.names import NAME_GATE, SLACK, paired, similar_names, tasks
from tonearm.sources.tables import written

#: Fixed weights of the score.
WEIGHTS = {"file_hash": 5.0, "file": 3.0, "title": 2.5, "album": 2.5, "artist": 1.5, "folder_name": 1.5, "album_art": 1.0}
EXTRA_WEIGHT, GENERIC, REDUCTION = 0.5, 0.7, 0.5
MINIMAL, MERGE_FROM = 30.0, 85.0
#: Tags that are compared on their own, not as extra tags.
MAIN_TAGS = ("artist", "album", "title", "bitrate")


def readable(tracks: DataFrame, more_than: int = 2) -> DataFrame:
    """The files of album folders whose tags could be read, numbered anew, with repaired artist, album and title; n files
    and ord, the folder's place, repeat on each row."""
    from pyspark.sql import Window

    listed = tracks.groupBy("folder_path").agg(F.count("*").alias("n_listed")).where(F.col("n_listed") > more_than)
    rows = tracks.where("tags is not null").join(listed, "folder_path")
    own = Window.partitionBy("folder_path")
    return rows.select(
        F.struct("root_ord", "folder_path").alias("ord"), "folder_path", "folder_name", "file", F.row_number().over(own.orderBy("file")).alias("pos"), F.count("*").over(own).cast("int").alias("n"),
        *[text.fix_mojibake(tag(f)).alias(f) for f in ("artist", "album", "title")], "file_hash", "tags",
    )


#: Folders of one count that a cell of the grid holds at most are about this many on either side.
PAIRS_PER_CELL = 400
#: Folders that meet at a time within a cell: few enough that their names stay within what a file's compression looks back on.
BUNDLE = 64


def numbered_values(files: DataFrame, column: str) -> DataFrame:
    """files with numbers in place of a column's values, the same ones for the same values; what is missing stays so. Numbers are
    compared faster than values, and rows where folders meet stay short."""
    values = files.select(F.col(column).alias("value")).where("value is not null").distinct()
    numbers = written(values.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return files.join(numbers, files[column] == numbers["value"], "left").withColumn(column, F.col("number")).drop("value", "number")


def same_count(files: DataFrame, *kept: str, facts: DataFrame | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """(f1, f2, n): pairs of folders with equally many files, each once, in folder order. `kept` columns of the files come along as
    arrays in the order of pos, columns of `facts` (a row for each folder_path) as they are, and what is `made` of both once a
    folder, with 1 and 2 at their end.

    A folder is one row, written once; rows meet in a grid of cells, and within a cell BUNDLE of one side at a time. What is asked of
    positions or facts is asked within the row where two folders meet, so that neither pairs nor positions are exchanged."""
    told = F.array_sort(F.collect_list(F.struct("pos", *kept)), lambda x, y: x["pos"] - y["pos"])  # by place alone: maps have no order
    folders = files.groupBy("folder_path").agg(F.first("ord").alias("ord"), F.count("*").cast("int").alias("n"), *([told.alias("files")] if kept else []))
    folders = folders.select("folder_path", "ord", "n", *[F.col(f"files.{c}").alias(c) for c in kept])
    if facts is not None:
        folders = folders.join(facts, "folder_path", "left")
    # places in folder order, which are shorter and compared faster
    folders = folders.withColumns(made or {}).orderBy("ord").withColumn("place", F.monotonically_increasing_id())
    folders = written(folders.drop("ord"), "counted")
    more = [c for c in folders.columns if c not in ("folder_path", "n")]
    side = lambda k: folders.select("n", F.col("folder_path").alias(f"f{k}"), *[F.col(c).alias(f"{c}{k}") for c in more])
    return paired(side(1), side(2), "n", "f1", "f2", per_part=PAIRS_PER_CELL, dealt=True, bundle=BUNDLE, rising=("place1", "place2")).drop("place1", "place2")


def positions(met: DataFrame, *kept: str) -> DataFrame:
    """One row per pair and position from 1 on, the `kept` arrays' entries of both sides with 1 and 2 at their end. A folder has at
    least one file; `outer` spares the filter on empty arrays, which would make them twice."""
    names = [f"{c}{k}" for c in kept for k in (1, 2)]
    rows = met.select("f1", "f2", F.posexplode_outer(F.arrays_zip(*names)).alias("at", "e"))
    return rows.select("f1", "f2", (F.col("at") + 1).alias("pos"), *[F.col(f"e.{c}").alias(c) for c in names])


def equal_share(a: str, b: str) -> Column:
    """Share of places where two arrays of equal length hold the same; two missing ones are equal."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda total, x: total + x) / F.size(a)


#: Numbers of 64 bits that hold the marks of a folder.
MARKS = 4


def marks(values: Column, placed: bool = True) -> dict[str, Column]:
    """mark0, mark1, ...: a bit for what an array holds at each place, told once a folder. Folders that have no bit in common hold
    the same at no place. placed: else at any two places."""
    hashes = F.transform(values, (lambda x, i: F.xxhash64(x, i)) if placed else (lambda x: F.xxhash64(x)))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    own = lambda k: lambda total, h: total.bitwiseOR(F.when(F.shiftrightunsigned(h, 6) % MARKS == k, bit(h)).otherwise(F.lit(0).cast("long")))
    return {f"mark{k}": F.aggregate(hashes, F.lit(0).cast("long"), own(k)) for k in range(MARKS)}


def apart() -> Column:
    """Whether the marks say that two folders hold the same at no place."""
    return reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"mark{k}1").bitwiseAND(F.col(f"mark{k}2")) for k in range(MARKS)]) == 0


def unless_apart(met: DataFrame, share: Column) -> Column:
    """A share of equal positions, looked at only where the folders' marks meet, if met has marks."""
    return F.when(apart(), 0.0).otherwise(share) if "mark01" in met.columns else share


def hash_fraction(met: DataFrame) -> DataFrame:
    """(f1, f2, n, file_hash): share of positions with equal hashes; two missing ones are equal. met: pairs with file_hash, and `marks`
    of it if these are told."""
    return met.select("f1", "f2", "n", unless_apart(met, equal_share("file_hash1", "file_hash2")).alias("file_hash"))


def further_keys(tags: Column) -> Column:
    """Tags that are not compared on their own, in order."""
    return F.sort_array(F.array_except(F.map_keys(tags), F.array(*map(F.lit, MAIN_TAGS))))


def common_keys(keys1: Column, keys2: Column) -> Column:
    """Further tags that both files have, in the order of the first one's."""
    return F.array_intersect(keys1, keys2)


def listed_keys(keys: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]"))


def common_keys_told(met: DataFrame) -> DataFrame:
    """(f1, f2, pos, keys): the further tags, as a list in one text, that both files have at each position. met: pairs with `keys`
    (`further_keys`) and `told` (`listed_keys` of these) of their files. Lists are told once a file; only where two folders differ
    in their keys are they looked at again."""
    other = F.zip_with("keys1", "keys2", lambda x, y: listed_keys(common_keys(x, y)))
    texts = met.select("f1", "f2", F.when(F.col("keys1") == F.col("keys2"), F.col("told1")).otherwise(other).alias("texts"))
    return texts.select("f1", "f2", F.posexplode_outer("texts").alias("at", "keys")).select("f1", "f2", (F.col("at") + 1).alias("pos"), "keys")


def further(tags: Column, pos: Column) -> Column:
    """Further tags that are not empty, each as one text of its place, its key's length, key and value in lower case: texts
    are compared many times faster than structs."""
    own = F.filter(F.map_entries(tags), lambda e: ~e["key"].isin(*MAIN_TAGS) & (e["value"] != ""))
    return F.transform(own, lambda e: F.concat(pos.cast("string"), F.lit(":"), F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lower(e["value"])))


def shared_keys(a: Column, b: Column) -> Column:
    """Keys of the `further` tags that two folders share at a place with their values, one for each place."""
    key = lambda x: F.substring(x, F.length(F.substring_index(x, ":", 2)) + 2, F.split_part(x, F.lit(":"), F.lit(2)).cast("int"))
    return F.transform(F.array_intersect(a, b), key)


def shared_counts(a: Column, b: Column) -> Column:
    """Of the keys of `shared_keys`: total, how many; distinct, how many different; scores, each with its count, in order."""
    count = lambda keys: lambda k: F.struct(k.alias("key"), F.size(F.filter(keys, lambda x: x == k)).alias("count"))
    told = lambda keys: F.struct(F.size(keys).alias("total"), F.size(F.array_distinct(keys)).alias("distinct"), F.transform(F.array_sort(F.array_distinct(keys)), count(keys)).alias("scores"))
    return F.transform(F.array(shared_keys(a, b)), told)[0]


def key_scores(a: Column, b: Column, n: Column, digits: int | None = None) -> Column:
    """(key, score) of the keys of `shared_keys`, in order; scores to that many digits."""
    score = lambda x: x if digits is None else F.round(x, digits)
    return F.transform(shared_counts(a, b)["scores"], lambda k: F.struct(k["key"].alias("key"), score(k["count"] / n).alias("score")))


def extra_tags(met: DataFrame, digits: int | None = None) -> DataFrame:
    """(f1, f2, key, score): share of positions where a further tag is there on both sides, not empty, and equal in any case. met:
    pairs with `further` of their files as one array, and `own`, the `key_scores` of each folder with itself, which holds for all folders
    with the same further tags."""
    scores = F.when(F.col("further1") == F.col("further2"), F.col("own1")).otherwise(key_scores(F.col("further1"), F.col("further2"), F.col("n"), digits))
    return met.select("f1", "f2", F.inline(scores))


def generic_scores(names: DataFrame) -> DataFrame:
    """(folder_path, score): mean ratio over all pairs of names in a folder, numbers and extensions left out; under two
    names 0. names: folder_path, pos, name.

    Only the distinct names of a folder are paired, each with the places of its files. How often one name stands before
    another follows from the order of both names' places together: the sum of the second one's ranks there, less its ranks
    among its own. So n files with d names make d * d rows. A folder of very many names is cut in a grid; pairs are scored where
    they meet, each distinct one once a batch."""
    plain = names.select("folder_path", F.col("pos").cast("long").alias("pos"), text.strip_digits(text.stem(F.col("name"))).alias("s"))
    own = plain.groupBy("folder_path", "s").agg(F.count("*").alias("c"), F.collect_list("pos").alias("places"))
    alike = own.groupBy("folder_path").agg(F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1) div 2")).alias("same"))
    a = own.select("folder_path", F.col("s").alias("a"), F.transform("places", lambda x: 2 * x).alias("first"))
    b = own.select("folder_path", F.col("s").alias("b"), F.transform("places", lambda x: 2 * x + 1).alias("second"))
    both = F.transform(F.array_sort(F.concat("first", "second")), lambda x, i: F.when(x % 2 == 1, i).otherwise(0).cast("long"))
    before = F.aggregate(both, F.lit(0).cast("long"), lambda total, x: total + x) - F.expr("size(second) * (size(second) - 1L) div 2")
    pairs = paired(a, b, "folder_path", "a", "b", dealt=True).where("a <> b").select("folder_path", "a", "b", before.alias("c")).where("c > 0")
    scored = pairs.select("folder_path", "c", similarity.ratio_sum(F.array("a"), F.array("b")).alias("ratio"))
    sums = scored.groupBy("folder_path").agg(F.sum(F.col("c") * F.col("ratio")).alias("unlike"))
    score = (F.coalesce("unlike", F.lit(0.0)) + F.col("same")) / F.expr("n * (n - 1) div 2")
    return alike.join(sums, "folder_path", "left").select("folder_path", F.when(F.col("n") > 1, score).otherwise(0.0).alias("score"))


def profiles(tracks: DataFrame, art: DataFrame, more_than: int = 2, with_files: bool = False) -> DataFrame:
    """(folder_path, n_files, file_similarity, title_similarity, album_art), and `files` if asked for: those that can be read,
    in order, with repaired artist, album and title, bitrate, tags, hash and extension. All listed files count for the
    names; titles only of files that can be read and have one."""
    from tonearm.operators.catalog import album_art

    listed = tracks.groupBy("folder_path").agg(F.count("*").alias("n_listed"), F.count("tags").alias("n_files")).where(F.col("n_listed") > more_than)
    own = tracks.join(listed.select("folder_path"), "folder_path", "left_semi")
    by_file = generic_scores(own.select("folder_path", "pos", F.col("file").alias("name"))).withColumnRenamed("score", "file_similarity")
    titled = own.withColumn("name", text.fix_mojibake(tag("title"))).where(text.present(F.col("name")).isNotNull())
    by_title = generic_scores(titled.select("folder_path", "pos", "name")).withColumnRenamed("score", "title_similarity")
    full = listed.join(by_file, "folder_path", "left").join(by_title, "folder_path", "left").join(album_art(art), "folder_path", "left")
    fields = [F.coalesce("file_similarity", F.lit(0.0)).alias("file_similarity"), F.coalesce("title_similarity", F.lit(0.0)).alias("title_similarity"), "album_art"]
    if with_files:
        told = F.struct("pos", "file", *[text.fix_mojibake(tag(f)).alias(f) for f in ("artist", "album", "title")], F.col("bitrate_kbps").alias("bitrate"), F.col("tags").alias("metadata"), "file_hash", F.lower("ext").alias("extension"))
        # rows of one folder; ordered by place alone, since tags are maps
        in_order = F.array_sort(F.collect_list(told), lambda a, b: a["pos"] - b["pos"])
        files = tracks.where("tags is not null").groupBy("folder_path").agg(in_order.alias("files"))
        full = full.join(files, "folder_path", "left")
        fields.append(F.coalesce("files", F.array().cast(files.schema["files"].dataType)).alias("files"))
    return full.select("folder_path", "n_files", *fields)


def adjustment(a: Column, b: Column) -> Column:
    """Names that are much alike within a folder say less about another folder."""
    most = F.greatest(a, b)
    return F.when(most > GENERIC, 1 - most * REDUCTION).otherwise(F.lit(1.0))


def _weighted(terms: dict[str, Column], extra_sum: Column, extra_n: Column) -> Column:
    total = reduce(lambda x, y: x + y, [terms[k] * w for k, w in WEIGHTS.items()])
    return 100 * (total + EXTRA_WEIGHT * extra_sum) / (sum(WEIGHTS.values()) + EXTRA_WEIGHT * extra_n)


#: Folders of one count that a cell of the grid holds are about the square root of their number times this.
PAIRS_PER_PART = 50


def folder_rows(tracks: DataFrame, more_than: int = 2) -> DataFrame:
    """One row per album folder: n, ord, folder_name, and arrays with an entry for each readable file, in order: file, title,
    album and artist in lower case (empty where there is none), their lengths (l_file, ...), file_hash, and the further tags."""
    fields = ("file", "title", "album", "artist")
    files = readable(tracks, more_than).withColumns({c: F.coalesce(F.lower(c), F.lit("")) for c in fields})
    told = F.struct("pos", *fields, "file_hash", further(F.col("tags"), F.col("pos")).alias("further"))
    rows = files.groupBy("folder_path").agg(F.first("ord").alias("ord"), F.count("*").cast("int").alias("n"), F.first("folder_name").alias("folder_name"), F.array_sort(F.collect_list(told)).alias("files"))
    rows = rows.select("folder_path", "ord", "n", "folder_name", *[F.col(f"files.{c}").alias(c) for c in (*fields, "file_hash", "further")])
    return rows.withColumn("further", F.flatten("further"))


def least_equal(keys: Column, n: Column, at_least: float) -> Column:
    """At how many of n positions hashes must be equal in a pair that scores `at_least`, all else being 1 and `keys` further tags in
    common: further tags in common raise the score, so this falls with keys; 0 or less where hashes do not matter."""
    rest = sum(WEIGHTS.values()) - WEIGHTS["file_hash"]
    share = (at_least / 100 * sum(WEIGHTS.values()) - rest - EXTRA_WEIGHT * (1 - at_least / 100) * keys) / WEIGHTS["file_hash"]
    return F.least(F.ceil(share * n - SLACK), n.cast("long"))


def sharing(folders: DataFrame, at_least: float) -> DataFrame:
    """(f1, f2): pairs of folders of equally many files, in folder order, that can score `at_least` by the hashes they share.

    Who needs m of n equal hashes has one of them among any n - m + 1 of its own. Folders meet under the rarest ones, so a hash that
    many folders have at a place hardly ever leads to a pair. A folder has at most as many further tags in common as it has; those with
    so many that hashes do not matter meet each other in a grid, and the rest under all their hashes."""
    keys = F.size(F.array_distinct(shared_keys(F.col("further"), F.col("further"))))
    rows = written(folders.select("folder_path", "ord", "n", "file_hash", least_equal(keys, F.col("n"), at_least).alias("m")), "hashed")
    tokens = rows.select("folder_path", "n", "m", F.posexplode("file_hash").alias("at", "h")).select("folder_path", "n", "m", F.xxhash64("n", "at", "h").alias("t"))
    counts = tokens.groupBy("t").agg(F.count("*").alias("c")).select(F.expr("t ^ 0L").alias("t"), "c")
    rare = tokens.join(counts, "t").groupBy("folder_path").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("own"), F.first("n").alias("n"), F.first("m").alias("m"))
    first = rare.select("folder_path", "n", F.explode(F.slice("own", F.lit(1), (F.col("n") - F.greatest("m", F.lit(1)) + 1).cast("int"))).alias("e")).select("folder_path", "n", "e.t")
    first = written(first.join(rows.select(F.concat("folder_path", F.lit("")).alias("folder_path"), "ord"), "folder_path"), "prefixes")
    side = lambda df, k: df.select(*[F.col(c).alias(f"{c}{k}" if c != "t" else c) for c in df.columns]).withColumnRenamed(f"folder_path{k}", f"f{k}")
    met = paired(side(first, 1), side(first, 2), "t", "f1", "f2").where("n1 = n2 and ord1 < ord2").select("f1", "f2")
    free = rows.where("m <= 0").select("folder_path", "ord", F.col("n").alias("t"))
    if not free.isEmpty():
        met = met.unionByName(paired(side(free, 1), side(free, 2), "t", "f1", "f2").where("ord1 < ord2").select("f1", "f2"))
    return met.distinct()


def json_text(s: Column) -> Column:
    """A text as JSON has it."""
    quoted = F.to_json(F.array(s))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def similar_pairs(tracks: DataFrame, art: DataFrame, at_least: float = MINIMAL, more_than: int = 2, info: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """The similarity record of every pair of folders that scores at least `at_least` (0: of every pair): f1, f2, n,
    identical, the seven terms, additional_metadata (map), weighted_score. Identical pairs have 100 and no terms. Columns of `facts` (a row for each
    folder_path) come along with 1 and 2 at their end.

    A folder is one row with its files in arrays, written once. Rows of equally many files meet in a grid of cells; there the
    positions are compared within the row: hashes if the folders' marks meet, further tags unless they are the same. Strings are
    scored in the same task, field by field, until a pair cannot reach the threshold any more. Neither pairs nor
    positions are exchanged. If the threshold is not to be reached without equal hashes, only folders that share enough of them meet:
    then these pairs are exchanged, and no others are looked at."""
    info = written(profiles(tracks, art, more_than), "profiles") if info is None else info
    fields = ("file", "title", "album", "artist")
    known = info.select("folder_path", "file_similarity", "title_similarity", "album_art")
    rows = folder_rows(tracks, more_than).join(known, "folder_path")
    texts = [F.array_join(F.transform(c, json_text), ",") for c in (*fields, F.array(F.coalesce(F.lower("folder_name"), F.lit(""))))]
    rows = rows.withColumns({"texts": F.concat(F.lit("[["), F.concat_ws("],[", *texts), F.lit("]]")), "own": shared_counts(F.col("further"), F.col("further")), **marks(F.col("file_hash"))}).drop(*fields)
    folders = written(rows if facts is None else rows.join(facts, "folder_path", "left"), "folders")
    more = [] if facts is None else [f"{c}{k}" for k in (1, 2) for c in facts.columns if c != "folder_path"]
    side = lambda k: folders.select("n", F.col("folder_path").alias(f"f{k}"), *[F.col(c).alias(f"{c}{k}") for c in folders.columns if c not in ("n", "folder_path")])
    if at_least / 100 * sum(WEIGHTS.values()) > sum(WEIGHTS.values()) - WEIGHTS["file_hash"]:
        pairs = sharing(folders, at_least).join(side(1), "f1").join(side(2).drop("n"), "f2").repartition(tasks(folders), "f1", "f2")
    else:
        pairs = paired(side(1), side(2), "n", "f1", "f2", per_part=PAIRS_PER_PART, dealt=True).where("ord1 < ord2")

    # told by a generator, so that a filter above does not find them again in the join's condition
    counts = F.when(F.col("further1") == F.col("further2"), F.col("own1")).otherwise(shared_counts(F.col("further1"), F.col("further2")))
    found = F.struct(F.when(apart(), 0.0).otherwise(equal_share("file_hash1", "file_hash2")).alias("file_hash"), counts.alias("keys"))
    pairs = pairs.select("*", F.inline(F.array(found))).withColumns({
        "album_art": F.when(F.col("album_art1") == F.col("album_art2"), 1.0).otherwise(0.0),
        "adjust_file": adjustment(F.col("file_similarity1"), F.col("file_similarity2")), "adjust_title": adjustment(F.col("title_similarity1"), F.col("title_similarity2")),
        "x": F.col("keys.total") / F.col("n"), "xn": F.col("keys.distinct"),
    })
    same, name1, name2 = F.col("file_hash") == 1.0, F.lower("folder_name1"), F.lower("folder_name2")
    unnamed = F.coalesce((name1 == "") & (name2 == ""), F.lit(False))
    weights, least = F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    if at_least > 0:
        weights = F.array(*[F.lit(WEIGHTS[c]) / F.col("n") * by for c, by in zip(fields, (F.col("adjust_file"), F.col("adjust_title"), 1.0, 1.0), strict=True)], F.lit(WEIGHTS["folder_name"]))
        rest = F.col("file_hash") * WEIGHTS["file_hash"] + F.col("album_art") * WEIGHTS["album_art"] + F.col("x") * EXTRA_WEIGHT + F.when(unnamed, WEIGHTS["folder_name"]).otherwise(0.0)
        least = (F.col("xn") * EXTRA_WEIGHT + sum(WEIGHTS.values())) * (at_least / 100) - rest - SLACK
    asked = pairs.withColumn("ratios", similarity.ratio_sums(F.when(~same, F.col("texts1")), F.when(~same, F.col("texts2")), weights, least))
    scored = asked.withColumns({**{c: F.col("ratios")[i] / F.col("n") for i, c in enumerate(fields)}, "folder_name": F.col("ratios")[len(fields)]}).withColumns({
        "file": F.col("file") * F.col("adjust_file"), "title": F.col("title") * F.col("adjust_title"),
        "folder_name": F.when(~same & unnamed, 1.0).otherwise(F.col("folder_name")), "album_art": F.when(~same, F.col("album_art")),
    })
    score = lambda k: F.struct(k["key"].alias("key"), (k["count"] / F.col("n")).alias("score"))
    full = scored.withColumns({
        "identical": same, "additional_metadata": F.when(~same, F.map_from_entries(F.transform("keys.scores", score))),
        "weighted_score": F.when(same, 100.0).otherwise(_weighted({k: F.col(k) for k in WEIGHTS}, F.col("x"), F.col("xn"))),
    })
    return full.where(F.col("weighted_score") >= at_least).select("f1", "f2", "n", "identical", *WEIGHTS, "additional_metadata", "weighted_score", *more)


def ranked(pairs: DataFrame, at_least: float = MINIMAL) -> DataFrame:
    """Written before they are ordered: an order by ranges reads its rows twice, once for the ranges."""
    return written(pairs.where(F.col("weighted_score") >= at_least), "scored").orderBy(F.desc("weighted_score"), "f1", "f2")


def two_digits(x: Column) -> Column:
    """As format_number tells it; 0 and 1, which many scores are, do not go through it."""
    return F.when(x == 0, "0.00").when(x == 1, "1.00").otherwise(F.format_number(x, 2))


def report(pairs: DataFrame) -> DataFrame:
    """(f1, f2, field, value): every score of a pair, the total to two decimals."""
    entry = lambda k, x: F.struct(k.alias("field"), x.alias("value"))
    fixed = F.array(*[entry(F.lit(k), two_digits(F.col(k))) for k in (*WEIGHTS, "weighted_score")])
    extra = F.transform(F.map_entries("additional_metadata"), lambda e: entry(F.concat(F.lit("tag "), e["key"]), two_digits(e["value"])))
    rows = pairs.select("f1", "f2", F.inline(F.concat(fixed, F.coalesce(extra, F.array().cast("array<struct<field:string,value:string>>")))))
    return rows.where("value is not null")


def tag_entries(tags: Column) -> Column:
    """All tags as sorted entries, which can be compared; null if they cannot be read."""
    return F.array_sort(F.map_entries(tags))


def tag_equality(met: DataFrame) -> DataFrame:
    """met (pairs with `entries` of their files, or numbers of these, and their `marks` if these are told) with score: share of
    positions, up to the shorter folder, whose tags are all the same."""
    alike = F.size(F.filter(F.zip_with("entries1", "entries2", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return met.withColumn("score", unless_apart(met, alike / F.least(F.size("entries1"), F.size("entries2"))))


def compare(tracks: DataFrame, art: DataFrame, alias: DataFrame, gate: float = NAME_GATE, at_least: float = 0.8) -> DataFrame:
    """(f1, f2, score): the second comparison, a mean of equal terms over pairs of like names, kept from `at_least` on."""
    from tonearm.operators.catalog import album_art, resolve_artist_album

    lists = tracks.groupBy("folder_path", "folder_name").agg(F.struct(F.min("root_ord"), F.col("folder_path")).alias("ord"), F.count("*").alias("n"), F.array_sort(F.collect_list(text.letters_only(F.col("file")))).alias("names"), F.transform(F.array_sort(F.collect_list(F.struct("pos", tag_entries(F.col("tags")).alias("entries")))), lambda x: x["entries"]).alias("entries"))
    info = lists.join(resolve_artist_album(tracks, alias), "folder_path", "left").join(album_art(art), "folder_path", "left")
    pairs = similar_names(lists.select("folder_path", "folder_name", "ord"), gate).select("f1", "f2")
    side = lambda k: info.select(F.col("folder_path").alias(f"f{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "names", "entries", "artist", "album", "album_art")])
    full = pairs.join(side(1), "f1").join(side(2), "f2")
    apart = ~F.arrays_overlap("names1", "names2")  # most: 0, and never matched
    listed = similarity.list_ratio(F.when(~apart, F.col("names1")), F.when(~apart, F.col("names2")))
    full = tag_equality(full).withColumn("ratio", F.when(F.size("names1") + F.size("names2") == 0, 1.0).otherwise(F.coalesce(listed, F.lit(0.0))))
    score, total = (F.col("n1") == F.col("n2")).cast("int") + F.col("ratio") + F.coalesce("score", F.lit(0.0)), F.lit(3)
    for c, low in (("album_art", False), ("artist", True), ("album", True)):
        a, b = text.present(F.col(f"{c}1")), text.present(F.col(f"{c}2"))
        there = a.isNotNull() & b.isNotNull()
        score = score + (there & ((F.lower(a) == F.lower(b)) if low else (a == b))).cast("int")
        total = total + there.cast("int")
    return full.select("f1", "f2", (score / total).alias("s")).where(F.col("s") >= at_least).select("f1", "f2", F.round("s", 2).alias("score"))
