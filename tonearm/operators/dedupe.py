"""Keep-one deduplication, and album-level content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.catalog import ALBUM_AUDIO
from tonearm.sources.tables import written

ORDER = ("root_ord", "folder_path", "file")


def losers(tracks: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows that are not the first of their key, with the path that is kept. The best row of a key is an aggregate, so a
    key with very many rows is combined before it is exchanged; rows whose key has a null are left alone.

    The join back is on a hash of the key: it exchanges both sides, and a hot key is split."""
    known = tracks.where(" and ".join(f"`{k}` is not null" for k in key)).withColumn("path", F.concat_ws("/", "folder_path", "file"))
    best = known.groupBy(*key).agg(F.min_by("path", F.struct(*order)).alias("kept"), F.count("*").alias("n")).where("n > 1")
    best = best.select(F.to_json(F.struct(*key)).alias("__key"), "kept")
    return known.join(best, F.to_json(F.struct(*key)) == F.col("__key")).where("path <> kept").drop("__key")


def in_folder(tracks: DataFrame) -> DataFrame:
    """Copies by hash within one folder: the first file stays."""
    return losers(tracks, ["folder_path", "file_hash"], [F.col("file")])


def global_best(tracks: DataFrame) -> DataFrame:
    """Copies by hash anywhere: the higher bitrate stays, then the earlier file. Empty hashes are skipped."""
    return losers(tracks.where("file_hash <> ''"), ["file_hash"], [-F.coalesce("bitrate_bps", F.lit(0)), *map(F.col, ORDER)])


def by_fingerprint(tracks: DataFrame) -> DataFrame:
    return losers(tracks, ["audio_fingerprint"], [*map(F.col, ORDER)])


def best_per_album(tracks: DataFrame, per_title: bool = False) -> DataFrame:
    """All but the file with the highest bitrate of each album tag (of each album and title, if per_title)."""
    tagged = tracks.withColumns({"album": F.try_element_at("tags", F.lit("album")), "title": F.try_element_at("tags", F.lit("title"))})
    return losers(tagged, ["album", "title"] if per_title else ["album"], [-F.coalesce("bitrate_bps", F.lit(0)), *map(F.col, ORDER)])


def album_hashes(files: DataFrame, root: str, extensions: tuple[str, ...] = ALBUM_AUDIO) -> DataFrame:
    """(album_path, album_hash, size) of the folders right below root, each with all that lies below it: MD5 of the audio
    files' MD5s, by directory and then by name, and the bytes of all files. Files without a hash do not count; an album
    without audio has the hash of nothing."""
    root = root.rstrip("/")
    inside = files.where(F.startswith("folder_path", F.lit(f"{root}/")))
    album = F.concat(F.lit(f"{root}/"), F.substring_index(F.substring("folder_path", len(root) + 2, 2**31 - 1), "/", 1))
    audio = F.when(F.lower("ext").isin(*extensions) & F.col("file_hash").isNotNull(), F.struct("folder_path", "file", "file_hash"))
    listed = F.array_sort(F.collect_list(audio))
    return inside.groupBy(album.alias("album_path")).agg(F.md5(F.array_join(F.transform(listed, lambda x: x["file_hash"]), "")).alias("album_hash"), F.sum("size").alias("size"))


def albums_by_size(files: DataFrame, root: str, extensions: tuple[str, ...] = ALBUM_AUDIO) -> DataFrame:
    """Albums right below root with equal content: the largest stays, then the first path. Very many copies (all albums
    without audio are copies) are combined before they are exchanged."""
    albums = album_hashes(files, root, extensions)
    best = albums.groupBy("album_hash").agg(F.min_by("album_path", F.struct(-F.col("size"), "album_path")).alias("kept"))
    found = albums.join(best.select(F.concat("album_hash", F.lit("")).alias("h"), "kept"), F.col("album_hash") == F.col("h"))
    return found.where("album_path <> kept").select("album_path", "album_hash", "size", "kept")


def directory_sizes(files: DataFrame) -> DataFrame:
    """(path, size): bytes below every directory. Each file counts for all directories above it."""
    folders = files.groupBy("folder_path").agg(F.sum("size").alias("size"))
    parts = F.split("folder_path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return folders.select(F.explode(above).alias("path"), "size").groupBy("path").agg(F.sum("size").alias("size"))


def numbered(rows: DataFrame, key: str, *by: str, parts: int | None = None) -> DataFrame:
    """rows with place (from 1) among those of the same key in the order of `by`, and n_files, how many there are. Rows without a
    key are left out. A key with any number of rows is spread: rows are sorted by ranges of (key, by), numbered within a range,
    and moved on by what earlier ranges hold."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.where(F.col(key).isNotNull()).repartitionByRange(n, key, *by).withColumn("part", F.spark_partition_id()), "numbered")
    held = ranged.groupBy(key, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    placed = held.select(F.col(key).alias("k"), F.col("part").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(key)).alias("n_files"))
    own = F.row_number().over(Window.partitionBy("part", key).orderBy(*by))
    found = ranged.withColumn("own", own).join(placed, (F.col(key) == F.col("k")) & (F.col("part") == F.col("r")))
    return found.select(*rows.columns, (F.col("own") + F.col("before")).alias("place"), "n_files")


def by_album(tracks: DataFrame, parts: int | None = None) -> DataFrame:
    """(album, place, path, n_files): every file under its album tag, numbered by path; an album of any size is spread."""
    tagged = tracks.select(F.try_element_at("tags", F.lit("album")).alias("album"), F.concat_ws("/", "folder_path", "file").alias("path"))
    return numbered(tagged, "album", "path", parts=parts).select("album", "place", "path", "n_files")


def consistent(tracks: DataFrame, name: str) -> DataFrame:
    """(folder_path, one): whether a folder has exactly one value of a tag; empty ones do not count."""
    value = F.nullif(F.try_element_at("tags", F.lit(name)), F.lit(""))
    return tracks.groupBy("folder_path").agg((F.countDistinct(value) == 1).alias("one"))


def tag_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("folder_path").agg(F.sum(F.coalesce(F.size(F.map_keys("tags")), F.lit(0))).alias("n_tags"))


def mean_bitrate(tracks: DataFrame) -> DataFrame:
    """Mean over files that have a bitrate; 0 if none has."""
    return tracks.groupBy("folder_path").agg(F.coalesce(F.avg(F.nullif("bitrate_kbps", F.lit(0))), F.lit(0.0)).alias("mean_kbps"))
