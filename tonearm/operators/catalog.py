"""From files to album folders: scans, tag projection, artist resolution, the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions import text

AUDIO = (".mp3", ".flac", ".wav", ".aac", ".m4a", ".ogg")
#: Backups and album hashes look at fewer kinds.
ALBUM_AUDIO = (".mp3", ".flac", ".wav", ".m4a")
IGNORED = ("cover.jpg", "folder.jpg", "thumbs.db", "desktop.ini")
#: Fixed names of cover files, compared in lower case.
COVERS = ("cd cover.jpg", "album cover.jpg", "albumartsmall.jpg", "cover.jpg", "folder.jpg", "cover.png")
#: When covers are merged, one more name counts.
MERGE_COVERS = (*COVERS, "תמונה.jpg")


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def audio_files(files: DataFrame, extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    return files.where(F.lower("ext").isin(*extensions))


def album_folders(files: DataFrame, more_than: int = 2, ignored: tuple[str, ...] = IGNORED, roots: tuple[str, ...] = ()) -> DataFrame:
    """(folder_path, folder_name, n_files) of the folders that hold more than `more_than` audio files."""
    n = files.groupBy("folder_path", "folder_name").agg(F.count("*").alias("n_files"))
    return n.where((F.col("n_files") > more_than) & ~F.lower("folder_name").isin(*ignored) & ~F.col("folder_path").isin(*roots))


def multi_root(*scans: DataFrame) -> DataFrame:
    """All folders of several scans; one that is under two roots counts for the first."""
    both = reduce(DataFrame.unionByName, scans)
    return both.groupBy("folder_path").agg(F.min("root_ord").alias("root_ord"))


def new_folders(folders: DataFrame, catalog: DataFrame) -> DataFrame:
    """Folders whose path the catalog does not hold yet."""
    return folders.withColumn("folder_hash", F.md5("folder_path")).join(catalog.select("folder_hash"), "folder_hash", "left_anti")


def project_tags(tracks: DataFrame) -> DataFrame:
    own = [tag(c).alias(c) for c in ("title", "artist", "album", "genre")]
    return tracks.select("folder_path", "file", *own, F.expr("bitrate_bps div 1000").cast("int").alias("bitrate_kbps"))


def album_art(art: DataFrame, names: tuple[str, ...] = COVERS) -> DataFrame:
    """(folder_path, album_art): hash of the first file that is named like a cover."""
    return art.where(F.lower("file").isin(*names)).groupBy("folder_path").agg(F.min_by("art_hash", "file").alias("album_art"))


def first_tag(tracks: DataFrame, name: str) -> DataFrame:
    """(folder_path, <name>): the first non-empty value by file order, trimmed."""
    found = tracks.withColumn("v", tag(name)).where(F.coalesce("v", F.lit("")) != "")
    return found.groupBy("folder_path").agg(F.min_by(text.strip(F.col("v")), "pos").alias(name))


def resolve_artist(tracks: DataFrame, alias: DataFrame) -> DataFrame:
    """(folder_path, artist, album). The artist is the first one tagged, under its alias if it has one; without a tag,
    the alias of the parent folder. Alias tables are joined as they are: Spark sends small ones to all tasks."""
    folders = tracks.groupBy("folder_path").agg(F.first("parent_folder").alias("parent_folder"))
    tagged = folders.join(first_tag(tracks, "artist"), "folder_path", "left").join(first_tag(tracks, "album"), "folder_path", "left")
    by_tag = alias.select(F.col("key").alias("k1"), F.col("value").alias("v1"))
    by_folder = alias.select(F.col("key").alias("k2"), F.col("value").alias("v2"))
    named = tagged.join(by_tag, F.lower("artist") == F.col("k1"), "left").join(by_folder, F.lower("parent_folder") == F.col("k2"), "left")
    artist = F.when(F.col("artist").isNotNull(), F.coalesce("v1", "artist")).otherwise(F.col("v2"))
    return named.select("folder_path", artist.alias("artist"), "album")


def resolve_artist_album(tracks: DataFrame, alias: DataFrame) -> DataFrame:
    """The second rule: the folder's name is an alias (album is the parent), else the parent's is (album is the folder),
    else the first file that has the tag at all, be it empty."""
    def first_of(name):
        return F.min_by(tag(name), F.when(F.map_contains_key("tags", name), F.col("pos"))).alias(name)

    folders = tracks.groupBy("folder_path").agg(F.first("folder_name").alias("folder_name"), F.first("parent_folder").alias("parent_folder"), first_of("artist"), first_of("album"))
    own = alias.select(F.col("key").alias("k1"), F.col("value").alias("v1"))
    above = alias.select(F.col("key").alias("k2"), F.col("value").alias("v2"))
    named = folders.join(own, F.col("folder_name") == F.col("k1"), "left").join(above, F.col("parent_folder") == F.col("k2"), "left")
    return named.select(
        "folder_path", F.coalesce("v1", "v2", "artist").alias("artist"),
        F.when(F.col("v1").isNotNull(), F.col("parent_folder")).when(F.col("v2").isNotNull(), F.col("folder_name")).otherwise(F.col("album")).alias("album"),
    )


def catalog(tracks: DataFrame, art: DataFrame, alias: DataFrame, more_than: int = 2) -> DataFrame:
    """One row per album folder: hash of its path, names, artist, album, cover, files in order."""
    files = F.array_sort(F.collect_list(F.struct("pos", "file", "file_hash"))).alias("files")
    folders = tracks.groupBy("folder_path", "folder_name", "parent_folder").agg(F.count("*").alias("n_files"), files).where(F.col("n_files") > more_than)
    full = folders.join(resolve_artist(tracks, alias), "folder_path", "left").join(album_art(art), "folder_path", "left")
    return full.withColumn("folder_hash", F.md5("folder_path"))


def listing(dirs: DataFrame, parent: str) -> DataFrame:
    """Names of the directories right below `parent`."""
    return dirs.where(F.col("parent_path") == parent).select("name")


def below(root: str) -> Column:
    """Whether folder_path is root or lies somewhere below it."""
    root = root.rstrip("/")
    return (F.col("folder_path") == root) | F.startswith("folder_path", F.lit(f"{root}/"))


def backup_plan(tracks: DataFrame, root: str, backup: str, extensions: tuple[str, ...] = ALBUM_AUDIO) -> DataFrame:
    """Copy every audio file in or below root to the same relative place below backup."""
    root, backup = root.rstrip("/"), backup.rstrip("/")
    src = F.concat_ws("/", "folder_path", "file")
    inside = audio_files(tracks, extensions).where(below(root))
    return inside.select(F.lit("copy").alias("action"), src.alias("src"), F.concat(F.lit(backup), F.substring(src, len(root) + 1, 2**31 - 1)).alias("dst"))


def empty_folders(dirs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Directories, but the root, with no file of any kind anywhere below them."""
    parts = F.split("folder_path", "/")
    above = files.select("folder_path").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    return dirs.where(F.col("path") != root).join(above, "path", "left_anti").select(F.lit("rmdir").alias("action"), F.col("path").alias("src"))


def specific_folders(files: DataFrame) -> DataFrame:
    """Folders worth a look: their names differ by more than digits, and none says `track` or its Hebrew word."""
    name = text.strip_digits(F.col("file"))
    generic = F.lower("file").contains("track") | F.col("file").contains(text.TRACK_WORD)
    seen = files.groupBy("folder_path").agg(F.min(name).alias("a"), F.max(name).alias("b"), F.bool_or(generic).alias("generic"), F.count("*").alias("n_files"))
    return seen.where((F.col("a") != F.col("b")) & ~F.col("generic")).select("folder_path", "n_files")


def listing_classes(files: DataFrame) -> DataFrame:
    """(path, class_path, n_folders): folders of the same name with the same files are a class, named by its smallest path. One
    row per folder, however many a class has; a large class is combined before it is exchanged."""
    folders = files.groupBy("folder_path", "folder_name").agg(F.array_sort(F.collect_list("file")).alias("files"))
    keyed = folders.select(F.col("folder_path").alias("path"), F.sha2(F.to_json(F.struct("folder_name", "files")), 256).alias("listing"))
    classes = keyed.groupBy("listing").agg(F.min("path").alias("class_path"), F.count("*").alias("n_folders"))
    # exchanged again, so that a large class can be split
    return keyed.join(classes.select(F.concat("listing", F.lit("")).alias("l"), "class_path", "n_folders"), F.col("listing") == F.col("l")).select("path", "class_path", "n_folders")


def same_listing(files: DataFrame) -> DataFrame:
    """(path, other): folders of the same name with the same files, both ways round: the classes, with all pairs told. Members of a
    large class meet in a grid."""
    from tonearm.operators.names import paired

    shared = listing_classes(files).where("n_folders > 1").select("path", "class_path")
    return paired(shared, shared.select(F.col("path").alias("other"), "class_path"), "class_path", "path", "other").where("path <> other").select("path", "other")
