"""The library tables as views over the given tables, in Spark and as SQL for the check.

Albums: a conversation is a folder, a turn is a file; every tenth conversation has an exact copy under a second root and
the next tenth a near copy. Documents: a source is a folder, a document is a text file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("nation"))
    copy = talks.where("conv_id % 10 in (0, 1)").withColumn("text", F.when(F.col("conv_id") % 10 == 1, F.concat("text", F.lit("~"))).otherwise(F.col("text")))
    both = talks.withColumns({"root_ord": F.lit(0), "root": F.lit("/lib")}).unionByName(copy.withColumns({"root_ord": F.lit(1), "root": F.lit("/copy")}))
    return both.join(nation, F.col("conv_id") % 25 == F.col("n_nationkey"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    size = F.length("text")
    kind = F.col("conv_id") % 3
    name = F.concat(F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.lit(" "), F.regexp_replace(F.left("text", F.lit(24)), "[/\n]", " "), F.when(kind == 0, ".mp3").when(kind == 1, ".flac").otherwise(".MP3"))
    tags = F.map_filter(
        F.create_map(
            F.lit("title"), F.left("text", F.lit(40)), F.lit("artist"), F.when(kind > 0, F.col("role")), F.lit("album"), F.concat(F.lit("album "), (F.col("conv_id") % 10).cast("string")),
            F.lit("genre"), F.when(F.col("turn") % 4 == 0, "Promo mix").otherwise("pop"), F.lit("lyrics"), F.when(F.col("turn") % 2 == 0, "la"),
        ),
        lambda k, v: v.isNotNull(),
    )
    rows = s.select(
        "root_ord", F.concat_ws("/", "root", "nation", F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("folder_path"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("folder_name"),
        F.col("nation").alias("parent_folder"), name.alias("file"), size.cast("long").alias("size"),
        F.element_at(F.array(*map(F.lit, (96000, 128000, 192000, 320000, 1411000))), 1 + size % 5).cast("long").alias("bitrate_bps"),
        F.when((F.col("conv_id") % 17 == 5) & (F.col("turn") == 2), None).otherwise(tags).alias("tags"), F.md5("text").alias("file_hash"), F.md5(F.lower("text")).alias("audio_fingerprint"),
        ((F.col("turn") % 3 == 0) & (F.col("conv_id") % 4 != 3)).alias("has_embedded_art"),
    )
    pos = F.row_number().over(Window.partitionBy("folder_path").orderBy("file"))
    return rows.withColumns({"ext": text.extension(F.col("file")), "pos": pos, "bitrate_kbps": F.expr("bitrate_bps div 1000").cast("int")})


def art(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir).where("turn in (0, 1)")
    kind = F.col("conv_id") % 4
    name = F.when(kind == 0, "cover.jpg").when(kind == 1, "Folder.JPG").otherwise("back.png")
    folder = F.concat_ws("/", "root", "nation", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    return s.where("turn = conv_id % 2").select(folder.alias("folder_path"), name.alias("file"), F.md5(F.substring("role", 1, 3)).alias("art_hash"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit(0).alias("root_ord"), F.concat(F.lit("/docs/"), "source").alias("folder_path"), F.col("source").alias("folder_name"), F.lit("docs").alias("parent_folder"),
        F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".wav").otherwise(".txt")).alias("file"), F.col("n_chars").alias("size"), (F.col("n_chars") % 400 * 1000).alias("bitrate_bps"),
        F.create_map(F.lit("album"), F.col("lang"), F.lit("artist"), F.col("source")).alias("tags"), F.md5("text").alias("file_hash"), F.md5(F.lower("text")).alias("audio_fingerprint"),
    ).withColumn("ext", text.extension(F.col("file")))


def album_files(spark: SparkSession, sf_dir: str, root: str = "/albums") -> DataFrame:
    """Albums with sub-folders, files that are not audio, and copies with another cover: a conversation is an album."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.lit("c"))
    both = talks.unionByName(talks.where("conv_id % 10 = 0").withColumn("k", F.lit("x")))
    album = F.concat(F.lit(f"{root}/"), "k", F.col("conv_id").cast("string"))
    disc = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("/disc"), (F.col("turn") % 3).cast("string")))
    tracks_ = both.select(F.concat(album, disc).alias("folder_path"), F.concat(F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.when(F.col("turn") % 4 == 3, ".txt").otherwise(".mp3")).alias("file"), F.length("text").cast("long").alias("size"), F.md5("text").alias("file_hash"))
    covers = both.where("turn = 0").select(album.alias("folder_path"), F.lit("cover.jpg").alias("file"), F.when(F.col("k") == "c", F.col("conv_id") % 7).otherwise(F.lit(3)).cast("long").alias("size"), F.md5("k").alias("file_hash"))
    return tracks_.unionByName(covers).withColumn("ext", text.extension(F.col("file")))


def dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories: those of the albums, and nests of empty ones from the suppliers."""
    used = tracks(spark, sf_dir).select(F.col("folder_path").alias("path")).distinct()
    s = table(spark, sf_dir, "supplier")
    group = (F.col("s_suppkey") % 10).cast("string")
    bare = s.select(F.explode(F.array(F.concat(F.lit("/lib/empty/g"), group), F.concat(F.lit("/lib/empty/g"), group, F.lit("/s"), F.col("s_suppkey").cast("string")))).alias("path")).distinct()
    roots = used.select(F.explode(F.array(F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2)), F.regexp_replace("path", r"/[^/]*\z", ""))).alias("path")).distinct()
    every = used.unionByName(bare).unionByName(roots).distinct()
    return every.select("path", text.base_name(F.col("path")).alias("name"), F.regexp_replace("path", r"/[^/]*\z", "").alias("parent_path"))


def mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five copies of each album (a conversation) under roots of their own, each with some of its tags: what merges in order are checked on."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("m"))
    keys = ("title", "artist", "album", "genre")
    said = F.concat(F.lit("m"), F.col("m").cast("string"), F.lit(" "), F.left("text", F.lit(20)))
    every = F.create_map(*[x for k, name in enumerate(keys) for x in (F.lit(name), F.when((F.col("conv_id") + F.col("turn") * 3 + F.col("m") * 2 + k) % 7 == 0, said))])
    folder = F.concat(F.lit("/m"), F.col("m").cast("string"), F.lit("/c"), F.col("conv_id").cast("string"))
    return talks.select(
        folder.alias("folder_path"), F.concat(F.lpad((F.col("turn") + 1).cast("string"), 3, "0"), F.lit(".mp3")).alias("file"), (F.col("turn") + 1).cast("int").alias("pos"), F.md5(F.concat("text", (F.col("turn")).cast("string"))).alias("file_hash"),
        F.when((F.col("conv_id") + F.col("turn") + F.col("m")) % 11 != 3, F.map_filter(every, lambda k, x: x.isNotNull())).alias("tags"),
    )


def mirror_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(preferred, other, weighted_score): two thirds of the pairs of an album's mirrors, in an order that differs by album."""
    albums = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    two = albums.select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("conv_id", "i", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).where("i <> j and (i * 5 + j + conv_id) % 3 <> 0")
    path = lambda k: F.concat(F.lit("/m"), F.col(k).cast("string"), F.lit("/c"), F.col("conv_id").cast("string"))
    return two.select(path("i").alias("preferred"), path("j").alias("other"), (80 + (F.col("conv_id") * 7 + F.col("i") * 5 + F.col("j") * 11) % 19).cast("double").alias("weighted_score"))


def mirror_art(spark: SparkSession, sf_dir: str) -> DataFrame:
    albums = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("m")).where("(conv_id + m * 3) % 4 = 0")
    return albums.select(F.concat(F.lit("/m"), F.col("m").cast("string"), F.lit("/c"), F.col("conv_id").cast("string")).alias("folder_path"), F.concat(F.lit("cover."), F.when(F.col("m") % 2 == 0, "jpg").otherwise("png")).alias("file"), F.lit("a").alias("art_hash"))


def alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"), F.col("n_name").alias("value"))


def role_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that also know the artists: some nations, and each role in capitals."""
    roles = table(spark, sf_dir, "conversations").select(F.lower("role").alias("key"), F.upper("role").alias("value")).where("key = 'user'").distinct()
    return alias(spark, sf_dir).where("key < 'f'").unionByName(roles)


#: The same views for DuckDB; tags are columns, `readable` tells whether there are any.
SQL = r"""
WITH talks AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
src AS (
  SELECT t.*, lower(n_name) AS nation FROM (
    SELECT *, 0 AS root_ord, '/lib' AS root FROM talks UNION ALL
    SELECT conv_id, turn, role, CASE WHEN conv_id % 10 = 1 THEN text || '~' ELSE text END, 1, '/copy' FROM talks WHERE conv_id % 10 IN (0, 1)) t
  JOIN nation ON conv_id % 25 = n_nationkey),
raw AS (
  SELECT root_ord, root || '/' || nation || '/c' || conv_id AS folder_path, 'c' || conv_id AS folder_name, nation AS parent_folder,
    lpad(CAST(turn + 1 AS VARCHAR), 2, '0') || ' ' || regexp_replace(left(text, 24), '[/\n]', ' ', 'g') || CASE conv_id % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.flac' ELSE '.MP3' END AS file,
    length(text) AS size, [96000, 128000, 192000, 320000, 1411000][1 + length(text) % 5] AS bitrate_bps, NOT (conv_id % 17 = 5 AND turn = 2) AS readable,
    left(text, 40) AS title0, CASE WHEN conv_id % 3 > 0 THEN role END AS artist0, 'album ' || (conv_id % 10) AS album0, CASE WHEN turn % 4 = 0 THEN 'Promo mix' ELSE 'pop' END AS genre0,
    CASE WHEN turn % 2 = 0 THEN 'la' END AS lyrics0, md5(text) AS file_hash, md5(lower(text)) AS audio_fingerprint, (turn % 3 = 0 AND conv_id % 4 <> 3) AS has_embedded_art
  FROM src),
tracks AS (
  SELECT *, lower(substr(file, length(regexp_replace(file, '(?s)\A((?:.*/)?\.*[^./][^/]*)\.[^./]*\z', '\1')) + 1)) AS ext, row_number() OVER (PARTITION BY folder_path ORDER BY file) AS pos,
    CAST(bitrate_bps // 1000 AS INT) AS bitrate_kbps, folder_path || '/' || file AS path, CASE WHEN readable THEN title0 END AS title, CASE WHEN readable THEN artist0 END AS artist, CASE WHEN readable THEN album0 END AS album,
    CASE WHEN readable THEN genre0 END AS genre, CASE WHEN readable THEN lyrics0 END AS lyrics FROM raw),
art AS (
  SELECT root || '/' || nation || '/c' || conv_id AS folder_path, CASE conv_id % 4 WHEN 0 THEN 'cover.jpg' WHEN 1 THEN 'Folder.JPG' ELSE 'back.png' END AS file, md5(substr(role, 1, 3)) AS art_hash
  FROM src WHERE turn IN (0, 1) AND turn = conv_id % 2),
doc_files AS (
  SELECT 0 AS root_ord, '/docs/' || source AS folder_path, source AS folder_name, 'docs' AS parent_folder, doc_id || CASE WHEN doc_id % 5 = 0 THEN '.wav' ELSE '.txt' END AS file, n_chars AS size, n_chars % 400 * 1000 AS bitrate_bps,
    lang AS album, source AS artist, md5(text) AS file_hash, md5(lower(text)) AS audio_fingerprint, CASE WHEN doc_id % 5 = 0 THEN '.wav' ELSE '.txt' END AS ext,
    '/docs/' || source || '/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.wav' ELSE '.txt' END AS path FROM documents),
album_talks AS (SELECT *, 'c' AS k FROM talks UNION ALL SELECT *, 'x' FROM talks WHERE conv_id % 10 = 0),
album_files AS (
  SELECT '/albums/' || k || conv_id || CASE turn % 3 WHEN 0 THEN '' ELSE '/disc' || (turn % 3) END AS folder_path, lpad(CAST(turn + 1 AS VARCHAR), 2, '0') || CASE turn % 4 WHEN 3 THEN '.txt' ELSE '.mp3' END AS file,
    length(text) AS size, md5(text) AS file_hash, CASE turn % 4 WHEN 3 THEN '.txt' ELSE '.mp3' END AS ext FROM album_talks
  UNION ALL SELECT '/albums/' || k || conv_id, 'cover.jpg', CASE k WHEN 'c' THEN conv_id % 7 ELSE 3 END, md5(k), '.jpg' FROM album_talks WHERE turn = 0),
used AS (SELECT DISTINCT folder_path AS path FROM tracks),
all_dirs AS (
  SELECT path FROM used UNION SELECT '/' || split_part(path, '/', 2) FROM used UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM used UNION
  SELECT '/lib/empty/g' || (s_suppkey % 10) FROM supplier UNION SELECT '/lib/empty/g' || (s_suppkey % 10) || '/s' || s_suppkey FROM supplier),
dirs AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/[^/]*$', '') AS parent_path FROM all_dirs),
alias AS (SELECT lower(n_name) AS key, n_name AS value FROM nation),
role_alias AS (SELECT * FROM alias WHERE key < 'f' UNION ALL SELECT DISTINCT lower(role), upper(role) FROM conversations WHERE lower(role) = 'user'),
covers AS (SELECT folder_path, arg_min(art_hash, file) AS album_art FROM art WHERE lower(file) IN ('cd cover.jpg', 'album cover.jpg', 'albumartsmall.jpg', 'cover.jpg', 'folder.jpg', 'cover.png') GROUP BY ALL),
files AS (
  SELECT *, row_number() OVER (PARTITION BY folder_path ORDER BY file) AS p, count(*) OVER (PARTITION BY folder_path) AS n FROM tracks
  WHERE readable AND folder_path IN (SELECT folder_path FROM tracks GROUP BY 1 HAVING count(*) > 2)),
pairs AS (
  SELECT a.folder_path AS f1, b.folder_path AS f2, a.n FROM (SELECT DISTINCT folder_path, root_ord, n FROM files) a JOIN (SELECT DISTINCT folder_path, root_ord, n FROM files) b
    ON a.n = b.n AND (a.root_ord, a.folder_path) < (b.root_ord, b.folder_path))
"""
