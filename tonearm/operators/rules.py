"""Clean-up rules over files: filters and proposed changes. Every plan is a DataFrame of actions that nobody carries out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators.catalog import tag


def path() -> Column:
    return F.concat_ws("/", "folder_path", "file")


def action(name: str, src: Column, dst: Column | None = None, reason: str = "") -> list[Column]:
    return [F.lit(name).alias("action"), src.alias("src"), (F.lit(None).cast("string") if dst is None else dst).alias("dst"), F.lit(reason).alias("reason")]


def repaired(tracks: DataFrame, fields: tuple[str, ...] = ("artist", "album", "title")) -> DataFrame:
    """(folder_path, file, fields): tags with garbled Hebrew put right."""
    return tracks.select("folder_path", "file", *[text.fix_mojibake(tag(f)).alias(f) for f in fields])


def track_word(tracks: DataFrame, keep_case: bool = False) -> DataFrame:
    """(folder_path, file, new_file, new_title): `track` in Hebrew in file names and titles."""
    name = F.concat(text.replace_track_word(text.stem(F.col("file")), keep_case), F.substring("file", F.length(text.stem(F.col("file"))) + 1, 2**31 - 1))
    return tracks.select("folder_path", "file", name.alias("new_file"), text.replace_track_word(tag("title"), keep_case).alias("new_title"))


def fill_unknown(tracks: DataFrame) -> DataFrame:
    return tracks.select("folder_path", "file", *[F.coalesce(text.present(tag(f)), F.lit(f"Unknown {f.capitalize()}")).alias(f) for f in ("title", "artist")])


def apply_album_tags(tracks: DataFrame, albums: DataFrame | None = None) -> DataFrame:
    """Files without title or artist get all four fields from their album's record, or `Unknown ...`."""
    fields = ("title", "artist", "album", "genre")
    if albums is None:
        rows = tracks.select("folder_path", "file", "tags", *[F.lit(None).cast("string").alias(f"a_{f}") for f in fields])
    else:
        rows = tracks.join(albums.select("folder_path", *[F.col(f).alias(f"a_{f}") for f in fields]), "folder_path", "left")
    missing = text.present(tag("title")).isNull() | text.present(tag("artist")).isNull()
    return rows.select("folder_path", "file", *[F.when(missing, F.coalesce(f"a_{f}", F.lit(f"Unknown {f.capitalize()}"))).otherwise(tag(f)).alias(f) for f in fields])


def rename_from_title(tracks: DataFrame) -> DataFrame:
    suffix = F.substring("file", F.length(text.stem(F.col("file"))) + 1, 2**31 - 1)
    return tracks.where(text.present(tag("title")).isNotNull()).select(*action("rename", path(), F.concat_ws("/", "folder_path", F.concat(tag("title"), suffix)), "title"))


def remove_repeating(tracks: DataFrame) -> DataFrame:
    name = text.stem(F.col("file"))
    new = text.without_repeating_name(name)
    return tracks.withColumn("new", new).where("new is not null").select(*action("rename", path(), F.concat_ws("/", "folder_path", F.concat("new", F.substring("file", F.length(name) + 1, 2**31 - 1))), "repeating name"))


def english_names(tracks: DataFrame, stem_only: bool = False) -> DataFrame:
    """File names with a Latin letter. The extension counts too, unless stem_only."""
    name = text.stem(F.col("file")) if stem_only else F.col("file")
    return tracks.where(name.rlike("[A-Za-z]")).select("folder_path", "file")


def ascii_albums(folders: DataFrame) -> DataFrame:
    return folders.select("folder_path", "folder_name").distinct().where(F.col("folder_name").rlike(r"\A\p{ASCII}*\z"))


def ascii_titles(tracks: DataFrame) -> DataFrame:
    return tracks.where(text.present(tag("title")).isNotNull() & tag("title").rlike(r"\A\p{ASCII}*\z")).select("folder_path", "file", tag("title").alias("title"))


def fixed_genres(tracks: DataFrame) -> DataFrame:
    return tracks.where(text.is_ad_genre(tag("genre"))).select(*action("set_tag", path(), F.lit("Unknown"), "genre"))


def artist_from_parent(tracks: DataFrame) -> DataFrame:
    return tracks.where(tag("artist") != F.col("parent_folder")).select(*action("set_tag", path(), F.col("parent_folder"), "artist"))


def set_tags(tracks: DataFrame, field: str, value: Column, when: Column) -> DataFrame:
    """A change of one tag for each file that a rule selects."""
    return tracks.where(when).select(*action("set_tag", path(), value, field))


def high_bitrate(tracks: DataFrame, over: int = 320_000) -> DataFrame:
    return tracks.where(F.col("bitrate_bps") > over).select("folder_path", "file", "bitrate_bps")


def missing_art(tracks: DataFrame) -> DataFrame:
    return tracks.where(~F.coalesce("has_embedded_art", F.lit(False))).select("folder_path", "file")


def albums_needing_art(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("folder_path").agg(F.coalesce(F.bool_or("has_embedded_art"), F.lit(False)).alias("any")).where("not any").select("folder_path")


def existing_renames(renames: DataFrame, names: DataFrame, children: DataFrame) -> DataFrame:
    """What a rename list (line_no, source, target) asks for among `names` (name), with what lies in them (`children`: name,
    child): lines whose two names differ and are both listed. The first line of a source counts, since it is gone then.
    Where the target is still there each child is moved (`merge_dir`) and the source dropped (`rmtree`); where an earlier
    line has taken it away the source is renamed. Names that come back by a rename take part when the plan is run again."""
    there = names.select("name").distinct()
    both = renames.where("source <> target").join(there, F.col("source") == F.col("name"), "left_semi").join(there.withColumnRenamed("name", "n2"), F.col("target") == F.col("n2"), "left_semi")
    lines = both.groupBy("source").agg(F.min(F.struct("line_no", "target")).alias("l")).select("source", "l.*")
    taken = lines.select(F.col("source").alias("gone"), F.col("line_no").alias("since"))
    judged = lines.join(taken, F.col("target") == F.col("gone"), "left").withColumn("renamed", F.coalesce(F.col("since") < F.col("line_no"), F.lit(False)))
    merged = judged.where("not renamed")
    moves = merged.join(children, F.col("source") == F.col("name")).select(*action("merge_dir", F.concat_ws("/", "source", "child"), F.concat_ws("/", "target", "child"), "rename list"))
    drops = merged.select(*action("rmtree", F.col("source"), reason="rename list"))
    return judged.where("renamed").select(*action("rename", F.col("source"), F.col("target"), "rename list")).unionByName(moves).unionByName(drops)


def summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.countDistinct("src").alias("n_files"))


def recycle(losers: DataFrame, bin_path: str, suffix: bool = False) -> DataFrame:
    """Losing copies go to a bin under their base name; suffix numbers equal names, by path, instead of letting them collide. A
    name of very many files is numbered over ranges."""
    name = F.col("file")
    if suffix:
        from tonearm.operators.dedupe import numbered

        losers = numbered(losers.select("folder_path", "file"), "file", "folder_path")
        name = F.when(F.col("place") > 1, F.concat_ws(".", "file", (F.col("place") - 1).cast("string"))).otherwise(F.col("file"))
    return losers.select(*action("recycle", path(), F.concat_ws("/", F.lit(bin_path), name), "duplicate"))
