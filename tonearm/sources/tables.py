"""Schemas of the library tables; readers and writers for the small files around them."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.functions import text

TRACKS = (
    "root_ord INT, folder_path STRING, folder_name STRING, parent_folder STRING, file STRING, ext STRING, pos INT, size BIGINT, bitrate_bps BIGINT, "
    "bitrate_kbps INT, tags MAP<STRING,STRING>, file_hash STRING, audio_fingerprint STRING, has_embedded_art BOOLEAN"
)
ART = "folder_path STRING, file STRING, art_hash STRING"
DIRS = "path STRING, name STRING, parent_path STRING, n_entries BIGINT"
ARTIST_ALIAS = "key STRING, value STRING"


def hashes(content: Column, kinds: tuple[str, ...]) -> list[Column]:
    """The hashes asked for, of md5 (as file_hash) and sha256."""
    known = {"md5": F.md5(content).alias("file_hash"), "sha256": F.sha2(content, 256).alias("sha256")}
    return [known[k] for k in kinds]


def scan_files(spark: SparkSession, root: str, root_ord: int = 0, kinds: tuple[str, ...] = (), manifest: DataFrame | None = None) -> DataFrame:
    """One row per file below root: folder, name, extension, size, time, and the hashes of its bytes that `kinds` asks for
    (md5, sha256). Content is read only then, and never leaves the scan.

    Spark's reader lists no files of zero bytes. A manifest (path, size, modified) of all files brings them in, with the
    hashes of nothing; other files that the reader does not find, or cannot read, have null hashes then."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = lambda p: F.regexp_replace(p, "^file:/*", "/")
    rows = found.select(plain("path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *hashes(F.col("content"), kinds))
    if manifest is not None:
        names = [c for c in rows.columns if c not in ("path", "size", "modified")]
        nothing = spark.range(1).select(*hashes(F.lit(b""), kinds)) if kinds else None
        listed = manifest.select(plain("path").alias("path"), "size", "modified").where(F.startswith("path", F.lit(root.removeprefix("file:").rstrip("/") + "/")))
        rows = listed.join(rows.select(F.col("path").alias("p"), *names), F.col("path") == F.col("p"), "left").drop("p")
        if nothing is not None:
            empty = nothing.first()  # one row of constants
            rows = rows.withColumns({c: F.when(F.col("size") == 0, F.lit(empty[c])).otherwise(F.col(c)) for c in names})
    at = F.regexp_replace("path", r"/[^/]*\z", "")
    own = rows.select(F.lit(root_ord).alias("root_ord"), at.alias("folder_path"), text.base_name(F.col("path")).alias("file"), text.extension(F.col("path")).alias("ext"), *[c for c in rows.columns if c != "path"])
    return own.withColumns({"folder_name": text.base_name(F.col("folder_path")), "parent_folder": text.parent_name(F.col("folder_path"))})


def csv_fields(line: Column) -> Column:
    """The fields of a CSV line: a field that begins with a quote ends at the next single one, and two stand for one; quotes
    elsewhere are characters. Empty fields are empty texts."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+(?:"[^,]*|\z)|[^,]*)'), F.lit(1))
    part = lambda f, k: F.regexp_extract(f, r'(?s)\A"((?:[^"]++|"")*+)"?(.*)\z', k)
    return F.transform(raw, lambda f: F.when(F.startswith(f, F.lit('"')), F.concat(F.replace(part(f, 1), F.lit('""'), F.lit('"')), part(f, 2))).otherwise(f))


def left_open(line: Column) -> Column:
    """Whether a line that begins outside a quoted field ends within one."""
    return F.rlike(line, F.lit(r'\A(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+\z'))


def carried(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows (outside, inside), whether a row leaves a field open if none, or one, is open before it, with before_outside and
    before_inside: whether one is open before the row, if none, or one, is before the first row of its group. A row that always
    leaves the same sets what follows, one that changes it is counted: a running sum and a running last value tell the rest."""
    own = Window.partitionBy(*by).orderBy(order)
    swaps = (F.col("outside") & ~F.col("inside")).cast("long")
    counted = rows.withColumn("swaps", F.sum(swaps).over(own))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "swaps"))
    last = counted.withColumn("fixed", F.last(fixed, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    odd = lambda n: n % 2 == 1
    since = F.col("swaps") - swaps
    before = lambda first: F.when(F.col("fixed").isNull(), odd(since) != F.lit(first)).otherwise(odd(since - F.col("fixed.swaps")) != F.col("fixed.outside"))
    return last.withColumns({"before_outside": before(False), "before_inside": before(True)}).drop("swaps", "fixed")


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, fields) of the records of CSV files without a header; lines without any character, outside quotes, are none.
    A quoted field may hold line breaks (each told as a line feed); a quote that is never closed takes the rest of its file, and
    no other file. line_no orders all records by the file's path and the place of their first line, whichever task reads it.

    Files of any size are read in parts. What a line leaves open depends on what is open before it, which is carried over
    the lines of a part, then over parts (one row each), and joined back."""
    text_ = F.regexp_replace("value", r"\r\z", "")
    ends = {"outside": left_open(F.col("text")), "inside": left_open(F.concat(F.lit('"'), "text"))}
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"), text_.alias("text"))
    lines = written(read.withColumns(ends), "lines")
    held = carried(lines, ["file", "part"], "line")
    left = lambda before: F.max_by(F.when(F.col(before), F.col("inside")).otherwise(F.col("outside")), "line")
    parts = held.groupBy("file", "part").agg(left("before_outside").alias("outside"), left("before_inside").alias("inside"))
    entered = carried(parts, ["file"], "part").select(F.col("file").alias("f"), F.col("part").alias("p"), F.col("before_outside").alias("entered"))
    same = (F.col("file") == F.col("f")) & (F.col("part") == F.col("p"))
    begins = ~F.when(F.col("entered"), F.col("before_inside")).otherwise(F.col("before_outside"))
    marked = written(held.join(entered, same).select("file", "part", "line", "text", F.when(begins, F.struct("part", "line")).alias("begin")), "marked")
    # a line belongs to the record that began last, in its part or an earlier one of the file
    latest = marked.groupBy("file", "part").agg(F.max("begin").alias("begin"))
    earlier = F.last("begin", ignorenulls=True).over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    entered = latest.select(F.col("file").alias("f"), F.col("part").alias("p"), earlier.alias("earlier"))
    begun = marked.withColumn("begin", F.last("begin", ignorenulls=True).over(Window.partitionBy("file", "part").orderBy("line"))).join(entered, same)
    record = begun.groupBy("file", F.coalesce("begin", "earlier").alias("begin")).agg(F.array_sort(F.collect_list(F.struct("part", "line", "text"))).alias("own"))
    whole = record.select(F.struct(F.col("file").alias("file_path"), F.col("begin.part").alias("file_block_start"), "begin.line").alias("line_no"), F.array_join(F.col("own.text"), "\n").alias("text"))
    return whole.where("text <> ''").select("line_no", csv_fields(F.col("text")).alias("fields"))


def artist_alias(lines: DataFrame, keep_case: bool = False) -> DataFrame:
    """(key, value) from rows (line_no, fields): exactly two fields count; of equal keys the last line wins."""
    two = lines.where(F.size("fields") == 2)
    key = text.strip(F.col("fields")[0])
    pairs = two.select((key if keep_case else F.lower(key)).alias("key"), text.strip(F.col("fields")[1]).alias("value"), "line_no")
    return pairs.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def read_artist_alias(spark: SparkSession, path: str, keep_case: bool = False) -> DataFrame:
    """A two-column CSV file without a header."""
    return artist_alias(csv_lines(spark, path), keep_case)


def read_rename_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, source, target): the first two fields of each line; empty ones are empty texts."""
    fields = F.col("fields")
    return csv_lines(spark, path).where(F.size("fields") >= 2).select("line_no", fields[0].alias("source"), fields[1].alias("target"))


#: What tells a file that is damaged, or no longer there, from a store that does not answer.
DAMAGED = ("FAILED_READ_FILE", "CANNOT_READ_FILE", "MALFORMED_RECORD", "MALFORMED_JSON", "CANNOT_PARSE", "PARQUET_CONVERSION", "UNABLE_TO_INFER", "not a Parquet file", "Could not read footer")
UNREACHABLE = ("Permission denied", "AccessControlException", "ConnectException", "UnknownHostException", "No route to host", "ExecutorLostFailure", "No space left", "OutOfMemory", "TimeoutException")


def file_system(spark: SparkSession, path: str):
    """(file system, path) as the store's client knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def absent(spark: SparkSession, path: str) -> bool:
    """Whether nothing is saved at path; a store that does not answer raises."""
    store, place = file_system(spark, path)
    return not store.exists(place)


def opened(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame | None:
    """A table, read once to know that it can be; None if a file of it is damaged. All else that goes wrong raises."""
    try:
        found = spark.read.schema(schema).option("mode", "FAILFAST").format(kind).load(path)
        found.agg(*[F.count(f"`{c}`") for c in found.columns]).collect()
        return found
    except (PySparkException, Py4JJavaError) as e:
        told = str(e)
        if any(x in told for x in UNREACHABLE) or not any(x in told for x in DAMAGED):
            raise
        return None


def load_catalog(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A saved catalog; one that is missing, or of which any file is damaged, is empty. All its rows are read once to know that
    they can be. Anything else that goes wrong (no permission, no connection, a lost executor) raises: what cannot be reached
    is not empty."""
    found = None if absent(spark, path) else opened(spark, path, schema, kind)
    return spark.createDataFrame([], schema) if found is None else found


def save_catalog(catalog: DataFrame, path: str, kind: str = "parquet", mode: str = "append") -> None:
    catalog.write.mode(mode).format(kind).save(path)


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """The folders of the snapshots at path, oldest first. Each is named by an empty file in `manifest`, `number-folder`: such
    a file is there or not, and never half there."""
    if absent(spark, f"{path}/manifest"):
        return []
    store, place = file_system(spark, f"{path}/manifest")
    return sorted(x.getPath().getName() for x in store.listStatus(place))


def save_snapshot(catalog: DataFrame, path: str, keep: int = 2, kind: str = "parquet") -> None:
    """Replaces the catalog at path as a whole. The table is written to a folder of its own first, and named when it is
    complete, so that a job that stops half way leaves the old one in force; `catalog` may have been read from it. The last `keep`
    are kept (for readers that are under way), older ones deleted. Of two that are saved at once one is in force."""
    spark, name = catalog.sparkSession, uuid.uuid4().hex
    catalog.write.format(kind).save(f"{path}/{name}")
    earlier = snapshots(spark, path)
    number = int(earlier[-1].split("-")[0]) + 1 if earlier else 1
    store, place = file_system(spark, f"{path}/manifest/{number:012d}-{name}")
    store.create(place, False).close()
    for old in snapshots(spark, path)[:-keep]:
        store.delete(file_system(spark, f"{path}/manifest/{old}")[1], False)  # no longer named before it goes
        store.delete(file_system(spark, f"{path}/{old.split('-')[1]}")[1], True)


def load_snapshot(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> tuple[str, DataFrame]:
    """(state, catalog): `whole`; `older` if the last snapshot is damaged or gone and one before it is not; `damaged` and no rows
    if none can be read; `missing` and no rows if none was ever saved. A store that cannot be reached raises."""
    named = snapshots(spark, path)
    for back, name in enumerate(reversed(named)):
        folder = f"{path}/{name.split('-')[1]}"
        found = None if absent(spark, folder) else opened(spark, folder, schema, kind)
        if found is not None:
            return "older" if back else "whole", found
    return "damaged" if named else "missing", spark.createDataFrame([], schema)


_own_folder: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares: spark.checkpoint.dir. Where that is unset, a local master (tests, one
    machine) gets a temporary folder; a cluster gets an error, since no folder of the driver's would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_folder[0] if _own_folder else tempfile.mkdtemp(prefix="spark-")
        _own_folder[:] = [base]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read back. Cuts long plans at tables that are used several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
