"""Files that keep arriving: scan each once, keep the first of equal content, keep a catalog of folders up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonearm.sources.tables import absent

FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def incoming_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of new files below root with the MD5 of their bytes; the checkpoint remembers what was scanned."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.selectExpr("path", "modificationTime AS modified", "length AS size", "md5(content) AS file_hash")


def first_copies(files: DataFrame, delay: str | None = None) -> DataFrame:
    """Drops later copies. With a delay the state is bounded and copies that come later than it pass; without one every
    hash is remembered."""
    if delay is None:
        return files.dropDuplicates(["file_hash"])
    return files.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["file_hash"])


def append(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived since the last call, then stop."""
    return files.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def add_folders(batch: DataFrame, number: int, path: str) -> None:
    """Add to the catalog at path the folders of a batch that no earlier batch holds, one row for each folder_path (of unlike rows
    the smallest). They are a part of their own, named by the batch's number: a batch that runs again, after a lost driver say,
    replaces what it wrote, and known folders change nothing."""
    spark, rest = batch.sparkSession, [c for c in batch.columns if c != "folder_path"]
    found = batch.where("folder_path is not null").groupBy("folder_path").agg(F.min(F.struct(*rest)).alias("r")).select("folder_path", "r.*") if rest else batch.where("folder_path is not null").distinct()
    if not absent(spark, path):
        known = spark.read.schema(catalog_schema(found)).parquet(path).where(F.col("batch") < number)
        found = found.join(known.select("folder_path"), "folder_path", "left_anti")
    found.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")


def catalog_schema(folders: DataFrame) -> str:
    """The schema of a catalog that a stream keeps: that of its folders, and the number of the batch that brought each."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in folders.schema.fields) + ", batch BIGINT"


def keep_catalog(folders: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of folders (folder_path and more) into the catalog at path: what has arrived since the last call is added once."""
    return folders.writeStream.foreachBatch(lambda batch, number: add_folders(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
