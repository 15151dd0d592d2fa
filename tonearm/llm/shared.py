"""What the operators share: written tables that cut lineage, bounded Arrow batches, the word pattern."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class body; a word is a run of anything else.
SPACE = r"\x20\x09-\x0D"

_own_folder: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests, one
    machine) gets a temporary folder; a cluster gets an error, since no folder of the driver's would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own_folder[0]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and a lost executor costs no more than its running tasks."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[read] = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        path = _paths.pop(t, None)
        if path is not None:
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bound_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Limit what one Arrow batch brings to a Python worker, by rows and by bytes, since texts can be long. The session's own
    limits stay where they are tighter."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        now = re.match("[0-9]*", str(spark.conf.get(f"spark.sql.execution.arrow.{name}")))[0]
        if not now or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def column(name: str) -> Column:
    """A top-level column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs as one struct: what an operator adds beside it cannot clash with any of them."""
    return F.struct(*map(column, docs.columns)).alias(name)


def words(text: Column) -> Column:
    """The words of a text, as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def redealt(key: Column, nothing: str | bytes = "") -> Column:
    """key, unchanged, but no longer known to be what its rows are dealt by: a join on it then exchanges this side too,
    which lets adaptive execution split a hot key on the other side. For sides that were just aggregated; `nothing` is of the
    key's kind, string or binary."""
    return F.concat(key, F.lit(nothing))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
