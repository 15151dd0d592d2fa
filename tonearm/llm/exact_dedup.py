"""Exact deduplication: a tree merge of sorted digest runs.

Every partition of the table makes one run: (digest, smallest id, count) rows, written sorted by digest. In each round
the runs whose numbers agree but for their lowest bits exchange: `fan_in` runs become one (2: binomial rounds; 8: three
binomial rounds in one exchange). An exchange is dealt by run and digest, so every level stays spread over the cluster.
On either side of it rows are sorted by run and digest and equal neighbours are merged (a sorted aggregate), each keeping
the smallest identifier and the sum of counts. A digest that holds a third of all rows reaches a task as one row per run.

Identifiers are verified at every level: two rows only merge if the SHA-256 digest, the byte length and a second,
independent 64-bit hash of the text agree, so a clash of SHA-256 alone does not join two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.shared import SPACE, column, redealt, stored, whole

KEY = ["sha", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def digest_columns(text: Column) -> list[Column]:
    """KEY of a normalised text."""
    return [F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check")]


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, KEY, run), stored: one row per row of docs; a partition is a run, sorted by digest."""
    texts = docs.select(column(id_col).alias("id"), normalised(column(text_col)).alias("t"))
    rows = texts.select("id", *digest_columns(F.col("t")), F.spark_partition_id().alias("run"))
    return stored(rows.sortWithinPartitions(*KEY), "digests")


def merge_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """(KEY, keep_id, group_size) of digest rows: merged within each run, then in rounds until one run is left."""
    fan_in, runs = max(2, fan_in), (rows.agg(F.max("run")).first()[0] or 0) + 1
    # a struct as the least identifier: known ids come before null, and Spark merges sorted neighbours instead of hashing
    level = rows.select("run", *KEY, F.struct(F.col("id").isNull().alias("unknown"), "id").alias("keep"), F.lit(1).cast("long").alias("group_size"))
    while True:
        level = level.groupBy("run", *KEY).agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        if runs == 1:
            return level.select(*KEY, F.col("keep.id").alias("keep_id"), "group_size")
        level, runs = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), -(-runs // fan_in)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per row of docs: id, keep_id (smallest id with that text), group_size, kept, text_sha256.

    Nulls: a null text is empty; a null id never wins over another id and stays only if its group has no other.
    Rows that repeat both id and text count one by one; exactly one of them is kept. An empty table gives no rows.
    Columns other than the two named are not read, so extra columns cannot clash. Long texts leave their task as digests.
    """
    rows = digest_runs(docs, id_col, text_col)
    groups = merge_runs(rows, fan_in).select(redealt(F.col("sha"), b"").alias("g_sha"), F.col("n_bytes").alias("g_bytes"), F.col("check").alias("g_check"), "keep_id", "group_size")
    same = rows.groupBy("id", *KEY).agg(F.count("*").alias("n"))
    # both sides are exchanged for the join, so that a hot digest can be split
    joined = same.join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("n_bytes") == F.col("g_bytes")) & (F.col("check") == F.col("g_check")))
    return joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def place(id_: Column) -> Column:
    """Id and KEY of a row as one binary value: equal for the rows of one id with one text, null ids included."""
    said = F.concat_ws(":", F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")), "n_bytes", "check")
    return F.concat("sha", said.cast("binary"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """docs without copies, all columns kept as they are, whatever their names. Of the rows of a text, one with the smallest
    id stays.

    Nulls: a null text is empty; a null id stays only if its group has no other. Of rows that repeat id and text, the
    first by all their columns that can be ordered stays. An empty table gives no rows. Copies are found on digests; whole
    rows are exchanged once, for the join with what stays.
    """
    rows = digest_runs(docs, id_col, text_col)
    kept = merge_runs(rows, fan_in).select(*KEY, F.col("keep_id").alias("id"))
    repeats = rows.groupBy("id", *KEY).agg(F.count("*").alias("n")).where("n > 1").select(place(F.col("id")).alias("p"), F.lit(True).alias("repeats"))
    stays = stored(kept.select(place(F.col("id")).alias("p")).join(repeats, "p", "left").select(redealt(F.col("p"), b"").alias("at"), F.coalesce("repeats", F.lit(False)).alias("repeats")), "kept")
    own = docs.select(whole(docs), normalised(column(text_col)).alias("t")).select("row", *digest_columns(F.col("t"))).select("row", place(F.col("row")[id_col]).alias("p"))
    left = own.join(stays, F.col("p") == F.col("at"))
    ordered = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    # rows that repeat id and text meet under one key: they are combined in their tasks before they are exchanged
    first = left.where("repeats").groupBy("p").agg(F.min_by("row", F.struct(*ordered)).alias("row"))
    return left.where("not repeats").select("row").unionByName(first.select("row")).select("row.*")
