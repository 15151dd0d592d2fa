"""Secret scans: pattern spans, and corpus-wide ownership of what they hold.

Base spans come from three patterns. The method looks at every candidate value (the base spans' values and any long
token of mixed letters and digits), hashes it, and counts in how many distinct repositories and owners each hash
occurs over the whole corpus. A value that many owners or repositories carry is a copied example; one that few carry and
that has the look of a credential is live. Live tokens outside the base spans become spans of kind `owned`.

All of it is DataFrame code. A text is split by the pattern: the gaps between matches and the matches themselves, measured
in code points and summed up by a window, give every start and end. Only matches leave their text's task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.shared import column, let, redealt, stored, whole

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]+"
#: kind, pattern, least length of the value. The runs of access and hex cannot start later and be long enough when the
#: whole run is too short, so their least length stands in the pattern; that of assign is tested on each match.
BASE = (("assign", ASSIGN + VALUE, 12), ("access", "AKIA[A-Z0-9]{14,}", 0), ("hex", "[0-9a-f]{16,}", 0))
#: A long token; `live_looking` asks for more.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Words that mark a token as a placeholder.
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|your|xxxx|test"
#: What is carried by more is widely copied.
MOST_OWNERS, MOST_REPOS = 2, 3

KINDS = (*BASE, ("owned", TOKEN, 0))
SPAN = "struct<start:bigint,nth:int,kind:string,end:bigint,value:string,owners:bigint,repos:bigint,live:boolean>"


def matches_of(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern, each with the length of the gap before it, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def told(hits):
        gaps = F.slice(F.transform(F.split(text, pattern), F.length), F.lit(1), F.size(hits))
        return F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    return let(found, lambda hits: F.when(F.size(hits) > 0, told(hits)).otherwise(F.expr("cast(array() as array<struct<gap:int,hit:string>>)")))


def distinct_signs(value: Column) -> Column:
    return F.size(F.array_remove(F.array_distinct(F.split(value, "")), ""))


def live_looking(value: Column) -> Column:
    """Upper and lower case letters and digits, many different characters, and no placeholder word."""
    kinds = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
    return kinds & (distinct_signs(value) >= 10) & ~value.rlike(PLACEHOLDER)


def credible(kind: Column, value: Column) -> Column:
    """Whether a value of a base span looks like a credential: letters and digits (an access key may have letters alone), six
    different characters or more, and no placeholder word. A long name or a long number is none."""
    mixed = value.rlike("[A-Za-z]") & (value.rlike("[0-9]") | (kind == "access"))
    return mixed & (distinct_signs(value) >= 6) & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, spans), both stored. rows: one row per row of docs: row (a number), id, owner, repo, at (a digest of id and
    text). spans: row, owner, repo, nth, kind, start, end, value of the base spans and of live-looking tokens outside them."""
    text = F.coalesce(column(text_col), F.lit(""))
    has_key = F.when(F.contains("t", F.lit("AKIA")), matches_of(F.col("t"), BASE[1][1]))  # a plain search first
    found = [has_key if kind == "access" else matches_of(F.col("t"), pattern) for kind, pattern, _ in KINDS]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), column(id_col).alias("id"), column(owner_col).cast("string").alias("owner"),
        F.to_json(F.struct(*map(column, repo_cols))).alias("repo"), text.alias("t"),
    ).withColumn("at", at(F.col("id"), F.col("t"))).withColumn("found", F.array(*[F.coalesce(f, F.expr("cast(array() as array<struct<gap:int,hit:string>>)")) for f in found])).drop("t")
    rows = stored(rows, "secrets")

    hits = rows.select("row", "owner", "repo", F.posexplode("found").alias("nth", "m")).where(F.size("m") > 0).repartition("row")
    hits = hits.select("row", "owner", "repo", "nth", F.posexplode("m").alias("i", "m")).select("row", "owner", "repo", "nth", "i", "m.*")
    upto = Window.partitionBy("row", "nth").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in KINDS]), F.col("nth") + 1)
    value = F.when(F.col("nth") == 0, F.regexp_replace("hit", "^" + ASSIGN, "")).otherwise(F.col("hit"))
    least = reduce(lambda w, n: w.when(F.col("nth") == n, KINDS[n][2]), range(1, len(KINDS)), F.when(F.col("nth") == 0, KINDS[0][2]))
    placed = hits.withColumns({"end": end, "kind": kind, "value": value}).withColumn("start", F.col("end") - F.length("hit")).where(F.length("value") >= least).drop("hit", "gap", "i")

    # a token overlaps a base span if one that begins before the token's end lasts beyond its start
    own = F.col("kind") == "owned"
    before = Window.partitionBy("row").orderBy(F.when(own, F.col("end")).otherwise(F.col("start")), F.when(own, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(~own, F.col("end"))).over(before), F.lit(0))
    spans = placed.where(~own | live_looking(F.col("value"))).withColumn("reach", reach).where(~own | (F.col("reach") <= F.col("start"))).drop("reach")
    return rows.drop("found"), stored(spans, "spans")


def at(id_: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")), text), 256)


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repos): in how many distinct owners and repositories each candidate value occurs."""
    seen = spans.select(F.sha2("value", 256).alias("hash"), "owner", "repo")
    by_repo = seen.groupBy("hash", "owner", "repo").count()
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def judged(spans: DataFrame, most_owners: int, most_repos: int) -> DataFrame:
    """(row, s): spans with owners, repos and live; `owned` ones only if live."""
    known = stored(ownership(spans), "ownership")
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos) & ((F.col("kind") == "owned") | credible(F.col("kind"), F.col("value")))
    found = spans.join(known.select(redealt(F.col("hash")).alias("h"), "owners", "repos"), F.sha2("value", 256) == F.col("h")).withColumn("live", live)
    return found.where("kind <> 'owned' or live").select("row", F.struct("start", "nth", "kind", "end", "value", "owners", "repos", "live").alias("s"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row per row of docs: id, spans (kind, start, end, value, owners, repos, live) by start, then kind as listed.

    live: has the look of a credential, and at most `most_owners` distinct owners and `most_repos` distinct repositories carry
    it. Base spans are all kept, live or not; `owned` spans only if live. Nulls: a null text has no spans; null owners and
    null repository columns count as one owner of their own. Repeated rows are reported one by one and are one owner. An
    empty table gives no rows; other columns are not read. Long texts with very many hits cost time in proportion.
    """
    rows, spans = scan(docs, id_col, text_col, owner_col, list(repo_cols))
    listed = judged(spans, most_owners, most_repos).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans")).withColumnRenamed("row", "r")
    out = rows.select("row", "id").join(listed, F.col("row") == F.col("r"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS, mark: str = "<secret>") -> DataFrame:
    """docs with each live value replaced by `mark`; copied examples and all else stay, whatever the columns are called.

    A text is rewritten once per distinct live value that it carries itself, longest first. Nulls: a null text stays null,
    a null id is like any other. Rows that repeat an id are rewritten each by its own text. An empty table gives no rows.
    """
    rows, spans = scan(docs, id_col, text_col, owner_col, list(repo_cols))
    values = judged(spans, most_owners, most_repos).where("s.live").groupBy("row").agg(F.collect_set("s.value").alias("live")).withColumnRenamed("row", "r")
    live = rows.join(values, F.col("row") == F.col("r")).groupBy("at").agg(F.first("live").alias("live")).select(redealt(F.col("at")).alias("a"), "live")
    text = F.col("row")[text_col]
    longest = F.array_sort(F.col("live"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    clean = F.when(F.col("live").isNull(), text).otherwise(F.aggregate(longest, text, lambda t, v: F.replace(t, v, F.lit(mark))))
    own = docs.select(whole(docs)).withColumn("at", at(F.col("row")[id_col], F.coalesce(F.col("row")[text_col], F.lit(""))))
    joined = own.join(stored(live, "live"), F.col("at") == F.col("a"), "left").withColumn("clean", clean)
    return joined.select(*[(F.col("clean") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
