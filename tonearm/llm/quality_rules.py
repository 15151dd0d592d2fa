"""Quality rules: a base rule on counts, then robust multivariate outliers within each language and source.

The counts are array expressions on each row; no text leaves its task. Five statistics are transformed so that clean
prose is roughly elliptical, and written once. Per group, a minimum-covariance-determinant estimate is found by
concentration steps: distances to the present centre, the half nearest rows, their mean and covariance, again, until the
determinant no longer falls. Two starts (medians with MADs, plain moments) run side by side and the one with the smaller
determinant wins. The covariance is regularised: the square of FLOOR is added to its diagonal, since half of a clean group
may have no repeated line and no symbol at all.

The half's covariance is raised by the factor that makes it consistent for normal rows (CONSISTENCY). The limit is the
0.9999 point of chi-square, and beyond it the room that the base rule itself gives: a row that is typical but for the most
repeated words that the base rule lets pass is not rejected for these. Nothing in it comes from labels or from a corpus, and
up to half of a group's rows may be damaged.

Everything a group contributes is a histogram of fixed-point sums by distance, so tasks combine before the shuffle, a hot
group is no larger in a task than a small one, a step needs one pass, and results do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce
from math import log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.shared import SPACE, column, discard, let, stored, words

SYMBOLS = "#*$%&|<>"
#: Fixed-point units of a statistic; least spread (standard deviation) that a statistic is taken to have.
UNIT, FLOOR = 1000, (0.25, 0.25, 0.25, 0.25, 0.25)
STATS = ("s_len", "s_word", "s_symbol", "s_line", "s_repeat")
#: The base rule: least words, most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATS = 10, 20
#: 0.5 / P(chi-square with 7 degrees of freedom <= median of that with 5): what half of normal rows in 5 dimensions need.
CONSISTENCY = 1.9122
#: The 0.9999 point of chi-square with 5 degrees of freedom, and the room of the base rule.
LIMIT = 25.745 + (log1p(MOST_REPEATS) / FLOOR[-1]) ** 2
BIN = 16  # bins per doubling of a squared distance


def repeated_words(found: Column, window: int = 5) -> Column:
    """How many words lie in windows that occur twice or more. Windows are compared by a 64-bit hash of their words."""
    n = F.size(found) - (window - 1)

    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s):
            before, after = F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1)
            pairs = F.zip_with(before, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

        def reach(at):
            nxt = F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(2**31 - 1)))
            return F.aggregate(F.zip_with(at, nxt, lambda a, b: F.least(b - a, F.lit(window))), F.lit(0).cast("long"), lambda t, x: t + x)

        return let(let(placed, starts), reach)

    def of(w):
        return let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return F.when(n >= 2, let(found, of)).otherwise(F.lit(0).cast("long"))


def counts(docs: DataFrame, id_col: str, text_col: str, by: list[str]) -> DataFrame:
    """id, the group columns, n_words and the base counts of each row."""
    raw = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("id"), *[column(c).alias(f"g{i}") for i, c in enumerate(by)], raw.alias("t"))
    blank = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    found = let(words(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return rows.select(
        "id", *[f"g{i}" for i in range(len(by))], found.alias("f"),
        F.length(F.translate("t", blank, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), F.length("t").alias("n_chars"),
    ).select("*", "f.*").drop("f")


def statistics(rows: DataFrame) -> DataFrame:
    """The transformed statistics, as fixed-point longs."""
    n = F.greatest("n_words", F.lit(1))
    s = {
        "s_len": F.log1p("n_words"), "s_word": F.log1p(F.col("word_chars") / n) * 4, "s_symbol": F.log1p(100 * F.col("n_symbols") / F.greatest("n_chars", F.lit(1))) * 2,
        "s_line": F.log1p("n_dup_lines"), "s_repeat": F.log1p(100 * F.col("n_repeat_words") / n),
    }
    return rows.withColumns({k: F.round(v * UNIT).cast("long") for k, v in s.items()})


def _pairs():
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _sums() -> list[Column]:
    """n, sums t0.. and cross products x00..: exact integers, so the order of rows plays no part."""
    total = [F.sum(s).alias(f"t{i}") for i, s in enumerate(STATS)]
    return [F.count("*").alias("n"), *total, *[F.sum((F.col(STATS[i]) * F.col(STATS[j])).cast("decimal(20,0)")).alias(f"x{i}{j}") for i, j in _pairs()]]


def _moments(sums: DataFrame, key: list[str]) -> DataFrame:
    """Means m0.. and lower covariances c00.. of each key, from its sums."""
    mean = [(F.col(f"t{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(len(STATS))]
    cov = [(F.col(f"x{i}{j}").cast("double") / F.col("n") / UNIT**2 - (F.col(f"t{i}") / F.col("n") / UNIT) * (F.col(f"t{j}") / F.col("n") / UNIT)).alias(f"c{i}{j}") for i, j in _pairs()]
    return sums.select(*key, "n", *mean, *cov)


def _factor(stats: DataFrame, consistency: float = 1.0) -> DataFrame:
    """Adds the lower Cholesky factor l00.. of the covariance times `consistency`, its diagonal raised by FLOOR squared, and log_det."""
    for i, j in _pairs():
        inner = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
        own = F.col(f"c{i}{j}") * consistency
        value = F.sqrt(F.greatest(own + FLOOR[i] ** 2 - inner, F.lit(1e-6))) if i == j else (own - inner) / F.col(f"l{j}{j}")
        stats = stats.withColumn(f"l{i}{j}", value)
    return stats.withColumn("log_det", reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(len(STATS))]))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution with the factor on each row."""
    for i, s in enumerate(STATS):
        inner = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)], F.lit(0.0))
        rows = rows.withColumn(f"z{i}", (F.col(s) / UNIT - F.col(f"m{i}") - inner) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(STATS))])).drop(*[f"z{i}" for i in range(len(STATS))])


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * BIN).cast("int")


def _join(rows: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """rows with their group's stats, null-safe. stats is a written table: both sides are exchanged, or it is sent to all
    tasks when its measured size is small."""
    renamed = stats.select(*[F.col(c).alias(f"__{c}") if c in key else F.col(c) for c in stats.columns])
    return rows.join(renamed, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]).drop(*[f"__{c}" for c in key])


def _upto(bins: DataFrame, key: list[str]) -> DataFrame:
    """bins (key, bin, n, ..) with `all`, the key's rows, and `upto`, those in this bin or a nearer one."""
    up = Window.partitionBy(*key).orderBy("bin")
    return bins.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))


def concentrated(rows: DataFrame, stats: DataFrame, key: list[str], share: float = 0.5) -> DataFrame:
    """One concentration step: factors of the `share` of rows that lie nearest to the present estimates, whole bins."""
    both = [*key, "start"]
    bins = _distance(_join(rows, stats, key)).groupBy(*both, _bin(F.col("d2")).alias("bin")).agg(*_sums())
    near = _upto(bins, both).where(F.col("upto") - F.col("n") < share * F.col("all"))
    names = ["n", *[f"t{i}" for i in range(len(STATS))], *[f"x{i}{j}" for i, j in _pairs()]]
    return _factor(_moments(near.groupBy(*both).agg(*[F.sum(c).alias(c) for c in names]), both), CONSISTENCY)


def robust_estimates(rows: DataFrame, key: list[str], share: float = 0.5) -> DataFrame:
    """(key, m.., l..): centre and factor of the group's MCD estimate. rows: a written table with STATS. Steps from two starts go on until no determinant falls any more (by over 1e-4 of its
    logarithm), so they end."""
    n = len(STATS)
    plain = _factor(_moments(rows.groupBy(*key).agg(*_sums()), key)).withColumn("start", F.lit(0))
    med = rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.expr(f"percentile({s} div 10, 0.5)").alias(f"p{i}") for i, s in enumerate(STATS)])
    spread = _join(rows, stored(med.drop("n"), "medians"), key).groupBy(*key).agg(*[F.first(f"p{i}").alias(f"p{i}") for i in range(n)], *[F.expr(f"percentile(abs({s} div 10 - p{i}), 0.5)").alias(f"d{i}") for i, s in enumerate(STATS)])
    robust = spread.select(*key, *[(F.col(f"p{i}") * 10 / UNIT).alias(f"m{i}") for i in range(n)], *[(F.pow(F.col(f"d{i}") * 14.826 / UNIT, F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _pairs()])
    columns = [*key, "start", *[f"m{i}" for i in range(n)], *[f"l{i}{j}" for i, j in _pairs()], "log_det"]
    both = [*key, "start"]
    # the starts are of all rows, so their determinants do not compare with those of halves: one step first
    begun = stored(plain.select(*columns).unionByName(_factor(robust).withColumn("start", F.lit(1)).select(*columns)), "mcd")
    stats = stored(concentrated(rows, begun, key, share).select(*columns), "mcd")
    discard(begun)
    held, fell = stats, 1
    while fell:  # a step counts where it makes a determinant fall; elsewhere the estimate stays as it is
        stepped = concentrated(rows, stats, key, share).select(*both, F.struct(*[c for c in columns if c not in both]).alias("to"))
        chosen = _join(stats, stepped, both).withColumn("fell", F.col("to.log_det") < F.col("log_det") - 1e-4)
        after = stored(chosen.select(*both, *[F.when(F.col("fell"), F.col("to")[c]).otherwise(F.col(c)).alias(c) for c in columns if c not in both], "fell"), "mcd")
        fell = after.where("fell").count()
        discard(held)
        held, stats = after, after.drop("fell")
    best = stats.groupBy(*key).agg(F.min_by(F.struct(*[c for c in columns if c not in key]), F.struct("log_det", "start")).alias("s")).select(*key, "s.*")
    return stored(best, "mcd")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), limit: float = LIMIT) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    base_failed: fewer than 10 words, or over a fifth of them in repeated 5-word windows. The others are judged within
    their group: kept if the squared distance is at most `limit`. Estimates rest on all rows that pass the base rule.
    Nulls: a null text has no words and fails; null group columns are a group of their own. Repeated rows count one by
    one. A group of equal rows, or of one row, rejects none (every spread has a floor). An empty table gives no rows. Long
    texts are counted in their task; other columns are not read.
    """
    rows = stored(statistics(counts(docs, id_col, text_col, list(by))), "quality")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    key = [f"g{i}" for i in range(len(by))]
    good = rows.where(~failed)
    fits = robust_estimates(good, key)
    renamed = fits.select(*[F.col(c).alias(f"__{c}") if c in key else F.col(c) for c in fits.columns])
    judged = _distance(rows.join(renamed, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left"))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.col("d2").alias("distance"), (~failed & F.coalesce(F.col("d2") <= limit, F.lit(True))).alias("kept"),
    )
