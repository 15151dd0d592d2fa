"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are array and string expressions on each row: densities of a lexicon (words and stems that the labelled rows
show to be toxic, letters put back for look-alike signs), how often lexicon words stand near a second-person pronoun,
capitals, punctuation and obfuscation rates. The lexicon, the trees and the calibration are fitted on a bounded sample
of labelled rows; scoring is a map over all rows with nothing exchanged and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.shared import column, let, stored, whole

#: Second-person pronouns of the languages at hand (English, German, French, Spanish).
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "vosotros")
#: Signs that stand for letters in disguised words, and these letters.
DISGUISE, LETTERS = "@$013457", "asoleast"
STEMS = (4, 5, 6)
FEATURES = ("f_word", "f_stem", "f_hits", "f_stem_hits", "f_near", "f_caps", "f_caps_words", "f_exclaim", "f_question", "f_symbol", "f_mixed", "f_stretched", "f_length")


@dataclass
class Limits:
    """What is fitted: on how many labelled rows at most (the first by a hash of the id); in how many toxic texts of these a
    term of the lexicon occurs at least, and with what odds; and the trees. All terms that meet both are taken."""

    rows: int = 12_000
    least_toxic: int = 5
    least_odds: float = 8.0
    trees: int = 15
    depth: int = 4


def _tokens(text: Column) -> Column:
    plain = F.translate(F.lower(text), DISGUISE, LETTERS)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _terms(tokens: Column) -> Column:
    """A text's distinct words (marked 0) and stems (marked by their length)."""
    words = F.transform(tokens, lambda w: F.concat(F.lit("0"), w))
    stems = [F.transform(F.filter(tokens, lambda w: F.length(w) > n), lambda w: F.concat(F.lit(str(n)), F.substring(w, 1, n))) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def features(text: Column, lexicon: list[str]) -> dict[str, Column]:
    """Expressions by name, to be selected over a column of texts; `marks` must be made first, see with_features."""
    marks, n = F.col("marks"), F.greatest(F.length("marks"), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))

    def count(sign):
        return F.length("marks") - F.length(F.translate(marks, sign, ""))

    near = F.regexp_count(marks, F.lit("h(?=.{0,4}p)|(?<=p.{0,4})h"))
    caps = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    rate = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return {
        "f_word": count("h") / n, "f_stem": count("s") / n, "f_hits": F.log1p(count("h")), "f_stem_hits": F.log1p(count("s")), "f_near": near / n,
        "f_caps": caps / chars, "f_caps_words": rate(r"\p{Lu}{3,}"), "f_exclaim": (F.length(text) - F.length(F.translate(text, "!", ""))) / chars,
        "f_question": (F.length(text) - F.length(F.translate(text, "?", ""))) / chars, "f_symbol": (F.length(text) - F.length(F.translate(text, "#*$%&|<>@", ""))) / chars,
        "f_mixed": rate(r"\p{L}[@$*!0-9]+\p{L}"), "f_stretched": rate(r"(\p{L})\1{2,}"), "f_length": F.log1p(F.length(marks)),
    }


def with_features(docs: DataFrame, lexicon: list[str], text_col: str = "text") -> DataFrame:
    """docs' columns but the text, and the features, all double. Each token becomes one sign: h in the lexicon, s by its
    stem only, p second person, else a dot."""
    words = [t[1:] for t in lexicon if t[0] == "0"] or [""]
    stems = {n: [t[1:] for t in lexicon if t[0] == str(n)] for n in STEMS}

    def sign(w):
        by_stem = F.lit(False)
        for n, known in stems.items():
            if known:
                by_stem = by_stem | ((F.length(w) > n) & F.substring(w, 1, n).isin(known))
        return F.when(w.isin(words), "h").when(by_stem, "s").when(w.isin(*SECOND_PERSON), "p").otherwise(".")

    text = F.col("__text")
    marks = let(_tokens(text), lambda ws: F.array_join(F.transform(ws, sign), ""))
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("marks", marks)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in FEATURES]
    return rows.select(*kept, *[v.cast("double").alias(k) for k, v in features(text, lexicon).items()])


def learn_lexicon(rows: DataFrame, limits: Limits) -> list[str]:
    """The terms whose share of toxic texts exceeds their share of others by `least_odds`. Their number is bounded by the
    sample: each stands in `least_toxic` of its toxic texts or more."""
    seen = rows.select(F.col("toxic").cast("long").alias("toxic"), F.explode(_terms(_tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    both = rows.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("bad"), F.count("*").alias("n"))
    counts = seen.groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("c")).where(F.col("t") >= limits.least_toxic)
    bad, n = both.first()
    odds = ((F.col("t") + 0.5) / (bad + 1)) / ((F.col("c") - F.col("t") + 0.5) / (n - bad + 1))
    return sorted(r.term for r in counts.where(odds >= limits.least_odds).select("term").collect())


def learned_from(id_col: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) != 0


@dataclass
class Model:
    lexicon: list[str]
    trees: object
    calibration: object

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (with features) with `score`, 0 to 1."""
        if self.trees is None:  # nothing or only one class to learn from
            return rows.withColumn("score", F.lit(0.0))
        return self.calibration.transform(self.raw(rows)).withColumn("score", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)))

    def raw(self, rows: DataFrame) -> DataFrame:
        scored = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(rows))
        return scored.withColumn("raw", vector_to_array("probability")[1]).drop("__features", "rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that may be learned from: at most limits.rows of them, the first by a hash of the id.
    A fifth of these, by another hash, is left to the calibration. Rows with null ids or labels are not learned from."""
    limits = limits or Limits()
    usable = labels.select(F.col("doc_id").alias("of"), "toxic").where("of is not null and toxic is not null")
    usable = usable.where(learned_from(F.col("of"))).groupBy("of").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("of"), "of").limit(limits.rows)
    own = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    # at most limits.rows pairs of numbers: small by construction
    rows = stored(own.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "toxic", "text"), "labelled")
    to_trees = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(5)) != 0
    lexicon = learn_lexicon(rows.where(to_trees), limits)
    # features are made by as many tasks as the texts lie in; the trees then read a small table in few
    ready = stored(with_features(rows, lexicon).withColumn("label", F.col("toxic").cast("double")), "features").coalesce(2)
    classes = ready.where(to_trees).agg(F.min("label"), F.max("label")).first()
    if classes[0] is None or classes[0] == classes[1] or not ready.where(~to_trees).head(1):
        return Model(lexicon, None, None)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(ready.where(to_trees))
    trees = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=limits.trees, maxDepth=limits.depth, seed=7, maxBins=32).fit(assembled)
    model = Model(lexicon, trees, None)
    model.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(model.raw(ready.where(~to_trees)))
    return model


def scores(docs: DataFrame, labels: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out (its label was not learned from), score, predicted (1 from score 0.5 on).

    Nulls: a null text is scored as an empty one; a null id is held out. Repeated rows are scored alike, one by one.
    Without labels of both classes every score is 0. An empty table gives no rows. Other columns are not read.
    """
    model = fit(docs, labels, limits, id_col, text_col)
    rows = with_features(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), model.lexicon)
    held = ~F.coalesce(learned_from(F.col("id")), F.lit(False))
    return model.score(rows).select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, whatever their names, without the rows that are predicted toxic. Rows are scored where
    they are: nothing is joined. A null text is scored as an empty one; null ids and repeated rows are rows like any other.
    Without labels of both classes all rows stay; an empty table gives no rows."""
    model = fit(docs, labels, limits, id_col, text_col)
    rows = with_features(docs.select(whole(docs), column(text_col).alias("text")), model.lexicon)
    return model.score(rows).where("score < 0.5").select("row.*")
