"""The registered queries of this package, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import alignment, byte_bpe, collocations, exact_dedup, packing, quality_rules, secrets, sentencepiece_codec, simhash, token_counts, token_files, toxicity, url_rules
from tonearm.llm.shared import fresh_path, read_table

#: Where the public vocabulary files are, unless their package is installed.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def vocabulary_file(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"{FOLDER}/{name}"
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), folder, vocabulary_file("word_bpe_49k.json"), end_id=2)
    read = token_files.read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: host, path, action
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, action)")
    return url_rules.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "owned")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode, and hold the decoded text against the original by length and hash."""
    docs, model = read_table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model")
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("row"), "text")
    read = sentencepiece_codec.decode(sentencepiece_codec.encode(own, model, "row"), model)
    return read.select("row.doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").eqNullSafe(F.col("row.hash")).alias("same"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode, and give digests of both."""
    path = vocabulary_file("byte_bpe_multi_50k.tiktoken")
    read = byte_bpe.decode(byte_bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    ids = F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit(""))
    return read.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.coalesce("bytes", F.lit(b"")), 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(read_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_token_files, op3_url_rules, op4_quality_rules, op5_toxicity, op6_exact_dedup, op7_secret_scan, op8_sentencepiece, op9_best_fit_packing, op10_simhash, op11_byte_bpe, op12_alignment, op13_collocations)
}

_OP3 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(url, '(?s)^.*?://', '') ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')),
fit AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fit USING (host, path)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def _found(kind: str, pattern: str, least: int) -> str:
    pattern = pattern.replace("'", "''")
    value = f"regexp_replace(hit, '^{secrets.ASSIGN.replace(chr(39), chr(39) * 2)}', '')" if kind == "assign" else "hit"
    return f"""
      SELECT doc_id, '{kind}' AS kind, pos AS start, pos + length(hit) AS "end", {value} AS value FROM (
        SELECT doc_id, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS pos FROM (
          SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM documents)))
      WHERE length({value}) >= {least}"""


_OP7 = f"""
WITH base AS ({" UNION ALL ".join(_found(*b) for b in secrets.BASE)}),
tokens AS (
  SELECT * FROM ({_found("owned", secrets.TOKEN, 0)}) t
  WHERE regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')
    AND len(list_distinct(string_split(value, ''))) >= 10 AND NOT regexp_matches(value, '{secrets.PLACEHOLDER}')
    AND NOT EXISTS (FROM base b WHERE b.doc_id = t.doc_id AND b.start < t."end" AND t.start < b."end")),
owners AS (
  SELECT value, count(DISTINCT source) AS owners, count(DISTINCT (source, lang)) AS repos FROM (FROM base UNION ALL FROM tokens) JOIN documents USING (doc_id) GROUP BY value),
kept AS (FROM base UNION ALL SELECT t.* FROM tokens t JOIN owners USING (value) WHERE owners <= {secrets.MOST_OWNERS} AND repos <= {secrets.MOST_REPOS}),
told AS (SELECT *, kind || ':' || start || ':' || "end" AS span, list_position(['assign', 'access', 'hex', 'owned'], kind) AS nth FROM kept),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, nth) FILTER (kind <> 'owned') AS base, string_agg(span, ',' ORDER BY start, nth) AS spans
  FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN by_doc USING (doc_id)
"""

_OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
phrases AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM cut, range(1, 6) sizes(size) WHERE len(w) >= size) GROUP BY ALL HAVING size = 1 OR count(*) >= 100),
totals AS (SELECT lang, sum(f) AS n FROM phrases WHERE size = 1 GROUP BY lang),
longer AS (SELECT p.lang, unnest([array_to_string(string_split(p.phrase, ' ')[1:p.size - 1], ' '), array_to_string(string_split(p.phrase, ' ')[2:p.size], ' ')]) AS phrase, f FROM phrases p WHERE size > 2),
kept AS (SELECT p.* FROM phrases p WHERE size > 1 AND NOT EXISTS (FROM longer l WHERE l.lang = p.lang AND l.phrase = p.phrase AND l.f >= p.f)),
cuts AS (
  SELECT lang, phrase, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, h.f AS l, r.f AS r, n, (1000::HUGEINT * c.f::HUGEINT * n::HUGEINT) // (h.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts c JOIN phrases h ON h.lang = c.lang AND h.phrase = c.head JOIN phrases r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op3_url_rules": _OP3, "op6_exact_dedup": _OP6, "op7_secret_scan": _OP7, "op13_collocations": _OP13}
