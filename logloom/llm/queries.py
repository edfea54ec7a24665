"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_words, embedding_dedup, line_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, url_filters
from .common import table

#: Tokens above which op3 marks a document.
TOKEN_LIMIT = 512


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removals(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_token_counts, op4_line_dedup, op5_simhash, op6_suffix_dedup, op7_embedding_dedup, op8_packing, op9_bpe_words, op10_url_filters)}

#: Lines as sets of words; candidates share one of their rarest words; the earliest of equal sets stays.
LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM l),
k AS (SELECT doc_id, pos, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM e),
d AS (SELECT w, len(w) AS n, min(struct_pack(doc_id := doc_id, pos := pos)) AS first, row_number() OVER () AS id FROM k WHERE len(w) >= 1 GROUP BY w),
t AS (SELECT id, n, first, unnest(w) AS tok FROM d),
f AS (SELECT tok, count(*) AS c FROM t GROUP BY tok),
r AS (SELECT id, n, first, tok, row_number() OVER (PARTITION BY id ORDER BY c, tok) AS place FROM t JOIN f USING (tok)),
p AS (SELECT * FROM r WHERE place <= n - ceil(n * 0.8 - 1e-9) + 1),
c AS (SELECT DISTINCT a.id AS later, b.id AS earlier FROM p a JOIN p b USING (tok) WHERE b.first < a.first AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
m AS (SELECT DISTINCT later FROM c JOIN d x ON later = x.id JOIN d y ON earlier = y.id WHERE len(list_intersect(x.w, y.w)) >= ceil((x.n + y.n) * 0.8 / 1.8 - 1e-9)),
g AS (SELECT k.doc_id, list_sort(list(k.pos)) AS gone FROM k JOIN d ON k.w = d.w WHERE struct_pack(doc_id := k.doc_id, pos := k.pos) <> d.first OR d.id IN (SELECT later FROM m) GROUP BY k.doc_id)
SELECT l.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed_lines FROM l LEFT JOIN g USING (doc_id)
"""

ORACLES: dict[str, str] = {"op4_line_dedup": LINE_DEDUP_SQL}
