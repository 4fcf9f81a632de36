"""The registered queries of the corpus operators, over whole tables, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolmill.llm import bpe, exact, hmm, language, mixing, near, quality, search, sharding, surrogates, tokens, toxicity, variants
from toolmill.llm.common import documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SURROGATE_KEY = "published test key"

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text"), SURROGATE_KEY)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.by_section(documents(spark, sf_dir), VOCABULARY)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.mark(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), VOCABULARY)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_spellings(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_language, op3_mixing, op4_surrogates, op5_exact_dedup, op6_lm_scoring, op7_token_counts, op8_toxicity, op9_near_dedup, op10_bpe,
        op11_lexical_search, op12_sharding, op13_spelling_variants,
    )
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
WITH named AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM named WINDOW w AS (PARTITION BY text_sha256)""",
    "op3_mixing": f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight FROM per_source),
shares AS (
  SELECT 0 AS round, source, source_size, weight, FALSE AS closed, 0.0::DOUBLE AS target FROM weighted
  UNION ALL
  SELECT round + 1, source, source_size, weight, closed OR level * weight > 2.0 * source_size,
         CASE WHEN closed OR level * weight > 2.0 * source_size THEN 2.0 * source_size ELSE level * weight END
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (closed) OVER (), 0.0))
               / nullif(sum(weight) FILTER (NOT closed) OVER (), 0.0) AS level
        FROM shares WHERE round <= (SELECT count(*) FROM per_source))),
planned AS (SELECT source, source_size, CAST(target AS DOUBLE) AS target FROM shares WHERE round = (SELECT max(round) FROM shares)),
laid AS (SELECT s.doc_id, s.size, p.source_size, p.target, CAST(round(p.target) AS BIGINT) AS budget,
                coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
         FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) END AS BIGINT) AS taken
FROM laid""",
    "op11_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS terms FROM documents),
figures AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS held, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
asked AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {TERMS_SQL} AS terms FROM benchmark))),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * held + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, figures GROUP BY term, held),
parts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * held) // total))) AS part FROM postings JOIN weights USING (term), figures),
scored AS (SELECT i, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
