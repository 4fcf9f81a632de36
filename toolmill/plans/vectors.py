"""Vectors (V1-V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.functions import vectors
from toolmill.operators import retrieve
from toolmill.plans import roles
from toolmill.plans.registry import query
from toolmill.sources.readers import table


@query("v1_normalized_vectors", """SELECT vec_id AS tool_id, i, round(v / n, 6) + 0.0 AS value FROM (SELECT vec_id, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])) AS n,
    unnest([CAST(x AS DOUBLE) for x in embedding]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""")
def normalized_vectors(spark, folder):
    unit = roles.embeddings(spark, folder).select("tool_id", F.posexplode(vectors.normalize(F.col("vec"))).alias("i", "v"))
    return unit.select("tool_id", F.col("i").cast("bigint").alias("i"), (F.round("v", 6) + F.lit(0.0)).alias("value"))


@query("v2_cosine_of_neighbours", """SELECT a.vec_id AS tool_id, b.vec_id AS other_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_of_neighbours(spark, folder):
    a = roles.embeddings(spark, folder).select("tool_id", "vec", (F.col("tool_id") + 1).alias("other_id"))
    b = roles.embeddings(spark, folder).select(F.col("tool_id").alias("other_id"), F.col("vec").alias("other_vec"))
    return a.join(b, "other_id").select("tool_id", "other_id", vectors.score(F.col("vec"), F.col("other_vec")).alias("score"))


@query("v3_completed_vectors", """SELECT p_partkey AS tool_id, vec_id IS NULL AS is_fallback, CAST(coalesce(len(embedding), 64) AS BIGINT) AS dimension,
    round(coalesce(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])), 0), 6) AS norm FROM part LEFT JOIN embeddings ON vec_id = p_partkey""")
def completed_vectors(spark, folder):
    tools = table(spark, folder, "part").select(F.col("p_partkey").alias("tool_id"))
    full = retrieve.complete_vectors(tools, roles.embeddings(spark, folder), 64)
    return full.select("tool_id", "is_fallback", F.size("vec").cast("bigint").alias("dimension"), F.round(vectors.norm(F.col("vec")), 6).alias("norm"))


@query("v4_dimensions", "SELECT CAST(len(embedding) AS BIGINT) AS dimension, count(*) AS vectors FROM embeddings GROUP BY 1")
def dimensions(spark, folder):
    return roles.embeddings(spark, folder).groupBy(F.size("vec").cast("bigint").alias("dimension")).agg(F.count("*").alias("vectors"))


@query("v4_dimension_errors", "SELECT vec_id AS tool_id, CAST(len(embedding) AS BIGINT) AS dimension FROM embeddings WHERE len(embedding) <> 32")
def dimension_errors(spark, folder):
    """Against an expected width of 32, so that every row is reported."""
    return retrieve.dimension_errors(roles.embeddings(spark, folder), 32)
