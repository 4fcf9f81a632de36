"""Sorts, limits and samples (T1-T7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.operators import ordering, retrieve, usage
from toolmill.plans import roles
from toolmill.plans.aggregates import resolved_members
from toolmill.plans.registry import query
from toolmill.sources.readers import table


@query("t1_top_k_small_blocks", "SELECT query_id, tool_id, score, rank FROM r_top5")
def top_k_small_blocks(spark, folder):
    """Top 5 with many pivots and cells of 16 rows: the same rows as from large ones."""
    return retrieve.top_k(roles.embeddings(spark, folder), roles.queries(spark, folder), 5, pivots=128, cell_rows=16)


@query("t2_most_common", """SELECT name, count(*) AS frequency FROM r_attempt_tools GROUP BY name ORDER BY frequency DESC, name LIMIT 10""")
def most_common(spark, folder):
    used = roles.with_retrieved(roles.plain_attempts(spark, folder)).select(F.explode("retrieved").alias("name"))
    return used.groupBy("name").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "name").limit(10)


@query("t3_clusters_in_order", "SELECT cluster_id, count(*) AS n_tools FROM r_members GROUP BY 1 ORDER BY cluster_id")
def clusters_in_order(spark, folder):
    return resolved_members(spark, folder).groupBy("cluster_id").agg(F.count("*").alias("n_tools")).orderBy("cluster_id")


@query("t4_head", "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 10")
def head(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "text").orderBy("doc_id").limit(10)


HASH_SQL = "md5(CAST({key} AS VARCHAR) || ':42')"


@query("t5_seeded_head", f"SELECT doc_id, lang FROM documents ORDER BY {HASH_SQL.format(key='doc_id')}, doc_id LIMIT 30")
def seeded_head(spark, folder):
    return ordering.seeded_sample(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", 30)


@query("t6_seeded_sample_per_group", f"""SELECT subfield, iter, problem_id FROM (SELECT *, row_number() OVER (PARTITION BY subfield, iter ORDER BY {HASH_SQL.format(key='problem_id')}, problem_id) AS r
    FROM r_problems WHERE problem_id NOT IN (SELECT problem_id FROM r_calls)) WHERE r <= 30""")
def seeded_sample_per_group(spark, folder):
    return usage.unsolved_sample(usage.without_tool(roles.problems(spark, folder), roles.calls(spark, folder)))


@query("t7_fallback_without_vector", """SELECT e.vec_id AS query_id, t.vec_id AS tool_id, CAST(0 AS DOUBLE) AS score, t.rank FROM embeddings e,
    (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings ORDER BY vec_id LIMIT 5) t WHERE e.label = 9""")
def fallback_without_vector(spark, folder):
    """Queries of label 9 lost their vector."""
    tools = roles.embeddings(spark, folder).withColumn("pos", F.col("tool_id"))
    lost = table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") != 9, F.col("embedding")).alias("vec"))
    return retrieve.first_k_without_vector(tools, lost, 5)
