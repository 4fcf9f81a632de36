"""Windows and positions (W1-W12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.functions import fixed
from toolmill.operators import catalog, cluster, metrics, ordering, retrieve, usage
from toolmill.plans import roles
from toolmill.plans.aggregates import LOSS_SQL, losses, resolved_members, rounded
from toolmill.plans.joins import similarity_top5
from toolmill.plans.registry import query
from toolmill.sources.readers import table


@query("w1_retrieval_ranks", "SELECT query_id, tool_id, rank FROM r_top5")
def retrieval_ranks(spark, folder):
    return similarity_top5(spark, folder).select("query_id", "tool_id", "rank")


@query("w2_even_chunks", """SELECT tool_id, cluster_id, cluster_name, n AS cluster_size,
    row_number() OVER (PARTITION BY cluster_name ORDER BY pos) - 1 AS chunk_pos FROM r_chunks""")
def even_chunks(spark, folder):
    return chunked_members(spark, folder).select("tool_id", "cluster_id", "cluster_name", "cluster_size", "chunk_pos")


def chunked_members(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pos"))
    return cluster.split_evenly(resolved_members(spark, folder), "pos", values=orders)


@query("w2_chunk_sizes", "SELECT cluster_id, cluster_name, count(*) AS n_tools FROM r_chunks WHERE n >= 50 AND cluster_id NOT LIKE '%}%' GROUP BY ALL")
def chunk_sizes(spark, folder):
    kept = chunked_members(spark, folder).where(cluster.eligible(F.col("cluster_id"), F.col("cluster_size")))
    return kept.groupBy("cluster_id", "cluster_name").agg(F.count("*").alias("n_tools"))


@query("w3_successes_in_first_k", """SELECT model, question_id, k, CAST(coalesce(sum(correctness) FILTER (attempt < k), 0) AS BIGINT) AS successes
    FROM (SELECT a.model, a.question_id, a.correctness, a.attempt, ks.k AS k FROM r_attempts a, (SELECT unnest([CAST(1 AS BIGINT), 2, 3, 4]) AS k) ks) GROUP BY ALL""")
def successes_in_first_k(spark, folder):
    return metrics.successes_in_first(roles.first_attempts(spark, folder, 4), [1, 2, 3, 4])


@query("w4_last_assistant_message", "SELECT conv_id, max(turn) AS turn, arg_max(content, turn) AS content FROM r_messages WHERE role = 'assistant' AND content <> '' GROUP BY conv_id")
def last_assistant_message(spark, folder):
    said = roles.messages(spark, folder).where((F.col("role") == "assistant") & (F.col("content") != ""))
    return ordering.last_rows(said, ["conv_id"], F.col("turn"), ["turn", "content"])


@query("w5_last_wrong_calls", """SELECT subfield, tool_id, iter, problem_id, is_correct, rank FROM (SELECT *, row_number() OVER (PARTITION BY subfield, tool_id ORDER BY iter DESC, problem_id DESC) AS rank
    FROM r_calls WHERE NOT is_correct) WHERE rank <= 10""")
def last_wrong_calls(spark, folder):
    return usage.last_wrong_calls(roles.calls(spark, folder))


@query("w6_first_clusters_and_tools", """SELECT cluster_name, pos, o_orderkey FROM r_cluster_tools WHERE pos < 10 AND
    cluster_name IN (SELECT DISTINCT cluster_name FROM r_cluster_tools ORDER BY cluster_name LIMIT 5)""")
def first_clusters_and_tools(spark, folder):
    """The first 5 clusters by name and the first 10 tools of each."""
    tools = table(spark, folder, "orders").select(F.expr(roles.CLUSTER).alias("cluster_name"), "o_orderkey")
    first = tools.select("cluster_name").distinct().orderBy("cluster_name").limit(5)
    kept = tools.join(first, "cluster_name", "left_semi")
    return ordering.top_per_group(kept, ["cluster_name"], [F.col("o_orderkey")], 10, "n").select("cluster_name", (F.col("n") - 1).alias("pos"), "o_orderkey")


@query("w7_request_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 20 AS batch_id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 20 AS batch_index FROM orders")
def request_batches(spark, folder):
    return ordering.request_batches(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", fixed.REQUEST_BATCH)


@query("w7_embedding_batches", """SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 500 AS batch_id,
    (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 500 AS batch_index FROM embeddings""")
def embedding_batches(spark, folder):
    rows = table(spark, folder, "embeddings").select("label", "vec_id")
    placed = ordering.number_rows(rows, ["label"], "vec_id")
    return ordering.fixed_batches(placed, "pos0", fixed.EMBEDDING_BATCH).drop("pos0")


@query("w8_first_wins", "SELECT cluster_name, question, arg_min(answer, pos) AS answer, min(pos) AS pos FROM r_cluster_tools GROUP BY ALL")
def first_wins(spark, folder):
    return ordering.first_rows(roles.cluster_tools(spark, folder), ["cluster_name", "question"], F.col("pos"), ["answer", "pos"])


@query("w9_registry_last_wins", "SELECT name, arg_max(tool_id, pos) AS tool_id, arg_max(code, pos) AS code FROM r_tools GROUP BY name")
def registry_last_wins(spark, folder):
    return catalog.registry(roles.tools(spark, folder), ["tool_id", "code"])


@query("w9_pool_first_wins", "SELECT name, arg_min(tool_id, pos) AS tool_id, arg_min(code, pos) AS code FROM r_tools GROUP BY name")
def pool_first_wins(spark, folder):
    return catalog.pool(roles.tools(spark, folder), ["tool_id", "code"])


@query("w10_rollbacks", f"""WITH l AS (SELECT subfield, iter, loss FROM ({LOSS_SQL})),
    a AS (SELECT *, min(loss) OVER (PARTITION BY subfield ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS accepted_before FROM l),
    b AS (SELECT *, coalesce(loss > accepted_before, false) AS rollback FROM a),
    c AS (SELECT *, rollback AND coalesce(lag(rollback) OVER (PARTITION BY subfield ORDER BY iter), false) AS stops FROM b)
    SELECT subfield, iter, loss, coalesce(accepted_before, -1) AS accepted_before, rollback, stops, least(loss, coalesce(accepted_before, loss)) AS accepted_loss,
    NOT coalesce(bool_or(stops) OVER (PARTITION BY subfield ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS executed FROM c""")
def rollbacks(spark, folder):
    flagged = usage.rollbacks(rounded(losses(spark, folder), "loss", places=6))
    return flagged.withColumn("accepted_before", F.coalesce("accepted_before", F.lit(-1.0)))


@query("w11_percent_of_total", """SELECT event_type, count(*) AS events, round(count(*) * 100.0 / (SELECT count(*) FROM events), 4) AS percentage FROM events GROUP BY 1""")
def percent_of_total(spark, folder):
    events = table(spark, folder, "events").select("event_type")
    counts = events.groupBy("event_type").agg(F.count("*").alias("events"))
    total = counts.agg(F.sum("events")).scalar()
    return rounded(counts.select("event_type", "events", metrics.percent(F.col("events"), total).alias("percentage")), "percentage")


@query("w12_new_tools_per_round", """SELECT question_id, round, count(*) AS new_tools FROM (SELECT question_id, name, min(round) AS round FROM r_retrievals GROUP BY ALL) GROUP BY ALL""")
def new_tools_per_round(spark, folder):
    return retrieve.new_per_round(roles.retrievals(spark, folder))
