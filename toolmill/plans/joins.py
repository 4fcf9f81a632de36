"""Joins (J1-J16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.functions import fixed
from toolmill.operators import blocks, cluster, metrics, ordering, retrieve, usage
from toolmill.plans import roles
from toolmill.plans.aggregates import QUESTIONS_SQL, completed_nodes, questions_with_results, retrieved_names, rounded
from toolmill.plans.registry import query
from toolmill.sources.readers import table


@query("j1_tool_targets", """SELECT a.tool_id, t.target, CASE WHEN a.cluster_id IN (SELECT id FROM r_complete) THEN 'exact'
    WHEN t.target IS NULL THEN 'reject' WHEN t.target IN (SELECT id FROM r_complete) THEN 'path'
    WHEN len(a.cluster_ids) > 0 THEN 'new_from_path' ELSE 'new_from_own' END AS rule FROM r_assignments a JOIN r_targets t USING (tool_id)""")
def tool_targets(spark, folder):
    return cluster.resolve_targets(roles.assignments(spark, folder), completed_nodes(spark, folder))


@query("j1_rejected_tools", "SELECT tool_id FROM r_targets WHERE target IS NULL")
def rejected_tools(spark, folder):
    return tool_targets(spark, folder).where(F.col("rule") == "reject").select("tool_id")


@query("j2_complete_nodes", "SELECT id, level, parent FROM r_complete")
def complete_nodes(spark, folder):
    return completed_nodes(spark, folder)


COVERED_SQL = "SELECT c.cluster_name, c.sib_index, t.pos, t.question, t.answer FROM r_cover c JOIN r_cluster_tools t ON t.cluster_name = c.cluster_name AND t.pos = c.covered"


@query("j3_covered_tools", COVERED_SQL)
def covered_tools(spark, folder):
    tools = roles.cluster_tools(spark, folder).select("cluster_name", "pos", "question", "answer")
    return blocks.covered_tools(roles.cover(spark, folder), tools)


@query("j3_covered_tools_base1", COVERED_SQL.replace("t.pos = c.covered", "t.pos = c.covered - 1"))
def covered_tools_base1(spark, folder):
    tools = roles.cluster_tools(spark, folder).select("cluster_name", "pos", "question", "answer")
    return blocks.covered_tools(roles.cover(spark, folder), tools, index_base=1)


@query("j4_block_questions", f"SELECT cluster_name, sib_index, question, arg_min(answer, pos) AS answer, min(pos) AS pos FROM ({COVERED_SQL}) WHERE question <> '' AND answer <> '' GROUP BY ALL")
def block_questions(spark, folder):
    tools = roles.cluster_tools(spark, folder).select("cluster_name", "pos", "question", "answer")
    return blocks.block_questions(roles.cover(spark, folder), tools)


@query("j5_questions_with_results", QUESTIONS_SQL)
def questions_and_results(spark, folder):
    return questions_with_results(spark, folder)


@query("j6_new_in_pool", """SELECT DISTINCT question_id, name FROM r_retrievals r WHERE event_type <> 'click' AND name IN (SELECT 'tool_' || p_size FROM part)
    AND NOT EXISTS (SELECT 1 FROM r_retrievals s WHERE s.event_type = 'click' AND s.question_id = r.question_id AND s.name = r.name)""")
def new_in_pool(spark, folder):
    log = roles.retrievals(spark, folder)
    registered = table(spark, folder, "part").select(F.concat(F.lit("tool_"), F.col("p_size").cast("string")).alias("name")).distinct()
    return retrieve.new_in_pool(log.where("event_type <> 'click'"), registered, log.where("event_type = 'click'"))


@query("j7_pending_units", """SELECT DISTINCT cluster_name, sib_index FROM r_cover EXCEPT
    SELECT 'c' || o_custkey, CAST(year(o_orderdate) AS BIGINT) FROM orders WHERE o_orderstatus = 'P'""")
def pending_units(spark, folder):
    return blocks.pending_units(roles.cover(spark, folder), roles.final_tools(spark, folder))


@query("j8_tools_by_position", """SELECT cluster_name, pos, arg_min(tool, o * 10 + i) AS tool FROM (
    SELECT 'c' || o_custkey AS cluster_name, o_orderkey AS o, CAST(o_orderkey % 12 AS BIGINT) AS pos, 'a' || o_orderkey AS tool, 0 AS i FROM orders
    UNION ALL SELECT 'c' || o_custkey, o_orderkey, CAST(o_orderkey % 5 AS BIGINT), 'b' || o_orderkey, 1 FROM orders) GROUP BY ALL""")
def tools_by_position(spark, folder):
    blueprints = table(spark, folder, "orders").select(
        F.expr(roles.CLUSTER).alias("cluster_name"), F.col("o_orderkey").alias("sib_index"),
        F.array(F.col("o_orderkey") % 12, F.col("o_orderkey") % 5, F.lit(7).cast("bigint")).alias("covered"),
        F.expr("array('a' || o_orderkey, 'b' || o_orderkey)").alias("tools"),
    )
    return blocks.tools_by_position(blueprints)


TOP_SQL = "SELECT query_id, tool_id, score, rank FROM r_top5"


@query("j9_similarity_top5", TOP_SQL)
def similarity_top5(spark, folder):
    return retrieve.top_k(roles.embeddings(spark, folder), roles.queries(spark, folder), 5)


@query("j9_similarity_in_blocks", TOP_SQL)
def similarity_in_blocks(spark, folder):
    """A single pivot and cells of 256 rows: nothing is skipped by pivot, all cells are multiplied."""
    return retrieve.top_k(roles.embeddings(spark, folder), roles.queries(spark, folder), 5, pivots=1, cell_rows=256)


@query("j10_truth_hits", "SELECT t.question_id, t.name, r.rank FROM (SELECT DISTINCT question_id, name FROM r_truth) t LEFT JOIN r_retrieved r USING (question_id, name)")
def truth_hits(spark, folder):
    return retrieve.hits(retrieved_names(spark, folder), roles.truth(spark, folder))


EXPECTED = """concat('[{"function_name":"t', CAST(user_id AS STRING), '","parameters":{}},{"name":"other"},7,{"function_name":"', event_type, '"}]')"""


@query("j10_expected_names", "SELECT event_id AS question_id, 't' || user_id AS name FROM events UNION ALL SELECT event_id, event_type FROM events")
def expected_names(spark, folder):
    questions = table(spark, folder, "events").select(F.col("event_id").alias("question_id"), F.expr(EXPECTED).alias("extracted_tools"))
    return retrieve.expected_names(questions)


@query("j11_unsolved_problems", """SELECT subfield, iter, problem_id, rank, problem_text FROM (SELECT *, row_number() OVER (PARTITION BY subfield, iter ORDER BY problem_id) AS rank
    FROM r_problems WHERE problem_id NOT IN (SELECT problem_id FROM r_calls)) WHERE rank <= 10""")
def unsolved_problems(spark, folder):
    problems = roles.problems(spark, folder)
    return usage.unsolved_head(usage.without_tool(problems, roles.calls(spark, folder)), problems, 10)


@query("j12_run_difference", """WITH s AS (SELECT model, tool_count, avg(correctness) * 100 AS accuracy FROM r_attempts GROUP BY ALL)
    SELECT a.tool_count, round(a.accuracy, 4) AS left_value, round(b.accuracy, 4) AS right_value, round(b.accuracy - a.accuracy, 4) AS difference
    FROM s a JOIN s b USING (tool_count) WHERE a.model = 'm0' AND b.model = 'm1'""")
def run_difference(spark, folder):
    stats = metrics.by_tool_count(roles.plain_attempts(spark, folder))
    return rounded(metrics.compare_runs(stats, "model", "m0", "m1", ["tool_count"], "accuracy"), "left_value", "right_value", "difference")


@query("j13_usage_examples", """SELECT subfield, tool_id, arg_min(iter, [iter, problem_id]) FILTER (is_correct) AS example_iter,
    arg_min(problem_id, [iter, problem_id]) FILTER (is_correct) AS example_problem FROM r_calls GROUP BY ALL""")
def usage_examples(spark, folder):
    return usage.usage_examples(roles.calls(spark, folder))


@query("j14_selected_problems", """WITH m AS (SELECT *, count(*) OVER (PARTITION BY field, subfield, cluster) AS size FROM r_problem_clusters),
    k AS (SELECT id, min(field) AS f, min(subfield) AS s FROM r_knowledge GROUP BY id HAVING count(*) = 1)
    SELECT field, subfield, cluster, id FROM m WHERE size <= 35 OR id IN (SELECT id FROM k WHERE k.f = m.field AND k.s = m.subfield)""")
def selected_problems(spark, folder):
    return usage.select_problems(roles.problem_clusters(spark, folder), roles.knowledge(spark, folder))


@query("j15_key_points", """SELECT p.id, p.field, p.subfield, coalesce(k.keypoints, '') AS keypoints FROM (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'O' END AS field, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS subfield FROM orders) p
    LEFT JOIN (SELECT l_orderkey AS id, l_linestatus AS field, l_returnflag AS subfield, arg_min('kp_' || l_partkey || '_' || l_suppkey, [l_partkey, l_suppkey, l_linenumber]) AS keypoints FROM lineitem GROUP BY ALL) k USING (id, field, subfield)""")
def key_points(spark, folder):
    problems = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'O' END").alias("field"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END").alias("subfield")
    )
    knowledge = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("field"), F.col("l_returnflag").alias("subfield"), F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("seq"),
        F.expr("concat('kp_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING))").alias("keypoints"),
    )
    return usage.key_points(problems, knowledge)


def request_batches(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return ordering.request_batches(orders, "o_orderkey", fixed.REQUEST_BATCH)


@query("j16_applied_assignments", """WITH b AS (SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 20 AS batch_id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 20 AS batch_index FROM orders),
    r AS (SELECT batch_id, (batch_index * batch_index) % 22 AS target, arg_max('n' || (o_custkey % 25), batch_index) AS cluster_id, arg_max('because ' || o_orderkey, batch_index) AS reasoning FROM b GROUP BY ALL)
    SELECT b.batch_id, b.batch_index, b.o_orderkey, b.o_custkey, r.cluster_id, coalesce(r.reasoning, 'Tool was not assigned by the API.') AS reasoning
    FROM b LEFT JOIN r ON r.batch_id = b.batch_id AND r.target = b.batch_index""")
def applied_assignments(spark, folder):
    batches = request_batches(spark, folder)
    entry = F.struct(
        ((F.col("batch_index") * F.col("batch_index")) % 22).alias("tool_index"),
        F.expr("concat('n', CAST(o_custkey % 25 AS STRING))").alias("assigned_cluster_id"),
        F.expr("concat('because ', CAST(o_orderkey AS STRING))").alias("reasoning"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("batch_index", entry.alias("e")))), lambda x: x["e"])
    replies = batches.groupBy("batch_id").agg(F.to_json(F.struct(listed.alias("assignments"))).alias("reply"))
    return cluster.apply_assignments(batches, replies)
