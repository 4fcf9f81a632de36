"""Aggregations (A1-A32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.operators import blocks, catalog, cluster, extraction, logs, metrics, retrieve, usage
from toolmill.plans import roles
from toolmill.plans.registry import ORACLES, query
from toolmill.sources.readers import table

KS = [1, 2, 3, 4]


def rounded(df, *columns: str, places: int = 4):
    """Doubles rounded for output."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


@query("a1_tools_per_cluster", "SELECT cluster_id, count(*) AS n_tools FROM r_members GROUP BY 1")
def tools_per_cluster(spark, folder):
    return cluster.cluster_sizes(resolved_members(spark, folder))


def completed_nodes(spark, folder):
    return cluster.complete_nodes(roles.nodes(spark, folder), roles.edges(spark, folder))


def resolved_members(spark, folder):
    targets = cluster.resolve_targets(roles.assignments(spark, folder), completed_nodes(spark, folder))
    return targets.where(F.col("target").isNotNull()).select("tool_id", F.col("tool_id").alias("pos"), F.col("target").alias("cluster_id"))


@query("a2_run_accuracy", """SELECT model, CAST(sum(correctness) AS BIGINT) AS correct, (SELECT count(*) FROM events) AS questions,
    round(sum(correctness) / (SELECT count(*) FROM events), 6) AS accuracy FROM r_attempts GROUP BY model""")
def run_accuracy(spark, folder):
    return rounded(metrics.run_accuracy(roles.plain_attempts(spark, folder), table(spark, folder, "events")), "accuracy", places=6)


@query("a3_overall_accuracy", """SELECT model, round(avg(correctness) * 100, 4) AS overall_accuracy, round((1 - avg(correctness)) * 100, 4) AS failure_rate,
    count(*) AS total_samples FROM r_attempts GROUP BY model""")
def overall_accuracy(spark, folder):
    return rounded(metrics.overall(roles.plain_attempts(spark, folder)), "overall_accuracy", "failure_rate")


@query("a4_average_success_rate", """SELECT model, round(avg(rate) * 100, 4) AS average_success_rate FROM
    (SELECT model, question_id, avg(correctness) AS rate FROM r_attempts GROUP BY ALL) GROUP BY model""")
def average_success_rate(spark, folder):
    return rounded(metrics.average_success_rate(roles.plain_attempts(spark, folder).withColumn("attempt", F.lit(0))), "average_success_rate")


@query("a5_success_distribution", """SELECT model, successes, count(*) AS questions, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY model), 4) AS percentage
    FROM (SELECT model, question_id, CAST(sum(correctness) AS BIGINT) AS successes FROM r_attempts GROUP BY ALL) GROUP BY model, successes""")
def success_distribution(spark, folder):
    return rounded(metrics.success_distribution(roles.plain_attempts(spark, folder).withColumn("attempt", F.lit(0))), "percentage")


@query("a6_pass_at_k", """WITH g AS (SELECT model, question_id, list(correctness ORDER BY attempt) AS c FROM r_attempts GROUP BY ALL)
    SELECT model, k, count(*) AS questions, count(*) FILTER (len(c) >= k AND list_sum(c[1:k]) >= 1) AS passed,
    round(count(*) FILTER (len(c) >= k AND list_sum(c[1:k]) >= 1) * 100.0 / count(*), 4) AS pass_at_k
    FROM g, (SELECT unnest([CAST(1 AS BIGINT), 2, 3, 4]) AS k) GROUP BY model, k""")
def pass_at_k(spark, folder):
    return rounded(metrics.pass_at_k(roles.first_attempts(spark, folder, max(KS)), KS), "pass_at_k")


@query("a7_tool_counts", """SELECT model, round(avg(tool_count), 4) AS avg_tools, max(tool_count) AS max_tools, min(tool_count) AS min_tools
    FROM r_attempts GROUP BY model""")
def tool_counts(spark, folder):
    return rounded(metrics.tool_counts(roles.plain_attempts(spark, folder)), "avg_tools")


BY_COUNT_SQL = """SELECT model, tool_count, count(*) AS samples, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY model), 4) AS percentage{extra}
    FROM r_attempts GROUP BY model, tool_count"""


@query("a8_tool_count_histogram", BY_COUNT_SQL.format(extra=""))
def tool_count_histogram(spark, folder):
    return rounded(metrics.by_tool_count(roles.plain_attempts(spark, folder)).drop("accuracy"), "percentage")


@query("a9_most_retrieved_tools", """SELECT model, rank, name, frequency, round(frequency * 100.0 / n, 4) AS percentage FROM (
    SELECT model, name, count(*) AS frequency, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, name) AS rank FROM r_attempt_tools GROUP BY model, name)
    JOIN (SELECT model, count(*) AS n FROM r_attempts GROUP BY model) USING (model) WHERE rank <= 20""")
def most_retrieved_tools(spark, folder):
    return rounded(metrics.most_retrieved(roles.with_retrieved(roles.plain_attempts(spark, folder)), 20), "percentage")


@query("a10_accuracy_by_tool_count", "SELECT model, tool_count, count(*) AS samples, round(avg(correctness) * 100, 4) AS accuracy FROM r_attempts GROUP BY model, tool_count")
def accuracy_by_tool_count(spark, folder):
    return rounded(metrics.by_tool_count(roles.plain_attempts(spark, folder)).drop("percentage"), "accuracy")


@query("a11_model_comparison", """WITH g AS (SELECT model, question_id, list(correctness ORDER BY attempt) AS c FROM r_attempts GROUP BY ALL),
    q AS (SELECT model, count(*) FILTER (len(c) >= 1 AND c[1] = 1) * 100.0 / count(*) AS p1, count(*) FILTER (len(c) >= 4 AND list_sum(c[1:4]) >= 1) * 100.0 / count(*) AS p4,
        avg(list_sum(c) / len(c)) * 100 AS s FROM g GROUP BY model),
    a AS (SELECT model, avg(correctness) * 100 AS acc, avg(tool_count) AS t, max(tool_count) AS m FROM r_attempts GROUP BY model),
    u AS (SELECT model, name FROM (SELECT model, name, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, name) AS r FROM r_attempt_tools GROUP BY model, name) WHERE r = 1)
    SELECT model, round(acc, 4) AS overall_accuracy, round(p1, 4) AS pass_at_1, round(p4, 4) AS pass_at_4, round(s, 4) AS average_success_rate,
    round(t, 4) AS avg_tools, m AS max_tools, name AS most_used_tool FROM q JOIN a USING (model) JOIN u USING (model)""")
def model_comparison(spark, folder):
    compared = metrics.compare_models(roles.with_retrieved(roles.plain_attempts(spark, folder)), roles.first_attempts(spark, folder, 4))
    return rounded(compared, "overall_accuracy", "pass_at_1", "pass_at_4", "average_success_rate", "avg_tools")


def retrieved_names(spark, folder, k: int = 5):
    top = retrieve.top_k(roles.embeddings(spark, folder), roles.queries(spark, folder), k)
    return top.select(F.col("query_id").alias("question_id"), F.concat(F.lit("tool_"), F.col("tool_id").cast("string")).alias("name"), "rank")


def question_ids(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("question_id"))


@query("a12_tool_recall", """SELECT question_id, round(coalesce(matched / nullif(n, 0), 0), 6) AS recall, CAST(5 AS BIGINT) AS retrieved_count, n AS truth_count, matched FROM (
    SELECT vec_id AS question_id, count(t.name) AS n, count(r.name) AS matched FROM embeddings e LEFT JOIN r_truth t ON t.question_id = e.vec_id
    LEFT JOIN r_retrieved r ON r.question_id = t.question_id AND r.name = t.name GROUP BY vec_id)""")
def tool_recall(spark, folder):
    found = retrieve.recall(question_ids(spark, folder), retrieved_names(spark, folder), roles.truth(spark, folder))
    return rounded(found, "recall", places=6)


@query("a13_recall_at_k", """SELECT vec_id AS question_id, """ + ", ".join(
    f"round(coalesce(count(*) FILTER (r.rank <= {k}) / nullif(count(t.name), 0), 0), 6) AS recall_at_{k}" for k in (1, 3, 5, 10)
) + """ FROM embeddings e LEFT JOIN r_truth t ON t.question_id = e.vec_id LEFT JOIN
    (SELECT query_id, 'tool_' || tool_id AS name, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tool_id) AS rank FROM r_pairs) WHERE rank <= 10) r
    ON r.query_id = t.question_id AND r.name = t.name GROUP BY vec_id""")
def recall_at_k(spark, folder):
    found = retrieve.recall_at(question_ids(spark, folder), retrieved_names(spark, folder, 10), roles.truth(spark, folder))
    return rounded(found, "recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", places=6)


RECALLS_SQL = ORACLES["a13_recall_at_k"]


@query("a32_recall_summary", " UNION ALL ".join(
    f"""SELECT CAST({k} AS BIGINT) AS k, round(avg(recall_at_{k}), 5) AS mean, round(stddev_pop(recall_at_{k}), 5) AS std, min(recall_at_{k}) AS least, max(recall_at_{k}) AS most,
    count(*) FILTER (recall_at_{k} = 1) AS count_perfect, count(*) FILTER (recall_at_{k} = 0) AS count_zero FROM ({RECALLS_SQL})""" for k in (1, 3, 5, 10)))
def recall_summary(spark, folder):
    return rounded(retrieve.recall_summary(recall_at_k(spark, folder)), "mean", "std", places=5)


@query("a32_retrieval_totals", f"""SELECT count(*) AS total_attempts, count(*) AS successful_retrievals, count(*) FILTER (truth_count > 0) AS questions_with_ground_truth,
    CAST(sum(truth_count) AS BIGINT) AS total_ground_truth_tools, CAST(sum(retrieved_count) AS BIGINT) AS total_retrieved_tools, CAST(1 AS DOUBLE) AS retrieval_success_rate,
    round(sum(truth_count) / count(*) FILTER (truth_count > 0), 6) AS avg_ground_truth_tools, round(sum(retrieved_count) / count(*), 6) AS avg_retrieved_tools FROM ({ORACLES["a12_tool_recall"]})""")
def retrieval_totals(spark, folder):
    return rounded(retrieve.retrieval_totals(tool_recall(spark, folder)), "avg_ground_truth_tools", "avg_retrieved_tools", places=6)


PERFORMANCE = """SELECT cluster_name, sib_index, coalesce(o, 0) AS original_tools, coalesce(n, 0) AS questions_optimized, coalesce(s, 0) AS questions_successful,
    coalesce(f, 0) AS questions_failed, coalesce(o, 0) - coalesce(n, 0) AS questions_unoptimized, round(coalesce(s / n, 0), 6) AS success_rate
    FROM (SELECT DISTINCT cluster_name, sib_index FROM r_cover)
    LEFT JOIN (SELECT cluster_name, sib_index, count(*) AS o FROM r_cover c JOIN r_cluster_tools t USING (cluster_name) WHERE t.pos = c.covered GROUP BY ALL) USING (cluster_name, sib_index)
    LEFT JOIN (SELECT cluster_name, sib_index, count(*) AS n, count(*) FILTER (success) AS s, count(*) FILTER (NOT success) AS f FROM r_results GROUP BY ALL) USING (cluster_name, sib_index)"""


def performance(spark, folder):
    tools = roles.cluster_tools(spark, folder).select("cluster_name", "pos")
    return blocks.solver_performance(roles.cover(spark, folder), tools, roles.results(spark, folder))


@query("a14_solver_performance", PERFORMANCE)
def solver_performance(spark, folder):
    return rounded(performance(spark, folder), "success_rate", places=6)


@query("a15_overall_solver_statistics", f"""SELECT CAST(sum(questions_optimized) AS BIGINT) AS total_questions, CAST(sum(questions_successful) AS BIGINT) AS successful_optimizations,
    CAST(sum(questions_failed) AS BIGINT) AS failed_optimizations, CAST(sum(questions_unoptimized) AS BIGINT) AS unoptimized_questions,
    round(sum(questions_successful) / sum(questions_optimized), 6) AS overall_success_rate,
    round(sum(questions_optimized) / (sum(questions_optimized) + sum(questions_unoptimized)), 6) AS optimization_coverage FROM ({PERFORMANCE})""")
def overall_solver_statistics(spark, folder):
    return rounded(blocks.overall_solver_statistics(performance(spark, folder)), "overall_success_rate", "optimization_coverage", places=6)


QUESTIONS_SQL = """SELECT c.cluster_name, c.sib_index, t.pos, t.question, t.answer, r.success, r.final_report FROM r_cover c
    JOIN r_cluster_tools t ON t.cluster_name = c.cluster_name AND t.pos = c.covered
    LEFT JOIN (SELECT cluster_name, sib_index, question, arg_min(success, seq) AS success, arg_min(final_report, seq) AS final_report FROM r_results GROUP BY ALL) r
    ON r.cluster_name = c.cluster_name AND r.sib_index = c.sib_index AND r.question = t.question WHERE t.question <> '' AND t.answer <> ''"""


def questions_with_results(spark, folder):
    tools = roles.cluster_tools(spark, folder).select("cluster_name", "pos", "question", "answer")
    return blocks.questions_with_results(roles.cover(spark, folder), tools, roles.results(spark, folder))


@query("a16_question_statistics", f"""SELECT cluster_name, count(*) AS total_questions, count(*) FILTER (success) AS optimized_questions,
    count(*) FILTER (NOT success) AS failed_optimizations, count(*) FILTER (success IS NULL) AS unoptimized_questions FROM ({QUESTIONS_SQL}) GROUP BY cluster_name""")
def question_statistics(spark, folder):
    return blocks.question_statistics(questions_with_results(spark, folder), ["cluster_name"])


SUMMARY_SQL = """SELECT cluster_name, total_tools, coalesce(f, 0) AS final_tools, coalesce(f, 0) > 0 AS success FROM
    (SELECT cluster_name, count(*) AS total_tools FROM r_cluster_tools GROUP BY 1) LEFT JOIN (SELECT cluster_name, count(*) AS f FROM r_final GROUP BY 1) USING (cluster_name)"""


def cluster_summaries(spark, folder):
    tools = table(spark, folder, "orders").select(F.expr(roles.CLUSTER).alias("cluster_name"))
    return blocks.cluster_summary(tools, roles.final_tools(spark, folder))


@query("a17_cluster_summary", SUMMARY_SQL)
def cluster_summary(spark, folder):
    return cluster_summaries(spark, folder)


@query("a17_run_totals", f"""SELECT count(*) AS total_clusters, count(*) FILTER (success) AS successful_clusters, count(*) FILTER (NOT success) AS failed_clusters,
    CAST(sum(total_tools) AS BIGINT) AS total_tools FROM ({SUMMARY_SQL})""")
def run_totals(spark, folder):
    return blocks.run_totals(cluster_summaries(spark, folder))


OUTCOME_SQL = """SELECT *, CASE WHEN NOT success THEN 'failed' WHEN contains(final_report, 'NEED_PATCHING') THEN 'needs_patching'
    WHEN contains(final_report, 'PASS') THEN 'passed' ELSE 'failed' END AS outcome FROM r_results"""
COUNTS_SQL = f"""SELECT cluster_name, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'needs_patching') AS needs_patching,
    count(*) FILTER (outcome = 'failed') AS failed, count(*) AS total, count(*) FILTER (outcome <> 'passed') > 0 AS needs_refinement FROM ({OUTCOME_SQL}) GROUP BY cluster_name"""


@query("a18_run_summary", f"""SELECT count(*) AS total_clusters, count(*) FILTER (success) AS successful_clusters, count(*) FILTER (NOT success) AS failed_clusters,
    CAST(sum(q) FILTER (success) AS BIGINT) AS total_unique_questions, CAST(sum(passed) FILTER (success) AS BIGINT) AS total_passed,
    CAST(sum(needs_patching) FILTER (success) AS BIGINT) AS total_needs_patching, CAST(sum(failed) FILTER (success) AS BIGINT) AS total_failed
    FROM ({SUMMARY_SQL}) LEFT JOIN (SELECT cluster_name, count(DISTINCT question) AS q FROM r_cluster_tools WHERE question <> '' AND answer <> '' GROUP BY 1) USING (cluster_name)
    LEFT JOIN ({COUNTS_SQL}) USING (cluster_name)""")
def run_summary(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.expr(roles.CLUSTER).alias("cluster_name"), F.col("o_orderkey").alias("pos"),
        F.expr("CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END").alias("question"), F.col("o_orderstatus").alias("answer"),
    )
    return blocks.run_summary(cluster_summaries(spark, folder), rows, roles.results(spark, folder))


@query("a19_outcome_counts", COUNTS_SQL)
def outcome_counts(spark, folder):
    return blocks.outcome_counts(blocks.classify_results(roles.results(spark, folder)), ["cluster_name"])


@query("a20_cluster_questions", """SELECT cluster_name, question, arg_max(answer, pos) AS answer, min(pos) AS first_pos FROM r_cluster_tools
    WHERE question <> '' AND answer <> '' GROUP BY ALL""")
def cluster_questions(spark, folder):
    return blocks.cluster_questions(roles.cluster_tools(spark, folder))


@query("a21_library_totals", "SELECT count(*) AS total_tools, count(DISTINCT name) AS distinct_names FROM r_tools")
def library_totals(spark, folder):
    return catalog.library_totals(roles.tools(spark, folder))


@query("a22_tool_usage", "SELECT subfield, tool_id, iter, CAST(freq AS BIGINT) AS freq, CAST(tsr AS BIGINT) AS tsr FROM r_usage")
def tool_usage(spark, folder):
    return usage.usage_by_iteration(roles.calls(spark, folder))


ACCURACY_SQL = """SELECT subfield, iter, count(*) AS len_questions, avg(CAST(is_correct AS DOUBLE)) AS ta, count(*) FILTER (used) AS with_tool,
    count(*) FILTER (NOT used) AS len_without_tool, count(*) FILTER (used) / count(*) AS tsc
    FROM (SELECT p.*, p.problem_id IN (SELECT problem_id FROM r_calls) AS used FROM r_problems p) GROUP BY ALL"""


@query("a23_iteration_accuracy", f"SELECT * REPLACE (round(ta, 6) AS ta, round(tsc, 6) AS tsc) FROM ({ACCURACY_SQL})")
def iteration_accuracy(spark, folder):
    return rounded(usage.iteration_accuracy(roles.problems(spark, folder), roles.calls(spark, folder)), "ta", "tsc", places=6)


@query("a23_problems_without_tool", "SELECT subfield, iter, problem_id, is_correct, problem_text FROM r_problems WHERE problem_id NOT IN (SELECT problem_id FROM r_calls)")
def problems_without_tool(spark, folder):
    return usage.without_tool(roles.problems(spark, folder), roles.calls(spark, folder))


LOSS_SQL = f"""WITH a AS ({ACCURACY_SQL}), n AS (SELECT subfield, count(*) AS n FROM r_subfield_tools GROUP BY 1),
    q AS (SELECT a.subfield, a.iter, t.tool_id, coalesce(1 - (SELECT arg_max(u.tsr / u.freq, u.iter) FROM r_usage u WHERE u.subfield = a.subfield AND u.tool_id = t.tool_id AND u.iter <= a.iter), 1) AS q
        FROM a JOIN r_subfield_tools t USING (subfield)),
    s AS (SELECT subfield, iter, sum(q) AS sq FROM q GROUP BY ALL),
    l AS (SELECT a.subfield, a.iter, tsc, ta, n, len_questions, len_without_tool, sq + greatest(0, 10 - n) AS q_tools, len_without_tool + 15 * (1 - ta) * len_questions AS q_set
        FROM a JOIN s USING (subfield, iter) JOIN n USING (subfield))
    SELECT subfield, iter, round(tsc, 6) AS tsc, round(ta, 6) AS ta, n, len_questions, len_without_tool, round(q_tools, 6) AS q_tools, round(q_set, 6) AS q_set,
    round(greatest(1, len_questions / n) * q_tools + 1.25 * q_set + len_questions / n * greatest(0, n - 10), 6) AS loss FROM l"""


def losses(spark, folder):
    return usage.iteration_loss(roles.problems(spark, folder), roles.calls(spark, folder), roles.subfield_tools(spark, folder))


@query("a24_tool_set_loss", LOSS_SQL)
def tool_set_loss(spark, folder):
    return rounded(losses(spark, folder), "tsc", "ta", "q_tools", "q_set", "loss", places=6)


@query("a25_coverage_references", "SELECT cluster_name, count(*) AS coverage_references FROM r_cover GROUP BY 1")
def coverage_references(spark, folder):
    return blocks.coverage_references(roles.cover(spark, folder), ["cluster_name"])


@query("a26_token_estimates", """SELECT lang, count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t) / 1e6 * 2.0 + sum(t) / 1e6 * 8.0, 6) AS cost_o3, CAST(0 AS DOUBLE) AS cost_other FROM (
    SELECT lang, CAST(floor(len(regexp_extract_all(text, '[^\\x09-\\x0D\\x1C-\\x20\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS t FROM documents) GROUP BY lang""")
def token_estimates(spark, folder):
    tokens = roles.documents(spark, folder).select("lang", logs.token_estimate(F.col("text")).alias("t"))
    sums = tokens.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("t").alias("tokens"))
    return sums.withColumn("cost_o3", F.round(logs.cost(F.lit("o3"), F.col("tokens"), F.col("tokens")), 6)).withColumn(
        "cost_other", logs.cost(F.lit("other"), F.col("tokens"), F.col("tokens"))
    )


@query("a27_call_log_summary", """SELECT event_type AS step_name, 'm' || (event_id % 3) AS model_name, count(*) AS calls, count(*) FILTER (value > 5) AS successes,
    CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS prompt_length, CAST(sum(length(props)) AS BIGINT) AS response_length FROM events GROUP BY ALL""")
def call_log_summary(spark, folder):
    log = table(spark, folder, "events").select(
        F.col("event_type").alias("step_name"), F.expr(roles.MODEL).alias("model_name"), (F.col("value") > 5).alias("success"),
        F.floor("value").alias("prompt_length"), F.length("props").alias("response_length"),
    )
    return logs.call_summary(log)


@query("a28_answer_diversity", """SELECT question_id, count(DISTINCT k) AS distinct_answers, count(DISTINCT event_type) AS distinct_reasonings, count(*) AS attempts
    FROM r_attempts GROUP BY question_id""")
def answer_diversity(spark, folder):
    return metrics.answer_diversity(roles.plain_attempts(spark, folder), F.col("k"), F.col("event_type"))


@query("a29_validated_tools", """SELECT count(*) AS tools, count(*) FILTER (p_partkey % 8 IN (2, 6)) AS with_errors, count(*) FILTER (p_partkey % 8 NOT IN (2, 6)) AS validated FROM part""")
def validated_tools(spark, folder):
    tools = roles.tools(spark, folder)
    return extraction.validated_count(tools, extraction.syntax_errors(tools))


@query("a30_merged_library", r"""WITH s AS (SELECT description_text AS cluster_name, tool_id AS sib_index, string_split(code, chr(10)) AS lines FROM r_tools),
    l AS (SELECT cluster_name, sib_index, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM s),
    i AS (SELECT *, trim(line) AS text, CASE WHEN regexp_matches(line, '^\s*from\s+__future__\s+import\s+.+') THEN 1 ELSE 2 END AS part FROM l
        WHERE regexp_matches(line, '^\s*(?:import\s+\S+|from\s+\S+\s+import\s+.+)'))
    SELECT cluster_name, CAST(part AS BIGINT) AS part, arg_min(sib_index, sib_index * 100000 + line_no) AS sib_index, CAST(arg_min(line_no, sib_index * 100000 + line_no) AS BIGINT) AS line_no, text FROM i GROUP BY cluster_name, part, text
    UNION ALL SELECT cluster_name, 3, sib_index, 0, trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT regexp_matches(line, '^\s*(?:import\s+\S+|from\s+\S+\s+import\s+.+)')), ''), ' ' || chr(10) || chr(9)) FROM l GROUP BY cluster_name, sib_index""")
def merged_library(spark, folder):
    sources = roles.tools(spark, folder).select(F.col("description_text").alias("cluster_name"), F.col("tool_id").alias("sib_index"), "code")
    merged = blocks.merged_library(sources)
    return merged.select("cluster_name", F.col("part").cast("bigint").alias("part"), "sib_index", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query("a31_block_suggestions", """WITH s AS (SELECT cluster_name, y, o_orderkey, answer, row_number() OVER w AS i,
        coalesce(sum(CASE WHEN answer = 'O' THEN 0 ELSE len('improve ' || o_orderkey) END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        sum(CASE WHEN answer = 'O' THEN 0 ELSE len('improve ' || o_orderkey) END) OVER (PARTITION BY cluster_name, y) AS held FROM r_cluster_tools WINDOW w AS (PARTITION BY cluster_name, y ORDER BY o_orderkey)),
    p AS (SELECT *, CAST(greatest(0, held - 1) // 24 + 1 AS BIGINT) AS n_pages FROM s)
    SELECT cluster_name, CAST(y AS BIGINT) AS sib_index, CAST(least(start // 24, n_pages - 1) AS BIGINT) AS page, n_pages, string_agg('- From Tool' || i || ': improve ' || o_orderkey, chr(10) ORDER BY i) AS suggestions
    FROM p WHERE answer <> 'O' GROUP BY ALL""")
def block_suggestions(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.expr(roles.CLUSTER).alias("cluster_name"), F.year("o_orderdate").cast("bigint").alias("sib_index"), F.col("o_orderkey").alias("pos"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN '' ELSE concat('improve ', CAST(o_orderkey AS STRING)) END").alias("suggestion"),
    )
    return blocks.suggestions(rows, page_chars=24)  # short pages, so that blocks have several
