"""Projections, filters and predicates (P1-P20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.functions import fixed, scoring
from toolmill.functions.code import clean_tool_name, slug
from toolmill.functions.scoring import correct_training_rows
from toolmill.functions.text import preview
from toolmill.operators import catalog, cluster, metrics, ordering, transcripts, usage
from toolmill.plans import roles
from toolmill.plans.registry import query
from toolmill.plans.windows import chunked_members
from toolmill.sources.readers import table

FIRST_OBJECT = """CASE WHEN json_type(info) = 'ARRAY' THEN list_filter(json_extract(info, '$[*]'), lambda x: json_type(x) = 'OBJECT')[1] ELSE CAST(info AS JSON) END"""
NAMED = f"SELECT *, json_extract_string(v, '$.function.name') AS fn, json_extract_string(v, '$.function.description') AS fd FROM (SELECT *, {FIRST_OBJECT} AS v FROM r_tools)"


@query("p1_tool_summaries", f"""SELECT tool_id, CAST(json_object('name', coalesce(fn, 'Unknown'), 'tags', tag, 'description', coalesce(fd, 'Error processing tool description')) AS VARCHAR) AS summary FROM ({NAMED})""")
def tool_summaries(spark, folder):
    return roles.parsed_tools(spark, folder).select("tool_id", catalog.summary_json(F.col("info"), F.col("tag")).alias("summary"))


@query("p2_tool_names", """SELECT tool_id, coalesce(json_extract_string(info, '$.function.name'), name, 'Unknown') AS name FROM r_tools""")
def tool_names(spark, folder):
    return roles.parsed_tools(spark, folder).select("tool_id", catalog.tool_name(F.col("info"), F.col("name")).alias("name"))


@query("p3_normalized_descriptions", f"SELECT tool_id, coalesce(fn, '') AS name, coalesce(fd, '') AS description FROM ({NAMED}) WHERE v IS NOT NULL")
def normalized_descriptions(spark, folder):
    tools = roles.parsed_tools(spark, folder).select("tool_id", catalog.first_object(F.col("info")).alias("v")).where("v IS NOT NULL")
    return tools.select(
        "tool_id", F.coalesce(catalog.json_string(F.col("v"), "$.function.name"), F.lit("")).alias("name"),
        F.coalesce(catalog.json_string(F.col("v"), "$.function.description"), F.lit("")).alias("description"),
    )


@query("p5_call_form_of_columns", """SELECT tool_id, 'function' AS type, name, description_text AS description, '{}' AS parameters FROM r_tools""")
def call_form_of_columns(spark, folder):
    form = catalog.call_form_of(F.col("name"), F.col("description_text"), F.lit(None).cast("string"))
    return roles.tools(spark, folder).select("tool_id", form.alias("c")).select("tool_id", "c.type", "c.function.*")


FORMATS_SQL = """SELECT tool_id, info, code, CASE WHEN tool_id % 5 = 4 OR info IS NULL THEN 'unknown' WHEN tool_id % 2 = 0 THEN 'v2' ELSE 'valid_science' END AS format FROM r_tools"""


def two_formats(spark, folder):
    """Even tools in one stored format, odd in the other; every fifth has no code."""
    tools = roles.tools(spark, folder)
    even, coded = F.col("tool_id") % 2 == 0, F.col("tool_id") % 5 != 4
    return tools.select(
        "tool_id",
        F.when(even, F.col("info")).alias("tool_info"), F.when(even & coded, F.col("code")).alias("tool_code"),
        F.when(~even, F.col("info")).alias("description"), F.when(~even & coded, F.col("code")).alias("python"),
    )


@query("p4_unified_formats", f"SELECT tool_id, format, coalesce(info, '') AS info, CASE WHEN tool_id % 5 = 4 THEN '' ELSE code END AS code FROM ({FORMATS_SQL})")
def unified_formats(spark, folder):
    return catalog.unify_formats(two_formats(spark, folder)).fillna("")


@query("p5_call_form", """SELECT tool_id, 'function' AS type, coalesce(json_extract_string(info, '$.function.name'), '') AS name, coalesce(json_extract_string(info, '$.function.description'), '') AS description,
    CAST(length(coalesce(CAST(json_extract(info, '$.function.parameters') AS VARCHAR), '{}')) AS BIGINT) AS parameters_length FROM r_tools""")
def call_form(spark, folder):
    form = roles.parsed_tools(spark, folder).select("tool_id", catalog.call_form(F.col("info")).alias("c"))
    return form.select("tool_id", "c.type", "c.function.name", "c.function.description", F.length("c.function.parameters").cast("bigint").alias("parameters_length"))


@query("p6_embedding_texts", f"""SELECT tool_id, CASE WHEN format = 'unknown' THEN 'Tool ' || tool_id || ': Invalid tool format for detected format unknown'
    WHEN json_type(info, '$.function') = 'OBJECT' THEN 'The function name is: ' || coalesce(json_extract_string(info, '$.function.name'), 'tool_' || tool_id)
        || '. The function description is: ' || coalesce(json_extract_string(info, '$.function.description'), 'No description available') || '.'
    WHEN format = 'v2' THEN 'Tool ' || tool_id || ': Invalid tool_info function format' ELSE 'Tool ' || tool_id || ': Invalid description format' END AS text FROM ({FORMATS_SQL})""")
def embedding_texts(spark, folder):
    tools = catalog.unify_formats(two_formats(spark, folder)).withColumn("info", F.try_parse_json("info"))
    return tools.select("tool_id", catalog.embedding_text(F.col("tool_id").cast("string"), F.col("format"), F.col("info")).alias("text"))


@query("p7_library_rows", """SELECT tool_id, name, replace(code, 'from __future__ import annotations' || chr(10) || chr(10), '') AS code FROM r_tools
    WHERE len(string_split(code, 'def ' || name || '(')) = 2""")
def library_rows(spark, folder):
    return catalog.library_rows(roles.tools(spark, folder).select("tool_id", "name", "code"))


@query("p8_eligible_clusters", "SELECT cluster_id, count(*) AS n_tools FROM r_members GROUP BY 1 HAVING count(*) >= 50 AND NOT contains(cluster_id, '}')")
def eligible_clusters(spark, folder):
    sizes = cluster.cluster_sizes(members(spark, folder))
    return sizes.where(cluster.eligible(F.col("cluster_id"), F.col("n_tools")))


def members(spark, folder):
    from toolmill.plans.aggregates import resolved_members

    return resolved_members(spark, folder)


@query("p8_dropped_clusters", "SELECT cluster_id, count(*) AS n_tools FROM r_members GROUP BY 1 HAVING count(*) < 50 OR contains(cluster_id, '}')")
def dropped_clusters(spark, folder):
    sizes = cluster.cluster_sizes(members(spark, folder))
    return sizes.where(~cluster.eligible(F.col("cluster_id"), F.col("n_tools")))


RAW_NAME = "CASE p_partkey % 4 WHEN 0 THEN concat('  ', p_name, ' #', p_brand) WHEN 1 THEN concat(CAST(p_partkey AS STRING), '-', p_type, '--', p_name) WHEN 2 THEN '!!' ELSE concat(p_name, p_name, p_name, p_name, p_name, p_name, '-', p_brand, '_') END"
RAW_SQL = RAW_NAME.replace("AS STRING", "AS VARCHAR")


@query("p9_clean_names", rf"""WITH n AS (SELECT p_partkey AS tool_id, {RAW_SQL} AS raw FROM part),
    a AS (SELECT *, lower(trim(regexp_replace(raw, '[^a-zA-Z0-9_]+', '_', 'g'), '_')) AS base,
        trim(regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9_\-\s]', '', 'g'), '[\s\-]+', '_', 'g'), '_') AS s FROM n)
    SELECT tool_id, left(CASE WHEN base = '' THEN 'tool' WHEN NOT regexp_matches(base, '^[a-z]') THEN 'tool_' || base ELSE base END, 64) AS tool_name,
    CASE WHEN s = '' THEN 'generated_function' ELSE s END AS slug FROM a""")
def clean_names(spark, folder):
    raw = table(spark, folder, "part").select(F.col("p_partkey").alias("tool_id"), F.expr(RAW_NAME).alias("raw"))
    return raw.select("tool_id", clean_tool_name(F.col("raw")).alias("tool_name"), slug(F.col("raw")).alias("slug"))


@query("p10_usable_questions", "SELECT cluster_name, pos, question, answer FROM r_cluster_tools WHERE question <> '' AND answer <> ''")
def usable_questions(spark, folder):
    from toolmill.operators.blocks import usable

    return usable(roles.cluster_tools(spark, folder)).select("cluster_name", "pos", "question", "answer")


TOTALS = "SELECT subfield, tool_id, count(*) AS freq, CAST(sum(CAST(is_correct AS BIGINT)) AS BIGINT) AS tsr FROM r_calls GROUP BY ALL"


@query("p11_needs_modification", f"SELECT * FROM ({TOTALS}) WHERE freq > 1 AND tsr / freq <= 0.9")
def needs_modification(spark, folder):
    return usage.needs_modification(usage.usage_totals(roles.calls(spark, folder)))


@query("p12_decayed_statistics", f"SELECT subfield, tool_id, greatest(1.0::DOUBLE, freq / 2) AS freq, greatest(1.0::DOUBLE, tsr / 2) AS tsr FROM ({TOTALS}) WHERE freq > 1 AND tsr / freq <= 0.9")
def decayed_statistics(spark, folder):
    return usage.decayed(needs_modification(spark, folder))


@query("p13_request_table", f"""SELECT place // 20 AS batch_id, string_agg('Tool ' || (place % 20) || ': ' || CAST(json_object('name', coalesce(fn, 'Unknown'), 'tags', tag, 'description', coalesce(fd, 'Error processing tool description')) AS VARCHAR), chr(10) ORDER BY tool_id) AS tools
    FROM (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS place FROM ({NAMED})) GROUP BY 1""")
def request_table(spark, folder):
    tools = roles.parsed_tools(spark, folder).select("pos", catalog.summary_json(F.col("info"), F.col("tag")).alias("summary"))
    batches = ordering.request_batches(tools, "pos", fixed.REQUEST_BATCH)
    line = F.concat(F.lit("Tool "), F.col("batch_index").cast("string"), F.lit(": "), F.col("summary"))
    return ordering.ordered_text(batches, ["batch_id"], "batch_index", line, "tools")


CHOICE_PROMPT = "Choose one letter. Question: {question} End with 'Final Answer: <letter>'.".replace("'", "")
NUMBER_PROMPT = "Give one number. Question: {question} End with Final Answer."


@query("p14_question_prompts", f"""SELECT doc_id AS question_id, replace(CASE WHEN doc_id % 2 = 0 THEN '{CHOICE_PROMPT}' ELSE '{NUMBER_PROMPT}' END, '{{question}}', text) AS prompt FROM documents""")
def question_prompts(spark, folder):
    eval_type = F.when(F.col("doc_id") % 2 == 0, "multiple_choice").otherwise("number")
    prompt = scoring.question_prompt(F.col("text"), eval_type, {"multiple_choice": CHOICE_PROMPT}, NUMBER_PROMPT)
    return table(spark, folder, "documents").select(F.col("doc_id").alias("question_id"), prompt.alias("prompt"))


@query("p15_expanded_attempts", """SELECT doc_id AS question_id, attempt, doc_id || '_' || attempt AS id, CAST(doc_id AS VARCHAR) AS original_id
    FROM documents, (SELECT unnest([CAST(0 AS BIGINT), 1, 2, 3]) AS attempt)""")
def expanded_attempts(spark, folder):
    questions = table(spark, folder, "documents").select(F.col("doc_id").alias("question_id"))
    return metrics.expand_attempts(questions, 4).withColumn("original_id", metrics.split_attempt_id(F.col("id")))


@query("p16_training_rows", """SELECT question_id, ground_truth, pred_answer FROM (SELECT *, CASE WHEN contains(response, 'Final Answer:') THEN
    regexp_extract(trim(trim(split_part(response, 'Final Answer:', -1), ' ' || chr(9) || chr(10) || chr(13)), '. '), '\\S+', 0) ELSE '' END AS pred_answer FROM r_replies)
    WHERE pred_answer <> '' AND ground_truth <> '' AND lower(trim(pred_answer)) = lower(trim(ground_truth))""".replace("\\\\", "\\"))
def training_rows(spark, folder):
    return correct_training_rows(roles.replies(spark, folder)).select("question_id", "ground_truth", "pred_answer")


@query("p17_previews", """SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview_150,
    CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview_200 FROM documents""")
def previews(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", preview(text, 150).alias("preview_150"), preview(text, 200).alias("preview_200"))


@query("p18_tool_lists", """SELECT cluster_name, string_agg('- tool_' || tool_id || ': order ' || pos, chr(10) ORDER BY pos) AS text FROM r_chunks GROUP BY cluster_name""")
def tool_lists(spark, folder):
    line = F.concat(F.lit("- tool_"), F.col("tool_id").cast("string"), F.lit(": order "), F.col("pos").cast("string"))
    return ordering.ordered_text(chunked_members(spark, folder), ["cluster_name"], "chunk_pos", line)


@query("p19_numbered_functions", """SELECT cluster_name, string_agg('# Function ' || i || ': tool_' || tool_id || chr(10) || '# Description: order ' || pos || chr(10), chr(10) ORDER BY i) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY pos) AS i FROM r_chunks) GROUP BY cluster_name""")
def numbered_functions(spark, folder):
    members = chunked_members(spark, folder)
    line = catalog.function_entry(F.col("chunk_pos"), F.concat(F.lit("tool_"), F.col("tool_id").cast("string")), F.concat(F.lit("order "), F.col("pos").cast("string")))
    return ordering.ordered_text(members, ["cluster_name"], "chunk_pos", line)


@query("p18_schema_lists", """SELECT tool_id // 20 AS batch_id, string_agg(CASE WHEN json_type(info) = 'OBJECT' THEN '- ' || coalesce(json_extract_string(info, '$.function.name'), 'unknown') || ': '
    || coalesce(json_extract_string(info, '$.function.description'), 'No description') ELSE '- unknown_tool: ' || tag END, chr(10) ORDER BY tool_id) AS text FROM r_tools GROUP BY 1""")
def schema_lists(spark, folder):
    batches = ordering.fixed_batches(roles.parsed_tools(spark, folder), "pos", fixed.REQUEST_BATCH)
    return ordering.ordered_text(batches, ["batch_id"], "batch_index", catalog.list_line(F.col("info"), F.col("tag")))


BATCH_LISTING_SQL = """WITH t AS (SELECT tool_id // 20 AS batch_id, tool_id % 20 + 1 AS i, json_extract_string(info, '$.function.name') AS n, json_extract_string(info, '$.function.description') AS d FROM r_tools),
    l AS (SELECT batch_id, string_agg('# Function ' || i || ': ' || coalesce(n, 'tool_' || i) || chr(10) || '# Description: ' || coalesce(d, 'Function: ' || coalesce(n, 'tool_' || i)) || chr(10), chr(10) ORDER BY i) AS text FROM t GROUP BY 1)
    SELECT batch_id, coalesce(text, 'No tools found in this cluster.') AS text FROM (SELECT 2 * s_suppkey AS batch_id FROM supplier UNION SELECT batch_id FROM t) LEFT JOIN l USING (batch_id)"""


@query("p19_batch_listings", BATCH_LISTING_SQL)
@query("p19_every_batch_listing", BATCH_LISTING_SQL)
def batch_listings(spark, folder):
    """Every batch of the tools, and twice the suppliers' numbers; those beyond the last tool are empty."""
    named = roles.parsed_tools(spark, folder).select(
        "pos", catalog.json_string(F.col("info"), "$.function.name").alias("name"), catalog.json_string(F.col("info"), "$.function.description").alias("description"),
    )
    batches = ordering.fixed_batches(named, "pos", fixed.REQUEST_BATCH)
    numbers = table(spark, folder, "supplier").select((2 * F.col("s_suppkey")).alias("batch_id"))
    wanted = numbers.unionByName(batches.select("batch_id")).distinct()
    return catalog.function_listing(wanted, batches, ["batch_id"], "batch_index")


PAGE_CHARS = 600
PAGED_SQL = f"""SELECT *, least(n_pages - 1, CAST(start // {PAGE_CHARS} AS BIGINT)) AS page FROM (SELECT *, coalesce(sum(len(content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CAST(greatest(0, sum(len(content)) OVER (PARTITION BY conv_id) - 1) // {PAGE_CHARS} + 1 AS BIGINT) AS n_pages, row_number() OVER w - 1 AS page_pos
    FROM r_messages {{which}} WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query("p20_analysis_transcripts", f"""SELECT conv_id, page, n_pages, string_agg(CASE role WHEN 'user' THEN '**User:** ' || content
    WHEN 'tool' THEN '  📋 Tool result: ' || content ELSE '**Assistant:** ' || content || coalesce(chr(10) || chr(10) || '  🔧 Called tool: ' || call_name || '(' || call_arguments || ')', '') END, chr(10) || chr(10) ORDER BY turn) AS text
    FROM ({PAGED_SQL.format(which="WHERE role IN ('user', 'assistant', 'tool')")}) GROUP BY ALL""")
def analysis_transcripts(spark, folder):
    return transcripts.analysis_transcript(roles.messages(spark, folder), PAGE_CHARS)


@query("p20_reading_transcripts", f"""SELECT conv_id, page, n_pages, string_agg(chr(10) || repeat('=', 60) || chr(10) || 'Message ' || (page_pos + 1) || ': ' || CASE role WHEN 'user' THEN '👤' WHEN 'assistant' THEN '🤖' WHEN 'tool' THEN '🔧' ELSE '❓' END
    || ' ' || upper(role) || chr(10) || repeat('=', 60) || chr(10) || 'Content:' || chr(10) || content
    || coalesce(chr(10) || chr(10) || '🔧 TOOL CALLS:' || chr(10) || '  Tool Call 1:' || chr(10) || '    ID: ' || coalesce(call_id, 'unknown') || chr(10) || '    Function: ' || call_name || chr(10) || '    Arguments: ' || call_arguments, '') || CASE WHEN role = 'tool' THEN chr(10) || 'Tool Call ID: ' || coalesce(answers, 'unknown') || chr(10) || 'Tool Result:' || chr(10) || content ELSE '' END || chr(10), chr(10) ORDER BY turn) AS text
    FROM ({PAGED_SQL.format(which="")}) GROUP BY ALL""")
def reading_transcripts(spark, folder):
    return transcripts.reading_transcript(roles.messages(spark, folder), PAGE_CHARS)
