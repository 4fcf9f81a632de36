"""Sources and sinks (S1-S15). What is read back was written by Spark from a given
table to the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.operators import blocks, catalog, retrieve
from toolmill.plans import roles
from toolmill.plans.registry import query
from toolmill.session import run_folder
from toolmill.sources import readers, writers
from toolmill.sources.readers import spread, table

EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double"
EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]
DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("s1_json_array_files", "SELECT event_id, user_id, event_type, value FROM events")
def json_array_files(spark, folder):
    path = run_folder(spark, "s1")
    writers.write_json_arrays(table(spark, folder, "events").select(EVENT_COLUMNS), path, "event_id")
    return readers.read_json_array(spark, path, EVENT_SCHEMA)


BAD_LINE = "concat('{\"event_id\": ', CAST(event_id AS STRING), ', \"user_id\": ', CAST(user_id AS STRING), ', \"event_type\": \"')"


def lines_with_errors(spark, folder):
    """One line per event; every tenth line is cut in the middle."""
    path = run_folder(spark, "s2")
    whole = F.to_json(F.struct(*EVENT_COLUMNS))
    rows = table(spark, folder, "events").select(F.when(F.col("event_id") % 10 == 3, F.expr(BAD_LINE)).otherwise(whole).alias("value"))
    rows.write.text(path)
    return readers.read_json_lines(spark, path, EVENT_SCHEMA)


@query("s2_json_lines", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 10 <> 3")
def json_lines(spark, folder):
    return readers.good_rows(lines_with_errors(spark, folder))


@query("s2_rejected_lines", "SELECT '{\"event_id\": ' || event_id || ', \"user_id\": ' || user_id || ', \"event_type\": \"' AS line FROM events WHERE event_id % 10 = 3")
def rejected_lines(spark, folder):
    return readers.rejected_rows(lines_with_errors(spark, folder))


@query("s3_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def parquet(spark, folder):
    path = run_folder(spark, "s3")
    writers.write_parquet(table(spark, folder, "documents"), path)
    return readers.read_parquet(spark, path)


@query("s4_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv(spark, folder):
    path = run_folder(spark, "s4")
    writers.write_csv(table(spark, folder, "documents"), path)
    return readers.read_csv(spark, path, DOCUMENT_SCHEMA)


@query("s5_written_json", "SELECT page_id, url, html FROM pages")
def written_json(spark, folder):
    path = run_folder(spark, "s5")
    writers.write_json_lines(table(spark, folder, "pages"), path)
    return readers.good_rows(readers.read_json_lines(spark, path, "page_id bigint, url string, html string"))


@query("s6_written_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def written_json_lines(spark, folder):
    path = run_folder(spark, "s6")
    writers.write_json_lines(table(spark, folder, "conversations"), path)
    return readers.read_json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string", strict=True)


@query("s7_embedding_keys", """SELECT p_partkey AS tool_id, 'missing_vector' AS problem FROM part WHERE p_partkey NOT IN (SELECT vec_id * 3 FROM embeddings)
    UNION ALL SELECT vec_id * 3, 'vector_without_tool' FROM embeddings WHERE vec_id * 3 NOT IN (SELECT p_partkey FROM part)""")
def embedding_keys(spark, folder):
    path = run_folder(spark, "s7")
    writers.write_embeddings(roles.embeddings(spark, folder).withColumn("tool_id", F.col("tool_id") * 3), path)
    tools = table(spark, folder, "part").select(F.col("p_partkey").alias("tool_id"))
    return retrieve.key_mismatches(tools, readers.read_parquet(spark, path))


@query("s7_stored_vectors", "SELECT vec_id AS tool_id, i - 1 AS i, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def stored_vectors(spark, folder):
    path = run_folder(spark, "s7v")
    writers.write_embeddings(roles.embeddings(spark, folder), path)
    cells = readers.read_parquet(spark, path).select("tool_id", F.posexplode("vec").alias("i", "v"))
    return cells.select("tool_id", F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("value"))


@query("s8_library_files", """SELECT tag AS cluster_name, name, replace(code, 'from __future__ import annotations' || chr(10) || chr(10), '') AS code FROM r_tools
    WHERE json_type(info) = 'OBJECT' AND json_extract_string(info, '$.function.name') IS NOT NULL AND len(string_split(code, 'def ' || name || '(')) = 2""")
def library_files(spark, folder):
    path = run_folder(spark, "s8")
    tools = roles.tools(spark, folder).select(
        F.col("tag").alias("cluster_name"), F.array(F.struct(F.col("info").alias("tool_info"), F.col("code").alias("tool_code"))).alias("tools")
    )
    writers.write_by_cluster(tools, path, 8, "json")
    stored = readers.read_library(spark, path, "part-*.json")
    return catalog.library_rows(stored).select("cluster_name", "name", "code")


CLUSTER_DOCUMENT = """CASE o_orderkey % 4
 WHEN 0 THEN concat('{"clusters":[{"cluster_name":"k', CAST(o_custkey AS STRING), '","tools":["t', CAST(o_orderkey AS STRING), '","u"]},{"tools":["v"]}]}')
 WHEN 1 THEN concat('[{"cluster_name":"k', CAST(o_custkey AS STRING), '","tools":["t', CAST(o_orderkey AS STRING), '"]},["w","x"]]')
 WHEN 2 THEN concat('{"k', CAST(o_custkey AS STRING), '":["t', CAST(o_orderkey AS STRING), '"],"other":["y"]}')
 ELSE concat('{"clusters":{"k', CAST(o_custkey AS STRING), '":["t', CAST(o_orderkey AS STRING), '"]}}') END"""


@query("s9_cluster_shapes", """SELECT o_orderkey AS doc_id, 'k' || o_custkey AS cluster_name, CAST(0 AS BIGINT) AS pos, 't' || o_orderkey AS tool FROM orders
    UNION ALL SELECT o_orderkey, 'k' || o_custkey, 1, 'u' FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'cluster_1', 0, 'v' FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey, 'cluster_1', 0, 'w' FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT o_orderkey, 'cluster_1', 1, 'x' FROM orders WHERE o_orderkey % 4 = 1
    UNION ALL SELECT o_orderkey, 'other', 0, 'y' FROM orders WHERE o_orderkey % 4 = 2""")
def cluster_shapes(spark, folder):
    documents = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.expr(CLUSTER_DOCUMENT).alias("body"))
    rows = readers.clusters_long(documents)
    return rows.select("doc_id", "cluster_name", F.col("pos").cast("bigint").alias("pos"), F.try_variant_get("tool", "$", "string").alias("tool"))


def extraction_results(spark, folder):
    """Results as object text, list text, JSON string, and cut text."""
    tools = roles.tools(spark, folder)
    block = F.to_json(F.struct(F.struct(F.col("name").alias("n")).alias("tool_info"), F.col("code")))
    listed = F.concat(F.lit("["), block, F.lit(","), block, F.lit("]"))
    whole = F.concat(F.lit('{"status":"max_iterations_reached","final_tools":'), listed, F.lit("}"))
    as_string = F.regexp_extract(F.to_json(F.struct(whole.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    shape = F.col("tool_id") % 4
    body = F.when(shape == 0, whole).when(shape == 1, listed).when(shape == 2, as_string).otherwise(F.concat(F.lit("{cut "), whole))
    return tools.select(F.col("tool_id").alias("qa_id"), body.alias("agent_result"), F.col("tag").alias("question"), F.col("p_type").alias("answer"))


@query("s10_extracted_tools", """SELECT tool_id AS qa_id, CAST(i AS BIGINT) AS "index", name, code, tag AS original_question, p_type AS original_answer
    FROM r_tools, (SELECT unnest([0, 1]) AS i) WHERE tool_id % 4 < 3""")
def extracted_tools(spark, folder):
    rows = readers.extracted_tools(extraction_results(spark, folder))
    return rows.select(
        "qa_id", F.col("index").cast("bigint").alias("index"), F.try_variant_get("tool_info", "$.n", "string").alias("name"), "code", "original_question", "original_answer"
    )


@query("s10_unreadable_results", "SELECT tool_id AS qa_id FROM r_tools WHERE tool_id % 4 = 3")
def unreadable_results(spark, folder):
    return readers.unreadable_results(extraction_results(spark, folder)).select("qa_id")


@query("s10_single_reasoning", "SELECT doc_id AS qa_id, text AS reasoning FROM documents")
def single_reasoning(spark, folder):
    """Every other reasoning is stored as a list."""
    listed = F.to_json(F.array("text", "lang"))
    rows = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.col("text")).alias("reasoning"))
    return rows.select(F.col("doc_id").alias("qa_id"), readers.single_reasoning().alias("reasoning"))


def order_units(spark, folder):
    """Orders in output folders per nation and year."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))


@query("s11_finished_units", "SELECT DISTINCT 'cluster' || c_nationkey AS cluster_name, CAST(year(o_orderdate) AS BIGINT) AS sib_index FROM orders JOIN customer ON c_custkey = o_custkey")
def finished_units(spark, folder):
    path = run_folder(spark, "s11")
    unit = F.concat(F.lit("cluster"), F.col("c_nationkey").cast("string"), F.lit("_sib_"), F.col("y").cast("string"), F.lit("_final_openai_tools.json"))
    order_units(spark, folder).withColumn("unit", unit).hint("rebalance", "unit").write.partitionBy("unit").json(path)
    return readers.finished_units(spark, path, "part-*.json")


@query("s12_blueprint_folders", "SELECT DISTINCT 'unit=cluster' || c_nationkey || '_output' AS unit FROM orders JOIN customer ON c_custkey = o_custkey")
def blueprint_folders(spark, folder):
    path = run_folder(spark, "s12")
    unit = F.concat(F.lit("cluster"), F.col("c_nationkey").cast("string"), F.lit("_output"))
    order_units(spark, folder).withColumn("unit", unit).hint("rebalance", "unit").write.partitionBy("unit").json(path)
    return readers.blueprint_folders(spark, path, "part-*.json")


LIMBS = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))


@query("s13_tool_set_fingerprints", f"""SELECT p_type, sha256(concat_ws('-', CAST(count(*) AS VARCHAR), {LIMBS})) AS fingerprint, count(*) AS tools
    FROM (SELECT p_type, sha256(pos || chr(31) || name || chr(31) || description_text) AS d FROM r_tools) GROUP BY p_type""")
def tool_set_fingerprints(spark, folder):
    tools = roles.tools(spark, folder).select("p_type", "pos", "name", F.col("description_text").alias("description"))
    return catalog.set_fingerprint(tools, ["p_type"], "pos")


@query("s14_stored_blocks", """SELECT c.cluster_name, c.sib_index, t.pos, t.question, t.answer FROM r_cover c JOIN r_cluster_tools t ON t.cluster_name = c.cluster_name AND t.pos = c.covered""")
def stored_blocks(spark, folder):
    path = run_folder(spark, "s14")
    tools = roles.cluster_tools(spark, folder).select("cluster_name", "pos", "question", "answer")
    writers.write_blocks_with_tools(blocks.covered_tools(roles.cover(spark, folder), tools), path, 8)
    return readers.read_parquet(spark, path).drop("cluster_bucket")


@query("s15_stored_final_tools", """SELECT tag AS cluster_name, pos % 7 AS sib_index, coalesce(info, '') AS tool_info, code AS tool_code FROM r_tools""")
def stored_final_tools(spark, folder):
    path = run_folder(spark, "s15")
    tools = roles.tools(spark, folder).select(
        F.col("tag").alias("cluster_name"), (F.col("pos") % 7).alias("sib_index"), F.coalesce("info", F.lit("")).alias("tool_info"), F.col("code").alias("tool_code"), "p_type"
    )
    writers.write_final_tools(tools, path, 8)
    thin = readers.read_json_lines(spark, f"{path}/final_openai_tools", "cluster_name string, sib_index bigint, tool_info string, tool_code string", strict=True)
    return thin.select("cluster_name", "sib_index", "tool_info", "tool_code")
