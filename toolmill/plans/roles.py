"""Role tables: what the given tables stand for. Each role covers its whole table,
so its size follows the data. Composed texts use one expression string that reads
the same in Spark SQL and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolmill.operators import metrics
from toolmill.operators.ordering import number_rows
from toolmill.sources.readers import spread, table

# --- expressions both engines read -------------------------------------------------------

CORRECT = "CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT)"
MODEL = "concat('m', CAST(event_id % 3 AS STRING))"

LETTER = "chr(CAST(65 + doc_id % 10 AS INT))"
ANSWER_TAIL = f"""CASE doc_id % 6
 WHEN 0 THEN '' WHEN 1 THEN concat('Final Answer: boxed{{', {LETTER}, '}}') WHEN 2 THEN concat('Final Answer: ', {LETTER}, '. ')
 WHEN 3 THEN 'Final Answer: none of them' WHEN 4 THEN concat('Final Answer: x Final Answer: ', lower({LETTER}), ' and more.')
 ELSE concat('Final Answer: ', {LETTER}, ', then') END"""
RESPONSE = f"concat(text, '\n', {ANSWER_TAIL})"
TRUTH = "CASE WHEN doc_id % 50 = 0 THEN '' ELSE chr(CAST(65 + doc_id % 7 AS INT)) END"

TOOL_NAME = "concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 400 AS STRING))"
SIZE = "CAST(p_size AS STRING)"
VALID_PARAMS = f"""concat('{{"type":"object","properties":{{"x":{{"type":"integer","description":"size ', {SIZE}, '"}},"y":{{"type":"number"}}}},"required":["x"],"additionalProperties":false}}')"""
PARAMS = f"""CASE p_partkey % 12
 WHEN 0 THEN '[{{"type":"number"}},{{"type":["string","integer"]}},{{"note":1}}]'
 WHEN 1 THEN '{{"type":"object","oneOf":[],"enum":["a"],"properties":{{}}}}'
 WHEN 2 THEN concat('{{"type":"array","properties":{{"x', {SIZE}, '":{{"type":"array"}}}}}}')
 WHEN 3 THEN '{{"type":"object"}}'
 WHEN 4 THEN concat('{{"type":"object","properties":{{"a', {SIZE}, '":{{"type":["number","string"]}},"b":{{"type":"integer","default":true,"minimum":false}},"c":{{"type":"string","enum":["u","vv"]}}}}}}')
 WHEN 5 THEN concat('{{"type":"object","properties":{{"cfg":{{"type":"object","properties":{{"list', {SIZE}, '":{{"type":"array"}},"deep":{{"type":"object","properties":{{"z":{{"type":["a","b"]}}}}}}}}}},"plain":{{"type":"object"}}}},"required":["cfg"]}}')
 ELSE {VALID_PARAMS} END"""
DESCRIPTION = "concat(p_type, ' tool of ', p_brand)"
TOOL_INFO = f"""CASE p_partkey % 12
 WHEN 6 THEN '{{"type":"function"}}'
 WHEN 7 THEN concat('{{"type":"function","function":{{"parameters":', {VALID_PARAMS}, '}}}}')
 WHEN 8 THEN CAST(NULL AS STRING)
 WHEN 9 THEN concat('[1,{{"type":"function","function":{{"name":"', {TOOL_NAME}, '","description":"', {DESCRIPTION}, '","parameters":', {VALID_PARAMS}, '}}}}]')
 ELSE concat('{{"type":"function","function":{{"name":"', {TOOL_NAME}, '","description":"', {DESCRIPTION}, '","parameters":', {PARAMS}, '}}}}') END"""

TOOL_CODE = f"""CASE p_partkey % 8
 WHEN 0 THEN concat('import math
from typing import List

def ', {TOOL_NAME}, '(x: int, y: float = 1.0, note=None) -> float:
    \"\"\"Compute the ', p_type, ' size.

    Args:
        x (float): base value of ', p_brand, '
        y: scale

    Returns:
        result
    \"\"\"
    return x * y + ', {SIZE}, '
')
 WHEN 1 THEN concat('import math


def _helper(v):
    return math.sqrt(v)


def ', {TOOL_NAME}, '(values: List[float], n: Optional[int]) -> List[float]:
    # _helper(0) is fine
    return [_helper(v) for v in values][:n]
')
 WHEN 2 THEN concat('def ', {TOOL_NAME}, '(x:
    return x
')
 WHEN 3 THEN concat('class Part', {SIZE}, ':
    \"\"\"Holder for ', p_brand, '.
    More text.\"\"\"
    def run(self, a):
        return a
')
 WHEN 4 THEN ''
 WHEN 5 THEN concat('from __future__ import annotations

def ', {TOOL_NAME}, '(d: Dict[str, int], flag=True):
    return d
')
 WHEN 6 THEN concat('```python
def ', {TOOL_NAME}, '(s: str, t: List[Optional[int]]):
    return s
```')
 ELSE concat('def alpha():
    return 1

def execute(q, r):
    return q

async def ', {TOOL_NAME}, '(z):
    return z
') END"""

QUESTION_YEAR = "year(o_orderdate)"

# --- the same tables for the checking SQL ---------------------------------------------------

ROLE_SQL: dict[str, str] = {
    "r_attempts": """SELECT user_id AS question_id, 'm' || (event_id % 3) AS model, event_id,
        row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) - 1 AS attempt,
        CAST(event_type = 'purchase' AS BIGINT) AS correctness, event_id % 5 AS tool_count,
        CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type FROM events""",
    "r_attempt_tools": """SELECT question_id, model, attempt, 'tool_' || ((k + i) % 40) AS name
        FROM (SELECT *, unnest(range(tool_count)) AS i FROM r_attempts)""",
    "r_retrievals": """SELECT user_id AS question_id, event_id, event_type, event_id // 1000 AS round,
        'tool_' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 40) AS name FROM events""",
    "r_replies": f"SELECT doc_id AS question_id, lang, {RESPONSE} AS response, {TRUTH} AS ground_truth FROM documents".replace("AS STRING", "AS VARCHAR"),
    "r_tools": f"""SELECT p_partkey AS tool_id, p_partkey AS pos, {TOOL_NAME} AS name, {DESCRIPTION} AS description_text, p_brand AS tag, p_type,
        {TOOL_INFO} AS info, {TOOL_CODE} AS code FROM part""".replace("AS STRING", "AS VARCHAR"),
    "r_nodes": """SELECT 'r' || r_regionkey AS id, CAST(0 AS BIGINT) AS level, CAST(NULL AS VARCHAR) AS parent FROM region
        UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey FROM nation WHERE n_nationkey % 5 <> 4
        UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 5 ELSE 2 END, 'n' || c_nationkey FROM customer WHERE c_custkey % 4 <> 3""",
    "r_edges": """SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, CAST(n_nationkey AS BIGINT) AS seq FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey + 100 FROM customer""",
    "r_children": """SELECT child AS id, arg_min(p.level + 1, e.seq) AS level, arg_min(e.parent, e.seq) AS parent FROM r_edges e JOIN r_nodes p ON p.id = e.parent
        WHERE child NOT IN (SELECT id FROM r_nodes) GROUP BY child""",
    "r_complete": """SELECT id, level, parent FROM r_nodes UNION ALL SELECT id, level, parent FROM r_children UNION ALL
        SELECT child, arg_min(p.level + 1, e.seq), arg_min(e.parent, e.seq) FROM r_edges e JOIN r_children p ON p.id = e.parent
        WHERE child NOT IN (SELECT id FROM r_nodes) AND child NOT IN (SELECT id FROM r_children) GROUP BY child""",
    "r_assignments": """SELECT o_orderkey AS tool_id, o_orderkey AS pos, n_nationkey, n_regionkey, o_custkey,
        CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'x' || o_custkey WHEN o_orderkey % 11 = 0 THEN 'y' || (o_custkey % 50)
             WHEN o_orderkey % 13 = 0 THEN 'w}' || (o_custkey % 3) ELSE 'n' || n_nationkey END AS cluster_id,
        CASE WHEN o_orderkey % 101 = 0 THEN [] WHEN o_orderkey % 7 = 0 THEN ['r' || n_regionkey, 'n' || n_nationkey, 'q' || o_custkey]
             WHEN o_orderkey % 11 = 0 THEN ['p' || o_custkey, 'z' || (o_custkey % 20)] WHEN o_orderkey % 13 = 0 THEN []
             ELSE ['r' || n_regionkey] END AS cluster_ids
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "r_targets": """SELECT a.tool_id, a.pos, CASE WHEN a.cluster_id IN (SELECT id FROM r_complete) THEN a.cluster_id
            WHEN len(cluster_ids) > 0 THEN coalesce((SELECT arg_max(c.id, list_position(a.cluster_ids, c.id)) FROM r_complete c WHERE list_contains(a.cluster_ids, c.id)), cluster_ids[-1])
            ELSE a.cluster_id END AS target FROM r_assignments a""",
    "r_members": "SELECT tool_id, pos, target AS cluster_id FROM r_targets WHERE target IS NOT NULL",
    "r_chunks": """SELECT *, CASE WHEN n <= 300 THEN cluster_id ELSE cluster_id || '_' || chunk END AS cluster_name FROM (
        SELECT tool_id, pos, cluster_id, n, pos0, CASE WHEN pos0 < (n % c) * (n // c + 1) THEN pos0 // (n // c + 1)
            ELSE n % c + (pos0 - (n % c) * (n // c + 1)) // (n // c) END AS chunk
        FROM (SELECT *, (n + 299) // 300 AS c FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n,
            row_number() OVER (PARTITION BY cluster_id ORDER BY pos) - 1 AS pos0 FROM r_members)))""",
    "r_cluster_tools": """SELECT 'c' || o_custkey AS cluster_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
        o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS question, o_orderstatus AS answer, year(o_orderdate) AS y FROM orders""",
    "r_cover": "SELECT DISTINCT 'c' || o_custkey AS cluster_name, CAST(year(o_orderdate) AS BIGINT) AS sib_index, o_orderkey % 12 AS covered FROM orders",
    "r_results": """SELECT 'c' || o_custkey AS cluster_name, CAST(year(o_orderdate) AS BIGINT) AS sib_index, {'k': l_orderkey, 'p': l_partkey, 's': l_suppkey, 'l': l_linenumber, 'q': l_quantity, 'd': l_shipdate} AS seq, o_orderpriority AS question,
        l_linestatus = 'F' AS success,
        CASE l_returnflag WHEN 'A' THEN 'is_library_helpful: PASS, no error' WHEN 'N' THEN 'Library needs improvement: NEED_PATCHING or PASS' ELSE 'Wrong output' END AS final_report
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "r_final": "SELECT DISTINCT 'c' || o_custkey AS cluster_name, CAST(year(o_orderdate) AS BIGINT) AS sib_index FROM orders WHERE o_orderstatus = 'P'",
    "r_problems": """SELECT substr(o_orderpriority, 1, 1) AS subfield, CAST(year(o_orderdate) AS BIGINT) AS iter, o_orderkey AS problem_id,
        o_orderstatus = 'F' AS is_correct, o_orderpriority || ' ' || o_orderkey AS problem_text FROM orders""",
    "r_calls": """SELECT DISTINCT subfield, iter, problem_id, l_suppkey AS tool_id, is_correct FROM r_problems JOIN lineitem ON l_orderkey = problem_id""",
    "r_subfield_tools": "SELECT unnest(['1', '2', '3', '4', '5']) AS subfield, s_suppkey AS tool_id FROM supplier",
    "r_usage": """SELECT subfield, tool_id, iter, sum(f) OVER w AS freq, sum(t) OVER w AS tsr FROM (
        SELECT subfield, tool_id, iter, count(*) AS f, sum(CAST(is_correct AS BIGINT)) AS t FROM r_calls GROUP BY ALL)
        WINDOW w AS (PARTITION BY subfield, tool_id ORDER BY iter)""",
    "r_knowledge": "SELECT DISTINCT l_orderkey AS id, l_linestatus AS field, l_returnflag AS subfield FROM lineitem",
    "r_problem_clusters": """SELECT DISTINCT l_linestatus AS field, l_returnflag AS subfield, CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS cluster,
        l_orderkey AS id FROM lineitem""",
    "r_messages": """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN turn % 6 = 2 THEN 'tool' ELSE role END AS role, text AS content,
        CASE WHEN turn % 2 = 1 THEN 'call_' || turn END AS call_id, CASE WHEN turn % 12 = 2 THEN 'call_' || (turn - 1) END AS answers,
        CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'lookup' END AS call_name, '{"turn": ' || turn || '}' AS call_arguments FROM conversations""",
    "r_pairs": """SELECT q.vec_id AS query_id, t.vec_id AS tool_id,
        round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 6) + 0.0 AS score FROM embeddings q, embeddings t""",
    "r_top5": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tool_id) AS rank FROM r_pairs) WHERE rank <= 5""",
    "r_truth": "SELECT vec_id AS question_id, 'tool_' || (vec_id + i) AS name FROM (SELECT vec_id, unnest(range(vec_id % 4)) AS i FROM embeddings)",
    "r_retrieved": "SELECT query_id AS question_id, 'tool_' || tool_id AS name, rank FROM r_top5",
}

# --- Spark ------------------------------------------------------------------------------------


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of a user's question, in event order, per model."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("question_id"),
        F.expr(MODEL).alias("model"),
        "event_id",
        F.expr(CORRECT).alias("correctness"),
        (F.col("event_id") % 5).alias("tool_count"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
        "event_type",
    )
    return number_rows(rows, ["question_id", "model"], "event_id", "attempt")


def first_attempts(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The first n attempts of each question and model."""
    rows = table(spark, folder, "events").select(F.col("user_id").alias("question_id"), F.expr(MODEL).alias("model"), "event_id", F.expr(CORRECT).alias("correctness"))
    return metrics.first_attempts(rows, "event_id", n)


def with_retrieved(rows: DataFrame) -> DataFrame:
    """Adds the names retrieved in each attempt (``tool_count`` of them)."""
    names = F.when(F.col("tool_count") > 0, F.transform(
        F.sequence(F.lit(0), F.col("tool_count") - 1), lambda i: F.concat(F.lit("tool_"), ((F.col("k") + i) % 40).cast("string"))
    )).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("retrieved", names)


def plain_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts for metrics that do not use the attempt number: nothing is numbered."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("question_id"),
        F.expr(MODEL).alias("model"),
        F.expr(CORRECT).alias("correctness"),
        (F.col("event_id") % 5).alias("tool_count"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
        "event_type",
    )


def retrievals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("question_id"),
        "event_id",
        "event_type",
        F.floor(F.col("event_id") / 1000).alias("round"),
        F.concat(F.lit("tool_"), (F.regexp_extract("props", "[0-9]+", 0).cast("bigint") % 40).cast("string")).alias("name"),
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"), "lang", F.expr(RESPONSE).alias("response"), F.expr(TRUTH).alias("ground_truth")
    )


def part(spark: SparkSession, folder: str) -> DataFrame:
    """Parts on all cores: composing and reading their texts is the work."""
    return spread(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents on all cores, for expressions that read every character."""
    return spread(table(spark, folder, "documents"), "doc_id")


def tools(spark: SparkSession, folder: str) -> DataFrame:
    return part(spark, folder).select(
        F.col("p_partkey").alias("tool_id"),
        F.col("p_partkey").alias("pos"),
        F.expr(TOOL_NAME).alias("name"),
        F.expr(DESCRIPTION).alias("description_text"),
        F.col("p_brand").alias("tag"),
        "p_type",
        F.expr(TOOL_INFO).alias("info"),
        F.expr(TOOL_CODE).alias("code"),
    )


def parsed_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Tools with their schema as VARIANT."""
    return tools(spark, folder).withColumn("info", F.try_parse_json("info"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    region, nation, customer = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    level = lambda n: F.lit(n).cast("bigint").alias("level")
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    listed = [
        region.select(name("r", "r_regionkey").alias("id"), level(0), F.lit(None).cast("string").alias("parent")),
        nation.where("n_nationkey % 5 <> 4").select(name("n", "n_nationkey").alias("id"), level(1), name("r", "n_regionkey").alias("parent")),
        customer.where("c_custkey % 4 <> 3").select(
            name("c", "c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 97 = 0 THEN 5L ELSE 2L END").alias("level"), name("n", "c_nationkey").alias("parent")
        ),
    ]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


def edges(spark: SparkSession, folder: str) -> DataFrame:
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    top = nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"), F.col("n_nationkey").cast("bigint").alias("seq"))
    low = customer.select(
        name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"), (F.col("c_custkey") + 100).alias("seq")
    )
    return top.unionByName(low)


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    joined = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("tool_id"),
        F.col("o_orderkey").alias("pos"),
        F.expr("""CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'x' || o_custkey WHEN o_orderkey % 11 = 0 THEN 'y' || (o_custkey % 50)
             WHEN o_orderkey % 13 = 0 THEN 'w}' || (o_custkey % 3) ELSE 'n' || n_nationkey END""").alias("cluster_id"),
        F.expr("""CASE WHEN o_orderkey % 101 = 0 THEN array() WHEN o_orderkey % 7 = 0 THEN array('r' || n_regionkey, 'n' || n_nationkey, 'q' || o_custkey)
             WHEN o_orderkey % 11 = 0 THEN array('p' || o_custkey, 'z' || (o_custkey % 20)) WHEN o_orderkey % 13 = 0 THEN array()
             ELSE array('r' || n_regionkey) END""").alias("cluster_ids"),
    )


CLUSTER = "concat('c', CAST(o_custkey AS STRING))"


def cluster_tools(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.expr(CLUSTER).alias("cluster_name"),
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END").alias("question"),
        F.col("o_orderstatus").alias("answer"),
    )
    return number_rows(rows, ["cluster_name"], "o_orderkey", "pos")


def cover(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.expr(CLUSTER).alias("cluster_name"),
        F.year("o_orderdate").cast("bigint").alias("sib_index"),
        (F.col("o_orderkey") % 12).alias("covered"),
    ).distinct()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Optimisation results: the lines of each order; ``seq`` orders them by value."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate", "l_linestatus", "l_returnflag"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.expr(CLUSTER).alias("cluster_name"),
        F.year("o_orderdate").cast("bigint").alias("sib_index"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate").alias("seq"),
        F.col("o_orderpriority").alias("question"),
        (F.col("l_linestatus") == "F").alias("success"),
        F.expr("""CASE l_returnflag WHEN 'A' THEN 'is_library_helpful: PASS, no error' WHEN 'N' THEN 'Library needs improvement: NEED_PATCHING or PASS'
             ELSE 'Wrong output' END""").alias("final_report"),
    )


def final_tools(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where("o_orderstatus = 'P'").select(
        F.expr(CLUSTER).alias("cluster_name"), F.year("o_orderdate").cast("bigint").alias("sib_index")
    ).distinct()


def problems(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("subfield"),
        F.year("o_orderdate").cast("bigint").alias("iter"),
        F.col("o_orderkey").alias("problem_id"),
        (F.col("o_orderstatus") == "F").alias("is_correct"),
        F.expr("concat(o_orderpriority, ' ', CAST(o_orderkey AS STRING))").alias("problem_text"),
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Tools called for a problem: the suppliers of all the order's lines."""
    called = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("problem_id"), F.col("l_suppkey").alias("tool_id")).distinct()
    return called.join(problems(spark, folder).drop("problem_text"), "problem_id")


def subfield_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Every supplier is a tool of every subfield."""
    return table(spark, folder, "supplier").select(F.explode(F.array(*[F.lit(str(i)) for i in range(1, 6)])).alias("subfield"), F.col("s_suppkey").alias("tool_id"))


def knowledge(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("field"), F.col("l_returnflag").alias("subfield")).distinct()


def problem_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("field"),
        F.col("l_returnflag").alias("subfield"),
        F.expr("CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END").alias("cluster"),
        F.col("l_orderkey").alias("id"),
    ).distinct()


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with their tool calls and tool results, some without an id; the turn is the position."""
    number = F.col("turn").cast("string")
    call = F.when(
        (F.col("role") == "assistant") & (F.col("turn") % 3 == 1),
        F.array(F.struct(
            F.when(F.col("turn") % 2 == 1, F.concat(F.lit("call_"), number)).alias("id"), F.lit("lookup").alias("name"),
            F.concat(F.lit('{"turn": '), number, F.lit("}")).alias("arguments"),
        )),
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 6 == 2, "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), call.alias("tool_calls"),
        F.when(F.col("turn") % 12 == 2, F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string"))).alias("tool_call_id"),
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("tool_id"), F.col("embedding").alias("vec"), "label")


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector is a query against all vectors."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Expected names of a question: none to three, its own and the next ids."""
    ids = table(spark, folder, "embeddings").select("vec_id")
    steps = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("vec_id") % 4)
    return ids.select(F.col("vec_id").alias("question_id"), F.explode(steps).alias("i")).select(
        "question_id", F.concat(F.lit("tool_"), (F.col("question_id") + F.col("i")).cast("string")).alias("name")
    )
