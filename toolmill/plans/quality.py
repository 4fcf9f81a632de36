"""Quality rules, extraction from text and scoring (Q1-Q10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.functions import code as pycode
from toolmill.functions import fixed, schema, scoring
from toolmill.operators import blocks, extraction
from toolmill.plans import roles
from toolmill.plans.expressions import B, NUMBER_SQL, NUMBERS, TAILS
from toolmill.plans.registry import query
from toolmill.sources.readers import table

BAD_WORDS = ", ".join(f"'{w}'" for w in fixed.INVALID_TOP_KEYWORDS)
PROPERTY = "json_extract(o, '$.properties.\"' || k || '\"')"


Q1_SQL = f"""WITH RECURSIVE f AS (SELECT tool_id, CAST(info AS JSON) AS v, json_extract(info, '$.function') AS fn, json_extract(info, '$.function.parameters') AS p FROM r_tools),
    bad AS (SELECT tool_id, string_agg(k, ',' ORDER BY k) AS words FROM (SELECT tool_id, unnest(json_keys(p)) AS k FROM f WHERE json_type(p) = 'OBJECT') WHERE k IN ({BAD_WORDS}) GROUP BY 1),
    objs AS (SELECT tool_id, '' AS path, p AS o FROM f WHERE json_type(p) = 'OBJECT' AND tool_id NOT IN (SELECT tool_id FROM bad)
        UNION ALL SELECT tool_id, path, o FROM (SELECT tool_id, CASE WHEN path = '' THEN k ELSE path || '.' || k END AS path, {PROPERTY} AS o FROM
            (SELECT tool_id, path, o, unnest(json_keys(o, '$.properties')) AS k FROM objs WHERE json_type(o, '$.properties') = 'OBJECT'))
            WHERE json_extract_string(o, '$.type') = 'object' AND json_type(o, '$.properties') IS NOT NULL),
    props AS (SELECT tool_id, k, {PROPERTY} AS d FROM (SELECT tool_id, o, unnest(json_keys(o, '$.properties')) AS k FROM objs WHERE json_type(o, '$.properties') = 'OBJECT') WHERE json_type({PROPERTY}) = 'OBJECT')
    SELECT tool_id, 'schema_missing_field' AS error_type, '' AS property, 'tool_info' AS detail FROM f WHERE v IS NULL
    UNION ALL SELECT tool_id, 'schema_invalid_type', '', 'tool_info' FROM f WHERE json_type(v) <> 'OBJECT'
    UNION ALL SELECT tool_id, 'schema_missing_field', '', 'function' FROM f WHERE json_type(v) = 'OBJECT' AND fn IS NULL
    UNION ALL SELECT tool_id, 'schema_missing_field', '', field FROM f, (SELECT unnest(['name', 'description', 'parameters']) AS field) WHERE json_type(fn) = 'OBJECT' AND json_type(fn, '$.' || field) IS NULL
    UNION ALL SELECT tool_id, 'schema_parameters_wrong_type', '', 'parameters' FROM f WHERE json_type(p) <> 'OBJECT'
    UNION ALL SELECT tool_id, 'schema_parameters_invalid_keywords', '', words FROM bad
    UNION ALL SELECT tool_id, 'schema_invalid_type', path, 'type' FROM objs WHERE coalesce(json_extract_string(o, '$.type'), '') <> 'object'
    UNION ALL SELECT tool_id, 'schema_missing_field', path, 'properties' FROM objs WHERE json_type(o, '$.properties') IS NULL
    UNION ALL SELECT tool_id, 'schema_array_missing_items', k, 'items' FROM props WHERE json_extract_string(d, '$.type') = 'array' AND json_type(d, '$.items') IS NULL
    UNION ALL SELECT tool_id, 'schema_type_array', k, 'type' FROM props WHERE json_type(d, '$.type') = 'ARRAY'
    UNION ALL SELECT tool_id, 'schema_invalid_value_type', k, field FROM props, (SELECT unnest(['default', 'minimum', 'maximum']) AS field) WHERE json_type(d, '$.' || field) = 'BOOLEAN'"""


@query("q1_schema_errors", Q1_SQL)
def schema_errors(spark, folder):
    return schema.schema_errors(roles.tools(spark, folder))


@query("q1_schema_errors_but_booleans", f"SELECT * FROM ({Q1_SQL}) WHERE error_type <> 'schema_invalid_value_type'")
def schema_errors_but_booleans(spark, folder):
    """Booleans pass as numbers do."""
    return schema.schema_errors(roles.tools(spark, folder), booleans=False)


NESTED_OPEN = '{"type":"object","properties":{"inner":'
TREES = f"""CASE p_partkey % 6
 WHEN 0 THEN concat('{NESTED_OPEN * 12}', '{{"type":"string"}}', '{"}}" * 12}')
 WHEN 1 THEN concat('{{"type":"object","additionalProperties":false,"required":["e"],"properties":{{"e":{{"type":"string","enum":[', repeat(concat('"', repeat(p_brand, 8), '",'), 300), '"z"]}},"f":{{"enum":[', repeat(concat('"', repeat(p_brand, 9), '",'), 260), '"y"]}}}}}}')
 WHEN 2 THEN concat('{{"type":"object","required":["a"],"properties":{{"a":{{"type":"array","items":{{"type":"object","properties":{{"n', CAST(p_size AS STRING), '":{{"const":"fixed"}}}}}}}},"b":{{"anyOf":[{{"type":"string"}},{{"oneOf":[{{"enum":[1,"two"]}}]}}]}},"c":{{"type":"array","items":[{{"enum":["x","yz"]}},{{"type":"object","properties":{{"deep":{{}}}}}}]}}}},"definitions":{{"shape":{{"type":"object","properties":{{"side":{{"type":"number"}}}}}}}}}}')
 WHEN 3 THEN concat('{{"type":"object","additionalProperties":true,"properties":{{"x":{{"enum":[', repeat('1,', 1000), '2]}}}}}}')
 ELSE {roles.VALID_PARAMS} END"""
TREES_SQL = TREES.replace("AS STRING", "AS VARCHAR")


def trees(spark, folder):
    return roles.part(spark, folder).select(F.col("p_partkey").alias("tool_id"), F.expr(TREES).alias("parameters"))


def _values(path: str) -> str:
    return f"coalesce([json_extract(n, '{path}.\"' || k || '\"') for k in json_keys(n, '{path}')], [])"


MEASURED_SQL = f"""WITH RECURSIVE nodes AS (SELECT p_partkey AS tool_id, 1 AS depth, CAST({TREES_SQL} AS JSON) AS n FROM part
        UNION ALL SELECT tool_id, depth + 1, c FROM (SELECT tool_id, depth, unnest(list_concat(list_concat(list_concat(
            CASE WHEN json_extract_string(n, '$.type') = 'object' THEN {_values('$.properties')} ELSE [] END,
            CASE WHEN json_extract_string(n, '$.type') = 'array' AND json_type(n, '$.items') = 'ARRAY' THEN json_extract(n, '$.items[*]')
                 WHEN json_extract_string(n, '$.type') = 'array' AND json_type(n, '$.items') IS NOT NULL THEN [json_extract(n, '$.items')] ELSE [] END),
            list_concat(coalesce(json_extract(n, '$.anyOf[*]'), []), coalesce(json_extract(n, '$.oneOf[*]'), []))), {_values('$.definitions')})) AS c FROM nodes)),
    m AS (SELECT tool_id, depth, CASE WHEN json_extract_string(n, '$.type') = 'object' THEN coalesce(json_keys(n, '$.properties'), []) ELSE [] END AS names,
        coalesce(json_keys(n, '$.definitions'), []) AS defs, coalesce(json_extract(n, '$.enum[*]'), []) AS enums,
        [json_extract_string(x, '$') for x in coalesce(json_extract(n, '$.enum[*]'), []) if json_type(x) = 'VARCHAR'] AS texts, coalesce(length(json_extract_string(n, '$.const')), 0) AS c FROM nodes),
    s AS (SELECT tool_id, depth, len(names) AS props, coalesce(list_sum([length(x) for x in list_concat(list_concat(names, defs), texts)]), 0) + c AS text, len(enums) AS enums,
        CASE WHEN len(enums) > 250 AND len(texts) = len(enums) THEN list_sum([length(x) for x in texts]) ELSE 0 END AS enum_text FROM m)"""
BUDGET_SQL = MEASURED_SQL + """
    SELECT tool_id, CAST(max(depth) AS BIGINT) AS max_depth, CAST(sum(props) AS BIGINT) AS total_props, CAST(sum(text) AS BIGINT) AS total_text, CAST(sum(enums) AS BIGINT) AS enum_count,
    CAST(max(enum_text) AS BIGINT) AS largest_enum_text FROM s GROUP BY tool_id"""


@query("q2_schema_budgets", BUDGET_SQL)
def schema_budgets(spark, folder):
    return schema.schema_budgets(trees(spark, folder))


@query("q2_strict_errors", f"""WITH b AS ({BUDGET_SQL}), e AS ({MEASURED_SQL} SELECT tool_id, enum_text FROM s WHERE enum_text > 15000), p AS (SELECT p_partkey AS tool_id, CAST({TREES_SQL} AS JSON) AS j FROM part),
    miss AS (SELECT tool_id, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT tool_id, j, unnest(json_keys(j, '$.properties')) AS k FROM p WHERE json_type(j, '$.required') = 'ARRAY')
        WHERE NOT list_contains(CAST(json_extract(j, '$.required') AS VARCHAR[]), k) GROUP BY 1)
    SELECT tool_id, 'schema_missing_additional_properties' AS error_type, '' AS detail FROM p WHERE coalesce(json_extract_string(j, '$.additionalProperties'), '') <> 'false'
    UNION ALL SELECT tool_id, 'schema_missing_required', '' FROM p WHERE coalesce(json_type(j, '$.required'), '') <> 'ARRAY'
    UNION ALL SELECT tool_id, 'schema_required_fields_missing', names FROM miss
    UNION ALL SELECT tool_id, 'schema_depth_limit_exceeded', CAST(max_depth AS VARCHAR) FROM b WHERE max_depth > 10
    UNION ALL SELECT tool_id, 'schema_property_limit_exceeded', CAST(total_props AS VARCHAR) FROM b WHERE total_props > 5000
    UNION ALL SELECT tool_id, 'schema_string_budget_exceeded', CAST(total_text AS VARCHAR) FROM b WHERE total_text > 120000
    UNION ALL SELECT tool_id, 'schema_enum_count_exceeded', CAST(enum_count AS VARCHAR) FROM b WHERE enum_count > 1000
    UNION ALL SELECT tool_id, 'schema_enum_string_budget_exceeded', CAST(CAST(enum_text AS BIGINT) AS VARCHAR) FROM e""")
def strict_errors(spark, folder):
    return schema.strict_errors(trees(spark, folder))


@query("q3_repaired_schemas", """SELECT tool_id, CASE WHEN tool_id % 12 IN (8, 9) THEN NULL WHEN tool_id % 12 IN (6, 7) THEN 'tool_function_' || tool_id ELSE name END AS name,
    CASE WHEN tool_id % 12 IN (8, 9) THEN NULL WHEN tool_id % 12 IN (6, 7) THEN 'Auto-generated tool function' ELSE description_text END AS description,
    CASE WHEN tool_id % 12 IN (8, 9) THEN NULL WHEN tool_id % 12 = 2 THEN 'array' ELSE 'object' END AS type, CASE WHEN tool_id % 12 IN (8, 9) THEN info END AS kept_info,
    CASE tool_id % 12 WHEN 0 THEN 'param_1,param_2' WHEN 2 THEN 'x' || p_size WHEN 4 THEN 'a' || p_size || ',b,c' WHEN 5 THEN 'cfg,plain' WHEN 7 THEN 'x,y' WHEN 10 THEN 'x,y' WHEN 11 THEN 'x,y' ELSE '' END AS props,
    CASE tool_id % 12 WHEN 0 THEN 'param_1,param_2' WHEN 5 THEN 'cfg' WHEN 7 THEN 'x' WHEN 10 THEN 'x' WHEN 11 THEN 'x' ELSE '' END AS required,
    CAST(tool_id % 12 IN (0, 4) AS BIGINT) AS one_of, CAST(tool_id % 12 = 2 AS BIGINT) AS with_items, CAST(tool_id % 12 = 4 AS BIGINT) AS zero_minimum
    FROM r_tools JOIN part ON p_partkey = tool_id""")
def repaired_schemas(spark, folder):
    fixed_tools = roles.tools(spark, folder).select("tool_id", "info", schema.repair_function(F.try_parse_json("info"), F.col("tool_id").cast("string")).alias("f"))
    v = F.col("v")
    kept = F.when(F.col("f").isNull(), F.col("info")).alias("kept_info")
    parsed = fixed_tools.select("tool_id", kept, "f.name", "f.description", F.try_parse_json("f.parameters").alias("v"))
    names = F.array_sort(F.transform(schema.property_entries(v), lambda e: e["key"]))
    required = F.array_sort(F.transform(schema.items(schema.at(v, "$.required")), lambda x: F.try_variant_get(x, "$", "string")))
    count = lambda test: F.size(F.filter(schema.property_entries(v), lambda e: test(e["value"]))).cast("bigint")
    return parsed.select(
        "tool_id", "kept_info", "name", "description", schema.text_at(v, "$.type").alias("type"), F.array_join(names, ",").alias("props"), F.array_join(required, ",").alias("required"),
        count(lambda p: schema.at(p, "$.oneOf").isNotNull()).alias("one_of"), count(lambda p: schema.at(p, "$.items").isNotNull()).alias("with_items"),
        count(lambda p: F.try_variant_get(p, "$.minimum", "int") == 0).alias("zero_minimum"),
    )


# --- signatures ---------------------------------------------------------------------------

SIGNATURE = fixed.SIGNATURE_PATTERN
TYPED, DEFAULTED = fixed.TYPED_PARAMETER, fixed.DEFAULTED_PARAMETER


def _type_sql(t: str, depth: int = 3) -> str:
    named = " ".join(f"WHEN {t} = '{k}' THEN '{v}'" for k, v in fixed.TYPE_NAMES.items())
    plain = f"""'{{"type":"' || CASE {named} ELSE 'string' END || '"}}'"""
    if depth == 0:
        return plain
    optional = _type_sql(f"regexp_extract({t}, '^optional\\[(.+)\\]$', 1)", depth - 1)
    listed = _type_sql(f"regexp_extract({t}, '^(?:typing\\.)?list\\[(.+)\\]$', 1)", depth - 1)
    return f"""CASE WHEN regexp_matches({t}, '^optional\\[.+\\]$') THEN {optional} WHEN regexp_matches({t}, '^(?:typing\\.)?list\\[.+\\]$') THEN '{{"type":"array","items":' || {listed} || '}}'
        WHEN regexp_matches({t}, '^(?:typing\\.)?(?:dict|mapping)\\[.+\\]$') THEN '{{"type":"object"}}' WHEN regexp_matches({t}, '^(?:typing\\.)?tuple\\[.+\\]$') THEN '{{"type":"array"}}' ELSE {plain} END"""


PARAMS_SQL = rf"""WITH c AS (SELECT tool_id, code, string_split(code, chr(10)) AS lines, regexp_extract(code, '{SIGNATURE}', 1) AS sig, regexp_extract(code, '{SIGNATURE}', 2) AS blob FROM r_tools),
    raw AS (SELECT tool_id, trim(r, {B}) AS r, n FROM (SELECT tool_id, unnest(regexp_split_to_array(trim(blob, {B}), ',\s*')) AS r, generate_subscripts(regexp_split_to_array(trim(blob, {B}), ',\s*'), 1) AS n FROM c)),
    par AS (SELECT tool_id, row_number() OVER (PARTITION BY tool_id ORDER BY n) - 1 AS position, regexp_extract(r, '^([a-zA-Z_]\w*)', 1) AS param,
        CASE WHEN regexp_matches(r, '{TYPED}') THEN trim(regexp_extract(r, '{TYPED}', 2), {B}) END AS t, CASE WHEN regexp_matches(r, '{TYPED}') THEN regexp_extract(r, '{TYPED}', 3) <> '' ELSE regexp_matches(r, '{DEFAULTED}') END AS d
        FROM raw WHERE regexp_matches(r, '{TYPED}') OR regexp_matches(r, '{DEFAULTED}') OR regexp_matches(r, '^[a-zA-Z_]\w*$')),
    l AS (SELECT tool_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM c),
    st AS (SELECT tool_id, min(n) AS s FROM l WHERE regexp_matches(line, '{fixed.DOC_ARGS_LINE}') GROUP BY 1),
    af AS (SELECT l.*, regexp_matches(line, '{fixed.DOC_SECTION_LINE}') AS head, regexp_matches(line, '{fixed.DOC_PARAM_LINE}') AS p FROM l JOIN st USING (tool_id) WHERE n > s),
    fi AS (SELECT tool_id, min(n) FILTER (p AND NOT head) AS f FROM af GROUP BY 1),
    en AS (SELECT tool_id, min(n) FILTER (head OR (trim(line, {B}) = '' AND n > f)) AS e FROM af JOIN fi USING (tool_id) GROUP BY 1),
    doc AS (SELECT tool_id, regexp_extract(line, '{fixed.DOC_PARAM_LINE}', 1) AS param, arg_max(nullif(trim(regexp_extract(line, '{fixed.DOC_PARAM_LINE}', 2), {B}), ''), n) AS dt,
        arg_max(trim(regexp_extract(line, '{fixed.DOC_PARAM_LINE}', 3), {B}), n) AS dd FROM af JOIN en USING (tool_id) WHERE p AND n < coalesce(e, 1e9) GROUP BY ALL),
    mer AS (SELECT par.tool_id, position, par.param, lower(replace(trim(coalesce(dt, t), {B}), ' ', '')) AS t, d, coalesce(dd, '') AS dd FROM par LEFT JOIN doc ON doc.tool_id = par.tool_id AND doc.param = par.param),
    sm AS (SELECT tool_id, arg_min(x, n) AS summary FROM (SELECT tool_id, n, trim(trim(line, {B}), '"''') AS x FROM l) WHERE x <> '' AND NOT starts_with(x, 'def ') GROUP BY 1),
    nm AS (SELECT c.tool_id, c.code, sig, coalesce(summary, 'Generated function from comment') AS summary, regexp_matches(blob, '\[[^\]]*,') AS split_type FROM c LEFT JOIN sm USING (tool_id)),
    nn AS (SELECT tool_id, summary, split_type, CASE WHEN sig <> '' THEN sig ELSE left(CASE WHEN sl = '' THEN 'generated_function' ELSE sl END, 64) END AS name FROM (
        SELECT *, trim(regexp_replace(regexp_replace(lower(trim(summary, {B})), '[^a-z0-9_\-\s]', '', 'g'), '[\s\-]+', '_', 'g'), '_') AS sl FROM nm))
    SELECT tool_id, name, summary AS description, split_type AS type_was_split, coalesce(position, 0) AS position, coalesce(param, 'input') AS param,
    CASE WHEN param IS NULL THEN '{{"type":"string"}}' ELSE {_type_sql('t')} END AS json_type, CASE WHEN param IS NULL THEN 'Free-form input' ELSE dd END AS param_description,
    CASE WHEN param IS NULL THEN true ELSE NOT d AND NOT coalesce(starts_with(t, 'optional['), false) END AS required FROM nn LEFT JOIN mer USING (tool_id)"""


@query("q4_signature_parameters", PARAMS_SQL)
def signature_parameters(spark, folder):
    return extraction.schema_parameters(extraction.tool_schemas(roles.tools(spark, folder)))


FUNCTION_SQL = """SELECT tool_id, name{0}, '{{' || string_agg('"' || param || '":' || CASE WHEN param_description = '' THEN json_type
    ELSE left(json_type, length(json_type) - 1) || ',"description":' || CAST(to_json(param_description) AS VARCHAR) || '}}' END, ',' ORDER BY position) || '}}' AS properties,
    '[' || coalesce(string_agg('"' || param || '"', ',' ORDER BY position) FILTER (required), '') || ']' AS required FROM ({1}) GROUP BY tool_id, name{2}"""


@query("q4_function_schemas", FUNCTION_SQL.format("", PARAMS_SQL, ""))
def function_schemas(spark, folder):
    return extraction.schema_json(extraction.tool_schemas(roles.tools(spark, folder)))


@query("q5_syntax_errors", "SELECT p_partkey AS tool_id, 'SyntaxError' AS error_type, CAST(1 AS BIGINT) AS line FROM part WHERE p_partkey % 8 IN (2, 6)")
def syntax_errors(spark, folder):
    return extraction.syntax_errors(roles.tools(spark, folder))


BLOCK_REPLY = """concat(text, ' <tool1><tag> first </tag><code>```python
def f', CAST(doc_id AS STRING), '():
    pass
``` rest</code></tool1> <tool2>no tag <code>x</code></tool2><tool3><tag>third</tag><code> raw </tool4> ', text, '</code></tool3> <tool5><tag>cut')"""


BLOCKS_SQL = f"""SELECT doc_id AS question_id, CAST(0 AS BIGINT) AS "index", '1' AS tool_number, 'first' AS tag, 'def f' || doc_id || '():' || chr(10) || '    pass' AS code FROM documents
    UNION ALL SELECT doc_id, 2, '3', 'third', trim('raw </tool4> ' || text, {B}) FROM documents"""


def block_replies(spark, folder):
    return roles.documents(spark, folder).select(F.col("doc_id").alias("question_id"), F.expr(BLOCK_REPLY).alias("response"))


@query("q6_tool_blocks", BLOCKS_SQL)
def tool_blocks(spark, folder):
    return extraction.tool_blocks(block_replies(spark, folder))


BLOCK_PARAMS_SQL = PARAMS_SQL.replace("FROM r_tools)", f"""FROM (SELECT question_id || ':' || "index" AS tool_id, code FROM ({BLOCKS_SQL})))""")


@query("q6_block_schemas", f"""SELECT CAST(split_part(tool_id, ':', 1) AS BIGINT) AS question_id, CAST(split_part(tool_id, ':', 2) AS BIGINT) AS "index", CASE split_part(tool_id, ':', 2) WHEN '0' THEN 'first' ELSE 'third' END AS tag,
    name, description, properties, required FROM ({FUNCTION_SQL.format(', description', BLOCK_PARAMS_SQL, ', description')})""")
def block_schemas(spark, folder):
    return extraction.block_schemas(block_replies(spark, folder))


BLUEPRINT = """concat('intro <SIB> ', text, '
[Covered Tools]
Tool 3, tool ', CAST(doc_id % 20 AS STRING), ' and 12, x7
[Next]
zzz 99 </SIB> tail <SIB>  </SIB><SIB>', lang, ' only')"""


@query("q7_blueprint_blocks", f"""SELECT doc_id, CAST(1 AS BIGINT) AS sib_index, trim(text, {B}) || chr(10) || '[Covered Tools]' || chr(10) || 'Tool 3, tool ' || (doc_id % 20) || ' and 12, x7' || chr(10) || '[Next]' || chr(10) || 'zzz 99' AS content,
    array_to_string(list_sort(list_distinct([3, doc_id % 20, 12])), ',') AS covered FROM documents UNION ALL SELECT doc_id, 3, lang || ' only', '' FROM documents""".replace("trim(text, ", "ltrim(text, "))
def blueprint_blocks(spark, folder):
    texts = roles.documents(spark, folder).select(F.col("doc_id").alias("cluster_name"), F.expr(BLUEPRINT).alias("text"))
    parsed = blocks.parse_blocks(texts)
    return parsed.select(
        F.col("cluster_name").alias("doc_id"), F.col("sib_index").cast("bigint").alias("sib_index"), "content",
        F.array_join(F.col("covered").cast("array<string>"), ",").alias("covered"),
    )


@query("q8_scored_choices", f"""SELECT question_id, ground_truth, tail AS pred_answer, regexp_extract(tail, '[A-J]', 0) AS pred_choice, CAST(contains(lower(tail), lower(ground_truth)) AS BIGINT) AS correct_contains,
    CAST(ground_truth <> '' AND regexp_extract(tail, '[A-J]', 0) = ground_truth AS BIGINT) AS correct_choice, ground_truth = '' AS empty_truth FROM {TAILS}""")
def scored_choices(spark, folder):
    return scoring.score_choices(roles.replies(spark, folder)).drop("response", "lang")


@query("q8_accuracy_by_language", f"""SELECT lang, count(*) AS replies, round(avg(CAST(contains(lower(tail), lower(ground_truth)) AS BIGINT)), 6) AS accuracy_contains,
    round(avg(CAST(ground_truth <> '' AND regexp_extract(tail, '[A-J]', 0) = ground_truth AS BIGINT)), 6) AS accuracy_choice FROM {TAILS} JOIN documents ON doc_id = question_id GROUP BY lang""")
def scored_by_language(spark, folder):
    scored = scoring.score_choices(roles.replies(spark, folder))
    return scored.groupBy("lang").agg(
        F.count("*").alias("replies"), F.round(F.avg("correct_contains"), 6).alias("accuracy_contains"), F.round(F.avg("correct_choice"), 6).alias("accuracy_choice")
    )


@query("q8_scoring_variants", f"""WITH t AS (SELECT question_id, ground_truth, contains(response, 'Final Answer:') AS has, trim(split_part(response, 'Final Answer:', -1), {B}) AS tail FROM r_replies),
    v AS (SELECT question_id, ground_truth, CASE WHEN NOT has THEN '' WHEN regexp_matches(tail, '[a-d]') THEN regexp_extract(tail, '[a-d]', 0) ELSE regexp_extract(tail, '\\S+', 0) END AS letter_d,
        CASE WHEN NOT has THEN '' WHEN regexp_matches(tail, '[a-g]') THEN regexp_extract(tail, '[a-g]', 0) ELSE regexp_extract(tail, '\\S+', 0) END AS letter_g, CASE WHEN has THEN rtrim(tail, '.') ELSE '' END AS plain FROM t)
    SELECT question_id, letter_d, letter_g, plain, CAST(contains(lower(letter_d), lower(ground_truth)) AS BIGINT) AS correct_d, CAST(contains(lower(letter_g), lower(ground_truth)) AS BIGINT) AS correct_g,
    CAST(contains(lower(plain), lower(ground_truth)) AS BIGINT) AS correct_plain FROM v""")
def scoring_variants(spark, folder):
    response, truth = F.col("response"), F.col("ground_truth")
    predicted = roles.replies(spark, folder).select(
        "question_id", "ground_truth",
        scoring.predicted_letter(response, fixed.CHOICES_LOWER_A_TO_D).alias("letter_d"),
        scoring.predicted_letter(response, fixed.CHOICES_LOWER_A_TO_G).alias("letter_g"),
        scoring.predicted_plain(response).alias("plain"),
    )
    score = lambda column: scoring.answer_contained(truth, F.col(column))
    return predicted.select(
        "question_id", "letter_d", "letter_g", "plain", score("letter_d").alias("correct_d"), score("letter_g").alias("correct_g"), score("plain").alias("correct_plain")
    )


@query("q8_first_character", f"""SELECT question_id, answer, CAST(contains(lower(answer), lower(ground_truth)) AS BIGINT) AS correct FROM (
    SELECT question_id, ground_truth, substr(trim(split_part(response, 'Final Answer: ', -1), {B}), 1, 1) AS answer FROM r_replies)""")
def first_character(spark, folder):
    """The answer is the first character after the last marker."""
    predicted = roles.replies(spark, folder).select("question_id", "ground_truth", scoring.predicted_first(F.col("response")).alias("answer"))
    return predicted.select("question_id", "answer", scoring.answer_contained(F.col("ground_truth"), F.col("answer")).alias("correct"))


GRADE_TRUTH = "CASE event_id % 4 WHEN 0 THEN CAST(event_id * 100 AS STRING) WHEN 1 THEN concat('1,', lpad(CAST(event_id % 1000 AS STRING), 3, '0'), '.2500001') WHEN 2 THEN ' none ' ELSE concat(CAST(user_id AS STRING), '.750') END"


@query("q9_numeric_grades", f"""SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(a - b) < 1e-6 ELSE trim(s, {B}) = trim(t, {B}) END AS is_correct FROM (
    SELECT event_id, s, t, {NUMBER_SQL.format('s')} AS a, {NUMBER_SQL.format('t')} AS b FROM (SELECT event_id, {NUMBERS.replace('AS STRING', 'AS VARCHAR')} AS s, {GRADE_TRUTH.replace('AS STRING', 'AS VARCHAR')} AS t FROM events))""")
def numeric_grades(spark, folder):
    return table(spark, folder, "events").select("event_id", scoring.grade_number(F.expr(NUMBERS), F.expr(GRADE_TRUTH)).alias("is_correct"))


@query("q10_public_functions", """SELECT tool_id, CASE tool_id % 8 WHEN 3 THEN '' WHEN 4 THEN '' WHEN 6 THEN name WHEN 7 THEN 'execute' ELSE name END AS public_name FROM r_tools""")
def public_functions(spark, folder):
    parsed = roles.tools(spark, folder).withColumn("_s", pycode.python_syntax(F.col("code")))
    return parsed.select("tool_id", pycode.public_function(F.col("code"), F.col("_s.valid")).alias("public_name"))
