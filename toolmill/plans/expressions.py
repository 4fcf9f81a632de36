"""Scalar expressions (X1-X20) over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.functions import code as pycode
from toolmill.functions import fixed, text
from toolmill.plans import roles
from toolmill.plans.registry import query
from toolmill.sources.readers import spread, table

B = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

FENCED = """CASE doc_id % 7 WHEN 0 THEN text WHEN 1 THEN concat('
 ```python
', text, '
```') WHEN 2 THEN concat('```', text, '``` tail') WHEN 3 THEN concat('intro ```python
', text, '
``` and ```x```') WHEN 4 THEN concat('a <code> ', text, '
</code> b') WHEN 5 THEN concat('python
', text, ' ') ELSE concat('open ```python
', text) END"""


def fenced(spark, folder):
    return roles.documents(spark, folder).select("doc_id", F.expr(FENCED).alias("s"))


F_SQL = f"(SELECT doc_id, {FENCED} AS s FROM documents)"


def _inside(n: int, fence: str) -> str:
    rest = f"substr(c, strpos(c, '{fence}') + {n})"
    closed = f"regexp_extract({rest}, '(?s)^(.+)```', 1)"
    return f"rtrim(ltrim(CASE WHEN {closed} <> '' THEN {closed} ELSE {rest} END, chr(10)), {B})"


@query("x1_stripped_fences", f"""SELECT doc_id, CASE WHEN contains(c, '```python') THEN {_inside(9, '```python')} WHEN starts_with(c, '```') THEN {_inside(3, '```')}
    WHEN starts_with(c, 'python' || chr(10)) THEN rtrim(substr(c, 8), {B}) ELSE c END AS code FROM (SELECT doc_id, ltrim(s, {B}) AS c FROM {F_SQL})""")
def stripped_fences(spark, folder):
    return fenced(spark, folder).select("doc_id", text.strip_fences(F.col("s")).alias("code"))


@query("x2_code_from_reply", f"""SELECT doc_id, CASE WHEN regexp_matches(s, '(?s)<code>\\s*(.*?)\\s*</code>') THEN trim(regexp_extract(s, '(?s)<code>\\s*(.*?)\\s*</code>', 1), {B})
    WHEN contains(s, '```python') THEN trim(CASE WHEN ends_with(p, '```') THEN left(p, length(p) - 3) ELSE p END, {B})
    WHEN contains(s, '```') THEN trim(CASE WHEN ends_with(q, '```') THEN left(q, length(q) - 3) ELSE q END, {B}) ELSE trim(s, {B}) END AS code
    FROM (SELECT doc_id, s, split_part(s, '```python', 2) AS p, split_part(s, '```', 2) AS q FROM {F_SQL})""")
def code_from_reply(spark, folder):
    return fenced(spark, folder).select("doc_id", text.code_from_reply(F.col("s")).alias("code"))


@query("x3_first_program", f"""SELECT doc_id, CASE WHEN regexp_matches(s, '(?s)```python\\n(.*?)\\n```') THEN regexp_extract(s, '(?s)```python\\n(.*?)\\n```', 1)
    WHEN regexp_matches(s, '(?s)```(.*?)```') THEN regexp_extract(s, '(?s)```(.*?)```', 1) ELSE s END AS program FROM {F_SQL}""")
def first_program(spark, folder):
    return fenced(spark, folder).select("doc_id", text.first_program(F.col("s")).alias("program"))


@query("x4_texts_between_tags", "SELECT doc_id, CAST(0 AS BIGINT) AS i, text AS part FROM documents UNION ALL SELECT doc_id, 1, CAST(doc_id AS VARCHAR) FROM documents")
def texts_between_tags(spark, folder):
    tagged = F.concat(F.lit("x <output>"), F.col("text"), F.lit("</output> y <output>"), F.col("doc_id").cast("string"), F.lit("</output> <output>open"))
    found = roles.documents(spark, folder).select("doc_id", F.posexplode(text.between_tags(tagged, "<output>", "</output>")).alias("i", "part"))
    return found.select("doc_id", F.col("i").cast("bigint").alias("i"), "part")


TAIL = f"""CASE WHEN NOT contains(response, 'Final Answer') THEN '' WHEN contains(t, 'boxed{{') THEN trim(split_part(t, 'boxed{{', 2), {B}) ELSE t END"""
TAILS = f"(SELECT question_id, ground_truth, {TAIL} AS tail FROM (SELECT *, trim(split_part(response, 'Final Answer', -1), {B}) AS t FROM r_replies))"


@query("x5_answer_tails", f"SELECT question_id, tail FROM {TAILS}")
def answer_tails(spark, folder):
    return roles.replies(spark, folder).select("question_id", text.answer_tail(F.col("response")).alias("tail"))


@query("x6_first_choices", f"SELECT question_id, regexp_extract(tail, '[A-J]', 0) AS choice FROM {TAILS}")
def first_choices(spark, folder):
    return roles.replies(spark, folder).select("question_id", text.first_choice(text.answer_tail(F.col("response"))).alias("choice"))


@query("x7_clean_predictions", f"""SELECT question_id, CASE WHEN contains(response, 'Final Answer:') THEN regexp_extract(trim(trim(split_part(response, 'Final Answer:', -1), {B}), '. '), '\\S+', 0) ELSE '' END AS pred FROM r_replies""")
def clean_predictions(spark, folder):
    return roles.replies(spark, folder).select("question_id", text.clean_prediction(F.col("response")).alias("pred"))


SEARCH = """CASE doc_id % 6 WHEN 0 THEN concat('Search Query: "', text, '"') WHEN 1 THEN concat(' "', source, '" ') WHEN 2 THEN '"' WHEN 3 THEN 'ab' WHEN 4 THEN concat('Search Query: x Search Query: ', text) ELSE '' END"""


@query("x8_search_queries", f"""SELECT doc_id, CASE WHEN length(u) < 3 THEN text ELSE u END AS query FROM (SELECT doc_id, text,
    CASE WHEN starts_with(m, '"') AND ends_with(m, '"') THEN CASE WHEN length(m) < 2 THEN '' ELSE substr(m, 2, length(m) - 2) END ELSE m END AS u FROM (
    SELECT doc_id, text, CASE WHEN contains(s, 'Search Query:') THEN trim(split_part(s, 'Search Query:', -1), {B}) ELSE s END AS m FROM (
    SELECT doc_id, text, trim({SEARCH}, {B}) AS s FROM documents)))""")
def search_queries(spark, folder):
    docs = roles.documents(spark, folder)
    return docs.select("doc_id", text.clean_search_query(F.expr(SEARCH), F.col("text")).alias("query"))


REPORT = """concat(text, CASE doc_id % 5 WHEN 0 THEN ' is_library_helpful: PASS. Correct, no error.' WHEN 1 THEN ' is_library_helpful: NEED_PATCHING, insufficient'
 WHEN 2 THEN ' is_library_helpful unclear: wrong and not helpful' WHEN 3 THEN ' Exception: failed, ERROR error' ELSE '' END)"""


def _any(words) -> str:
    return " OR ".join(f"contains(l, '{w}')" for w in words)


@query("x9_report_indicators", f"""SELECT doc_id, length(r) > 0 AS report_available, {_any(fixed.PASS_WORDS)} AS contains_pass, {_any(fixed.PATCH_WORDS)} AS contains_need_patching, {_any(fixed.ERROR_WORDS)} AS contains_error,
    length(r) AS report_length, CASE WHEN contains(r, 'is_library_helpful') THEN CASE WHEN contains(r, 'PASS') THEN 'PASS' WHEN contains(r, 'NEED_PATCHING') THEN 'NEED_PATCHING' ELSE 'UNKNOWN' END END AS library_helpful_status, """
    + ", ".join(f"len(string_split(l, '{w}')) - 1 AS {w}_mentions" for w in fixed.COUNTED_WORDS)
    + f" FROM (SELECT doc_id, {REPORT} AS r, lower({REPORT}) AS l FROM documents)")
def report_indicators(spark, folder):
    reports = roles.documents(spark, folder).select("doc_id", F.expr(REPORT).alias("r"))
    return reports.select("doc_id", *text.report_indicators(F.col("r")))


EXPERIENCE = "concat('EFFECTIVENESS_STATUS: ', CASE WHEN doc_id % 2 = 0 THEN 'EFFECTIVE' ELSE 'INEFFECTIVE' END, ' <experience_list> ', text, ' </experience_list> <experience_list>second</experience_list>')"


@query("x10_experience", f"SELECT doc_id, trim(text, {B}) AS experience, doc_id % 2 = 0 AS effective FROM documents")
def experience(spark, folder):
    s = F.expr(EXPERIENCE)
    return roles.documents(spark, folder).select("doc_id", text.experience_list(s).alias("experience"), text.is_effective(s).alias("effective"))


@query("x11_equal_outputs", "SELECT doc_id, doc_id % 3 <> 0 OR translate(text, chr(10), '') = translate(text, chr(10), ' ') AS same FROM documents")
def equal_outputs(spark, folder):
    other = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "\n", " ")).when(F.col("doc_id") % 3 == 1, F.translate("text", "\n", "\r")).otherwise(F.translate("text", "\n", ""))
    return roles.documents(spark, folder).select("doc_id", text.same_without_line_breaks(F.col("text"), other).alias("same"))


REPORT_JSON = """CASE doc_id % 4 WHEN 0 THEN concat(text, '<final_report> {"is_SIB_helpful": "PASS", "modification_suggestions": "use ', source, '"} </final_report>')
 WHEN 1 THEN concat('report {"modification_suggestions":  "drop ', lang, '", "n": {"m": 1}} end ', text) WHEN 2 THEN concat('<final_report>not json</final_report> {"is_SIB_helpful": "NO"}', text) ELSE text END"""


@query("x12_report_json", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'use ' || source WHEN 1 THEN 'drop ' || lang ELSE '' END AS suggestion, CASE doc_id % 4 WHEN 0 THEN 'PASS' ELSE '' END AS status FROM documents""")
def report_json(spark, folder):
    parsed = roles.documents(spark, folder).select("doc_id", text.report_json(F.expr(REPORT_JSON)).alias("v"))
    value = lambda path: F.coalesce(F.try_variant_get("v", path, "string"), F.lit(""))
    return parsed.select("doc_id", value("$.modification_suggestions").alias("suggestion"), value("$.is_SIB_helpful").alias("status"))


OPERATIONS = """CASE event_id % 4 WHEN 0 THEN concat('[{"action":"ADD_NODE","node_id":"a', CAST(event_id AS STRING), '"},[{"action":"MODIFY_NODE","node_id":"b', CAST(user_id AS STRING), '"},3],"x"]')
 WHEN 1 THEN concat('{"operations":[{"action":"ADD_NODE","node_id":"a', CAST(event_id AS STRING), '"},[],[{"action":"MODIFY_NODE","node_id":"b', CAST(user_id AS STRING), '"}]]}') WHEN 2 THEN '{"operations":"none"}' ELSE 'not json' END"""


@query("x13_operation_lists", """SELECT event_id, CAST(0 AS BIGINT) AS i, 'ADD_NODE' AS action, 'a' || event_id AS node_id FROM events WHERE event_id % 4 < 2
    UNION ALL SELECT event_id, 1, 'MODIFY_NODE', 'b' || user_id FROM events WHERE event_id % 4 < 2""")
def operation_lists(spark, folder):
    listed = spread(table(spark, folder, "events").select("event_id", "user_id"), "event_id").select("event_id", F.posexplode(text.operation_list(F.expr(OPERATIONS))).alias("i", "op"))
    value = lambda path: F.try_variant_get("op", path, "string")
    return listed.select("event_id", F.col("i").cast("bigint").alias("i"), value("$.action").alias("action"), value("$.node_id").alias("node_id"))


@query("x14_suggestion_fields", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'use ' || source WHEN 1 THEN 'drop ' || lang ELSE '' END AS suggestion FROM documents")
def suggestion_fields(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.suggestion_field(F.expr(REPORT_JSON)).alias("suggestion"))


INDICES = """concat('<answer>[', CAST(event_id % 35 AS STRING), ', -3, ', CAST(user_id % 40 AS STRING), ']</answer> and <answer>tools ', CAST(event_id % 11 AS STRING), ' or -', CAST(user_id % 7 AS STRING), '</answer>')"""


@query("x15_answer_indices", """SELECT DISTINCT event_id, i FROM (SELECT event_id, unnest([event_id % 35, user_id % 40, event_id % 11, user_id % 7]) AS i FROM events) WHERE i < 30""")
def answer_indices(spark, folder):
    found = text.answer_indices(F.expr(INDICES), F.lit(30))
    return spread(table(spark, folder, "events").select("event_id", "user_id"), "event_id").select("event_id", F.explode(found).alias("i"))


@query("x16_comma_items", f"""SELECT doc_id, i - 1 AS i, item FROM (SELECT doc_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM (
    SELECT doc_id, list_filter([trim(x, {B}) for x in string_split(text, ',')], lambda x: x <> '') AS items FROM documents))""")
def comma_items(spark, folder):
    listed = roles.documents(spark, folder).select("doc_id", F.posexplode(text.comma_items(F.col("text"))).alias("i", "item"))
    return listed.select("doc_id", F.col("i").cast("bigint").alias("i"), "item")


NUMBERS = """CASE event_id % 6 WHEN 0 THEN concat(' about 1,', lpad(CAST(event_id % 1000 AS STRING), 3, '0'), '.25 units') WHEN 1 THEN concat('n = ', CAST(event_id * 100 AS STRING))
 WHEN 2 THEN concat('-.5 or ', CAST(user_id AS STRING)) WHEN 3 THEN 'none' WHEN 4 THEN concat('-', CAST(user_id AS STRING), '.75') ELSE props END"""
NUMBER_SQL = r"TRY_CAST(replace(nullif(regexp_extract({}, '(-?\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?|-?\.\d+)', 1), ''), ',', '') AS DOUBLE)"


@query("x17_numbers", f"SELECT event_id, coalesce({NUMBER_SQL.format('s')}, -99999) AS number FROM (SELECT event_id, {NUMBERS.replace('AS STRING', 'AS VARCHAR')} AS s FROM events)")
def numbers(spark, folder):
    return table(spark, folder, "events").select("event_id", F.coalesce(text.number_in(F.expr(NUMBERS)), F.lit(-99999.0)).alias("number"))


@query("x18_names_and_docstrings", rf"""SELECT tool_id, regexp_extract(code, 'def\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1) AS function_name, regexp_extract(code, 'class\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1) AS class_name,
    trim(regexp_extract(code, '(?s)def\s.*?:\s*(?:\"\"\"(.*?)\"\"\")?', 1), {B}) AS function_doc, trim(regexp_extract(code, '(?s)class\s.*?:\s*(?:\"\"\"(.*?)\"\"\")?', 1), {B}) AS class_doc,
    split_part(trim(regexp_extract(code, '(?s)class\s.*?:\s*(?:\"\"\"(.*?)\"\"\")?', 1), {B}), chr(10), 1) AS class_line FROM r_tools""".replace('\\"', '"'))
def names_and_docstrings(spark, folder):
    code = F.col("code")
    class_doc = pycode.docstring(code, "class")
    return roles.tools(spark, folder).select(
        "tool_id", pycode.first_function(code).alias("function_name"), pycode.first_class(code).alias("class_name"),
        pycode.docstring(code).alias("function_doc"), class_doc.alias("class_doc"), pycode.first_line(class_doc).alias("class_line"),
    )


@query("x19_top_level_blocks", rf"""WITH l AS (SELECT tool_id, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS n FROM r_tools),
    b AS (SELECT *, sum(CAST(regexp_matches(line, '^(def|class)\s') AS INT)) OVER (PARTITION BY tool_id ORDER BY n) AS block FROM l)
    SELECT tool_id, CAST(block - 1 AS BIGINT) AS block, trim(string_agg(line, chr(10) ORDER BY n), {B}) AS code FROM b WHERE block > 0 GROUP BY tool_id, block""")
def top_level_blocks(spark, folder):
    parts = roles.tools(spark, folder).select("tool_id", F.posexplode(pycode.top_level_blocks(F.col("code"))).alias("block", "code"))
    return parts.select("tool_id", F.col("block").cast("bigint").alias("block"), "code")


def _called(name: str) -> str:
    return f"len(list_filter(string_split(code, chr(10)), lambda l: NOT regexp_matches(ltrim(l, {B}), '^(import|from|#)') AND contains(l, {name} || '('))) > 0"


@query("x20_calls", f"SELECT tool_id, {_called('name')} AS calls_own, {_called(chr(39) + '_helper' + chr(39))} AS calls_helper, {_called(chr(39) + 'fine' + chr(39))} AS calls_fine FROM r_tools")
def calls(spark, folder):
    code = F.col("code")
    return roles.tools(spark, folder).select(
        "tool_id", pycode.is_called(code, F.col("name")).alias("calls_own"), pycode.is_called(code, F.lit("_helper")).alias("calls_helper"),
        pycode.is_called(code, F.lit("fine")).alias("calls_fine"),
    )
