"""Edge rows with literal expected results."""

import pytest
from pyspark.sql import functions as F

from toolmill.functions import code as pycode
from toolmill.functions import schema, scoring, text, vectors
from toolmill.functions import text as tools_text
from toolmill.operators import blocks, catalog, cluster, extraction, metrics, ordering, retrieve, usage
from toolmill.sources import readers


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column, **cells):
    """Value of an expression over one row of string cells."""
    names = list(cells)
    df = spark.createDataFrame([tuple(cells[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


# --- scoring ------------------------------------------------------------------

def test_contains_and_choice_differ(rows):
    replies = rows("question_id bigint, response string, ground_truth string", [
        (1, "so. Final Answer: C, then", "E"), (2, "anything", ""), (3, "C", "C"), (4, "Final Answer: boxed{B} done", "B"), (5, "Final Answer: C", "C"),
    ])
    scored = scoring.score_choices(replies)
    assert values(scored, "question_id", "correct_contains", "correct_choice", "empty_truth") == [
        (1, 1, 0, False), (2, 1, 0, True), (3, 0, 0, False), (4, 1, 1, False), (5, 1, 1, False),
    ]
    assert values(scored, "question_id", "pred_answer")[2] == (3, "")


def test_eval_type_is_checked(rows):
    with pytest.raises(ValueError):
        scoring.score_choices(rows("response string, ground_truth string", [("a", "b")]), eval_type="essay")


def test_number_type_is_graded(rows):
    replies = rows("question_id bigint, response string, ground_truth string", [
        (1, "Final Answer: 1,234.50", "1234.5"), (2, "Final Answer: 0.5", "0.5000001"), (3, "Final Answer: yes", "yes"), (4, "Final Answer: 2", "3"),
    ])
    # without commas only three digits are read, so 1234.5 is 123
    assert values(scoring.score_choices(replies, "number"), "question_id", "correctness") == [(1, 0), (2, 1), (3, 1), (4, 0)]


@pytest.mark.parametrize(("response", "letter"), [
    ("Final Answer: c.", "c"), ("Final Answer: Zed xx", "d"), ("Final Answer: XYZ 1", "XYZ"), ("Final Answer: ", ""), ("none", ""),
])
def test_letter_variant(spark, response, letter):
    assert one(spark, scoring.predicted_letter(F.col("r"), "[a-d]"), r=response) == letter


# --- metrics --------------------------------------------------------------------

ATTEMPTS = "question_id string, attempt bigint, model string, correctness bigint"


@pytest.mark.parametrize(("single", "expected"), [(0, [(1, 66.6667), (2, 66.6667)]), (1, [(1, 100.0), (2, 66.6667)])])
def test_pass_at_k_with_a_short_question(rows, single, expected):
    attempts = rows(ATTEMPTS, [("a", 0, "m", single), ("b", 0, "m", 1), ("b", 1, "m", 0), ("c", 0, "m", 1), ("c", 1, "m", 0)])
    got = metrics.pass_at_k(attempts, [1, 2])
    assert [(k, round(p, 4)) for k, p in values(got, "k", "pass_at_k")] == expected


def test_attempts_are_separate_rows(rows):
    expanded = metrics.expand_attempts(rows("question_id string", [("q_0",)]), 3)
    assert values(expanded, "id") == [("q_0_0",), ("q_0_1",), ("q_0_2",)]
    assert values(expanded.select(metrics.split_attempt_id(F.col("id")).alias("q")), "q") == [("q_0",)] * 3


def test_questions_without_replies_count_wrong(rows):
    accuracy = metrics.run_accuracy(rows(ATTEMPTS, [("a", 0, "m", 1)]), rows("question_id string", [("a",), ("b",)]))
    assert values(accuracy, "model", "correct", "questions", "accuracy") == [("m", 1, 2, 0.5)]


# --- clusters ---------------------------------------------------------------------

ASSIGNED = "tool_id bigint, cluster_id string, cluster_ids array<string>"


def test_target_order(rows):
    nodes = rows("id string, level bigint, parent string", [("a", 0, None), ("n", 1, "a")])
    targets = cluster.resolve_targets(rows(ASSIGNED, [
        (1, "n", ["a"]), (2, "u", ["a", "b"]), (3, "u", ["x", "y"]), (4, "u", []), (5, None, []), (6, None, None), (7, None, ["n", "a"]), (8, "u", None),
    ]), nodes)
    assert values(targets.fillna("-"), "tool_id", "target", "rule") == [
        (1, "n", "exact"), (2, "a", "path"), (3, "y", "new_from_path"), (4, "u", "new_from_own"), (5, "-", "reject"), (6, "-", "reject"), (7, "a", "path"), (8, "u", "new_from_own"),
    ]


@pytest.mark.parametrize(("n", "sizes"), [(300, [300]), (301, [151, 150]), (601, [201, 200, 200]), (749, [250, 250, 249]), (1, [1])])
def test_chunk_sizes(spark, n, sizes):
    members = spark.range(n).select(F.lit("c").alias("cluster_id"), F.col("id").alias("pos"))
    chunks = cluster.split_evenly(members, "pos").groupBy("cluster_name").agg(F.count("*").alias("n"), F.max("chunk_pos").alias("last"), F.min("pos").alias("first")).orderBy("first").collect()
    assert [c["n"] for c in chunks] == sizes
    assert [c["last"] + 1 for c in chunks] == sizes
    assert [c["cluster_name"] for c in chunks] == (["c"] if len(sizes) == 1 else [f"c_{i}" for i in range(len(sizes))])


def test_public_function_is_not_read_from_text(spark):
    text_first = 'NOTE = """\ndef fake(y):\n"""\n# """\ndef real(x):\n    return "it\'s"\n\ndef _own(z):\n    pass'
    assert one(spark, pycode.public_function(F.col("c")), c=text_first) == "real"
    assert one(spark, pycode.public_function(F.col("c")), c="def a(x):\n    return '" + "\\\\" * 400 + "q" * 50_000 + "'\n") == "a"


def test_tools_of_another_width_take_no_part(rows):
    tools = rows("tool_id bigint, vec array<double>", [(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0, 1.0])])
    queries = rows("query_id bigint, vec array<double>", [(7, [0.0, 2.0, 0.0])])
    assert values(retrieve.top_k(tools, queries, 3), "query_id", "tool_id", "score") == [(7, 2, 1.0)]
    own = retrieve.top_k(tools, tools.withColumnRenamed("tool_id", "query_id"), 1)
    assert values(own, "query_id", "tool_id", "score") == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]


def test_vectors_that_are_no_numbers_take_no_part(rows):
    """They are listed as errors, whatever their width, and never rank."""
    nan, inf = float("nan"), float("inf")
    tools = rows("tool_id bigint, vec array<float>", [(1, [nan, 1.0]), (2, [0.0, 1.0]), (3, [None, 1.0]), (4, [inf, 0.0]), (5, None), (6, []), (7, [1.0, 0.0]), (8, [1.0, 1.0, 1.0])])
    queries = rows("query_id bigint, vec array<float>", [(1, [0.0, 1.0]), (2, [nan, 0.0]), (3, None), (4, [1e30, 1e30])])
    found = values(retrieve.top_k(tools, queries, 5), "query_id", "tool_id", "score")
    assert found == [(1, 2, 1.0), (1, 7, 0.0), (4, 2, 0.707107), (4, 7, 0.707107)]
    assert values(retrieve.dimension_errors(tools, 2), "tool_id") == [(1,), (3,), (4,), (6,), (8,)]


def test_recall_summary_counts_questions_without_truth_as_zero(rows):
    questions = rows("question_id bigint", [(1,), (2,), (3,)])
    retrieved = rows("question_id bigint, name string, rank bigint", [(1, "a", 1), (2, "b", 1), (2, "c", 2)])
    truth = rows("question_id bigint, name string", [(1, "a"), (2, "c"), (2, "x")])
    got = retrieve.recall_summary(retrieve.recall_at(questions, retrieved, truth, (1, 3)), (1, 3))
    assert [tuple(round(x, 4) for x in r) for r in got.collect()] == [(1, 0.3333, 0.4714, 0.0, 1.0, 1, 2), (3, 0.5, 0.4082, 0.0, 1.0, 1, 1)]
    total = retrieve.retrieval_totals(retrieve.recall(questions, retrieved, truth)).first()
    assert (total["total_attempts"], total["successful_retrievals"], total["total_ground_truth_tools"], total["avg_retrieved_tools"]) == (3, 2, 3, 1.5)


def test_small_and_braced_clusters_are_dropped(rows):
    sizes = rows("cluster_id string, n bigint", [("a", 50), ("b", 49), ("c}", 900)])
    assert values(sizes.where(cluster.eligible(F.col("cluster_id"), F.col("n"))), "cluster_id") == [("a",)]


def test_missing_children_become_nodes(rows):
    nodes = rows("id string, level bigint, parent string", [("r", 0, None), ("n", 1, "r")])
    edges = rows("parent string, child string, seq bigint", [("r", "n", 0), ("r", "m", 1), ("n", "x", 2), ("ghost", "y", 3), ("r", "x", 4)])
    assert values(cluster.complete_nodes(nodes, edges).fillna("-"), "id", "level", "parent") == [("m", 1, "r"), ("n", 1, "r"), ("r", 0, "-"), ("x", 2, "n")]


def test_children_of_missing_children_become_nodes(rows):
    nodes = rows("id string, level bigint, parent string", [("r", 0, None)])
    edges = rows("parent string, child string, seq bigint", [("r", "a", 0), ("a", "b", 1), ("b", "a", 2), ("b", "c", 3), ("ghost", "y", 4)])
    whole = cluster.complete_nodes(nodes, edges)
    assert values(whole.fillna("-"), "id", "level", "parent") == [("a", 1, "r"), ("b", 2, "a"), ("c", 3, "b"), ("r", 0, "-")]
    assert values(cluster.unreached_edges(whole, edges), "parent", "child") == [("ghost", "y")]


OPERATION = "seq bigint, action string, node_id string, level bigint, parent string, add_children array<string>"


def operations(rows):
    return rows(OPERATION, [
        (1, "MODIFY_NODE", "late", None, None, ["early"]), (2, "ADD_NODE", "late", 1, "r", None), (3, "MODIFY_NODE", "late", None, None, ["x", "x", "y"]),
        (4, "ADD_NODE", "lost", 1, "nowhere", None), (5, "MODIFY_NODE", "nobody", None, None, ["z"]), (6, "DROP_NODE", "r", None, None, None), (7, "MODIFY_NODE", "late", None, None, ["y", "w"]),
    ])


def test_operations_judge_existence_at_their_place(rows):
    nodes = rows("id string, level bigint, parent string", [("r", 0, None)])
    edges = rows("parent string, child string", [("r", "old")])
    new_nodes, new_edges = cluster.apply_operations(nodes, edges, operations(rows))
    assert values(new_nodes, "id") == [("late",), ("lost",), ("r",)]
    assert values(new_edges, "parent", "child", "seq") == [("late", "w", 7), ("late", "x", 3), ("late", "y", 3), ("r", "late", 2), ("r", "old", -1)]


def test_operations_twice_are_operations_once(rows):
    nodes = rows("id string, level bigint, parent string", [("r", 0, None)])
    edges = rows("parent string, child string", [("r", "old")])
    log = operations(rows).where("seq <> 1")
    once = cluster.apply_operations(nodes, edges, log)
    twice = cluster.apply_operations(*once, log)
    assert values(once[0], "id") == values(twice[0], "id")
    assert values(once[1], "parent", "child", "seq") == values(twice[1], "parent", "child", "seq")


def test_assignment_replies(rows):
    batches = rows("batch_id bigint, batch_index bigint", [(0, 0), (0, 1), (0, 2), (1, 0)])
    reply = '{"assignments":[{"tool_index":0,"assigned_cluster_id":"a","reasoning":"r"},{"tool_index":9,"assigned_cluster_id":"z"},{"assigned_cluster_id":"n"},{"tool_index":0,"assigned_cluster_id":"b"},{"tool_index":1}]}'
    applied = cluster.apply_assignments(batches, rows("batch_id bigint, reply string", [(0, reply), (1, "broken")]))
    missing = "Tool was not assigned by the API."
    assert values(applied.fillna("-"), "batch_id", "batch_index", "cluster_id", "reasoning") == [(0, 0, "b", ""), (0, 1, "-", ""), (0, 2, "-", missing), (1, 0, "-", missing)]


# --- blocks ---------------------------------------------------------------------------

def test_positions_outside_the_cluster_drop_out(rows):
    cover = rows("cluster_name string, sib_index bigint, covered bigint", [("c", 1, 0), ("c", 1, 2), ("c", 1, 9)])
    tools = rows("cluster_name string, pos bigint", [("c", 0), ("c", 1), ("c", 2)])
    assert values(blocks.covered_tools(cover, tools), "pos") == [(0,), (2,)]
    assert values(blocks.covered_tools(cover, tools, 1), "pos") == [(1,)]


def test_first_and_last_answers(rows):
    tools = rows("cluster_name string, pos bigint, question string, answer string", [("c", 0, "q", "1"), ("c", 1, "q", "2"), ("c", 2, "", "3")])
    cover = rows("cluster_name string, sib_index bigint, covered bigint", [("c", 1, 0), ("c", 1, 1), ("c", 1, 2)])
    assert values(blocks.block_questions(cover, tools), "question", "answer", "pos") == [("q", "1", 0)]
    assert values(blocks.cluster_questions(tools), "question", "answer", "first_pos") == [("q", "2", 0)]


def test_more_results_than_tools_is_negative(rows):
    cover = rows("cluster_name string, sib_index bigint, covered bigint", [("c", 1, 0), ("c", 2, 7)])
    tools = rows("cluster_name string, pos bigint", [("c", 0)])
    results = rows("cluster_name string, sib_index bigint, success boolean", [("c", 1, True), ("c", 1, False), ("c", 1, None)])
    got = blocks.solver_performance(cover, tools, results)
    assert values(got, "sib_index", "original_tools", "questions_optimized", "questions_failed", "questions_unoptimized") == [(1, 1, 3, 1, -2), (2, 0, 0, 0, 0)]


def test_patching_comes_before_pass(rows):
    results = rows("success boolean, final_report string", [(True, "NEED_PATCHING or PASS"), (True, "PASS"), (True, "hm"), (False, "PASS"), (True, None)])
    assert sorted(r["outcome"] for r in blocks.classify_results(results).collect()) == ["failed", "failed", "failed", "needs_patching", "passed"]


def test_blueprint_blocks(rows):
    body = "x <SIB> one\n[Covered Tools]\nTool 2, 0 and tool 10\n[Other] 5 </SIB> mid <SIB></SIB><SIB>two [covered tools]\n7"
    parsed = blocks.parse_blocks(rows("cluster_name string, text string", [("c", body)]))
    assert [(r["sib_index"], list(r["covered"])) for r in parsed.orderBy("sib_index").collect()] == [(1, [0, 2, 10]), (3, [7])]


# --- catalog -----------------------------------------------------------------------------

def test_registry_last_and_pool_first(rows):
    tools = rows("name string, pos bigint, code string", [("f", 0, "first"), ("f", 1, "second"), ("g", 2, "only")])
    assert values(catalog.registry(tools, ["code"]), "name", "code") == [("f", "second"), ("g", "only")]
    assert values(catalog.pool(tools, ["code"]), "name", "code") == [("f", "first"), ("g", "only")]


def test_format_is_decided_per_row(rows):
    tools = rows("tool_id bigint, tool_info string, tool_code string, description string, python string", [
        (1, "i", "c", None, None), (2, None, None, "d", "p"), (3, "i", None, "d", None),
    ])
    assert values(catalog.unify_formats(tools).fillna("-"), "tool_id", "format", "info", "code") == [(1, "v2", "i", "c"), (2, "valid_science", "d", "p"), (3, "unknown", "i", "-")]


def test_fingerprint_depends_on_content_and_order(rows):
    ddl = "s bigint, pos bigint, name string, description string"
    sets = rows(ddl, [(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "a", "x"), (2, 1, "b", "y"), (3, 0, "b", "y"), (3, 1, "a", "x"), (4, 0, "a", "x"), (4, 1, "b", "z")])
    prints = {r["s"]: r["fingerprint"] for r in catalog.set_fingerprint(sets, ["s"], "pos").collect()}
    assert prints[1] == prints[2] and len(set(prints.values())) == 3


# --- extraction ----------------------------------------------------------------------------

def test_nested_tool_number(rows):
    reply = "<tool2><tag>t</tag><code>c</tool3>d</code></tool2><tool4><code>no tag</code></tool4>"
    found = extraction.tool_blocks(rows("question_id bigint, response string", [(1, reply)]))
    assert values(found, "index", "tool_number", "tag", "code") == [(0, "2", "t", "c</tool3>d")]


def test_syntax(rows):
    tools = rows("tool_id bigint, code string", [(1, ""), (2, "  \n"), (3, "def f():\n  return 1"), (4, "x = 1\ndef f(:\n"), (5, None), (6, "a\0b")])
    errors = values(extraction.syntax_errors(tools), "tool_id", "error_type")
    assert errors == [(4, "SyntaxError"), (6, "SyntaxError")] or errors == [(4, "SyntaxError"), (6, "ValueError")]


def test_signature(rows):
    source = 'def f(a: Optional[int], b, *, c: List[Dict[str, int]] = None, d="x", e: list[list[bool]]) -> int:\n    """Sum.\n\n    Args:\n        b (float): the b\n        zz: not a parameter\n\n        a: after blank\n    """'
    schemas = extraction.tool_schemas(rows("tool_id bigint, code string", [(1, source), (2, "a comment only")]))
    got = values(extraction.schema_parameters(schemas), "tool_id", "position", "param", "json_type", "param_description", "required")
    string = '{"type":"string"}'
    assert got == [
        (1, 0, "a", '{"type":"integer"}', "", False),
        (1, 1, "b", '{"type":"number"}', "the b", True),
        (1, 2, "c", string, "", True),
        (1, 3, "d", string, "", False),
        (1, 4, "e", '{"type":"array","items":{"type":"array","items":{"type":"boolean"}}}', "", True),
        (2, 0, "input", string, "Free-form input", True),
    ]
    assert values(schemas, "tool_id", "name", "description", "type_was_split") == [(1, "f", "Sum.", True), (2, "a_comment_only", "a comment only", False)]


@pytest.mark.parametrize(("declared", "expected"), [
    ("int", '{"type":"integer"}'), ("Optional[List[str]]", '{"type":"array","items":{"type":"string"}}'), ("dict[str]", '{"type":"object"}'),
    ("Tuple[int]", '{"type":"array"}'), ("typing.List[Mapping[a]]", '{"type":"array","items":{"type":"object"}}'), ("list[tuple[int", '{"type":"string"}'),
    ("list[]", '{"type":"string"}'), ("List[list[]]", '{"type":"array","items":{"type":"string"}}'), ("list[optional[int]", '{"type":"array","items":{"type":"string"}}'), ("Widget", '{"type":"string"}'),
])
def test_declared_types(spark, declared, expected):
    assert one(spark, pycode.json_type(pycode.normal_type(F.col("t"))), t=declared) == expected


@pytest.mark.parametrize(("source", "name"), [
    ("def a(x):\n  pass", "a"), ("def _a():\n  pass\ndef b():\n  pass", "b"), ("def a():\n  pass\ndef execute():\n  pass", "execute"),
    ("def a():\n  pass\ndef b():\n  pass", "a"), ("class A:\n  def run(self):\n    pass", ""), ("async def z():\n  pass", "z"), ("", ""),
])
def test_public_function(spark, source, name):
    assert one(spark, pycode.public_function(F.col("s")), s=source) == name


# --- texts -----------------------------------------------------------------------------------

@pytest.mark.parametrize(("answer", "expected"), [
    ("<answer>[1, 2, 2, -3, 40]</answer>", [1, 2]), ("<answer>tools 4 and 07</answer>", [4, 7]), ("<answer>3</answer><answer>[1]</answer>", [3, 1]), ("[5]", []),
])
def test_answer_indices(spark, answer, expected):
    assert list(one(spark, text.answer_indices(F.col("s"), F.lit(30)), s=answer)) == expected


@pytest.mark.parametrize(("source", "number"), [("1,234.5 m", 1234.5), ("12345", 123.0), ("-.5", -0.5), ("none", None), ("a -7 b", -7.0)])
def test_numbers(spark, source, number):
    assert one(spark, text.number_in(F.col("s")), s=source) == number


@pytest.mark.parametrize(("reply", "query"), [('Search Query: "a b c"', "a b c"), ('"', "the question"), ("ab", "the question"), ("one Search Query: two", "two"), (None, "the question")])
def test_search_queries(spark, reply, query):
    assert one(spark, text.clean_search_query(F.col("r"), F.col("q")), r=reply, q="the question") == query


def test_calls_in_code(spark):
    source = "from m import f(\n# f(1)\nx = g(f(2))"
    assert one(spark, pycode.is_called(F.col("s"), F.lit("g")), s=source) is True
    assert one(spark, pycode.is_called(F.col("s"), F.lit("m")), s=source) is False


# --- schemas ------------------------------------------------------------------------------------

def test_schema_rules_reach_any_depth(rows):
    tree = '{"type":"array"}'
    for _ in range(15):
        tree = '{"type":"object","properties":{"p":%s}}' % tree
    info = '{"function":{"name":"n","description":"d","parameters":%s}}' % tree
    errors = schema.schema_errors(rows("tool_id bigint, info string", [(1, info), (2, "{}"), (3, None), (4, '{"function":3}')]))
    assert values(errors, "tool_id", "error_type", "property", "detail") == [
        (1, "schema_array_missing_items", "p", "items"), (2, "schema_missing_field", "", "tool_info"), (3, "schema_missing_field", "", "tool_info"), (4, "schema_invalid_type", "", "function"),
    ]
    budgets = schema.schema_budgets(rows("tool_id bigint, parameters string", [(1, tree)]))
    assert values(budgets, "max_depth", "total_props", "total_text") == [(16, 15, 15)]


def test_repair(rows):
    broken = '{"function":{"parameters":[{"type":["a","b"],"minimum":true},{"x":1},{"type":"array"}]}}'
    tools = rows("tool_id bigint, info string", [(7, broken)]).select(schema.repair_function(F.try_parse_json("info"), F.lit("7")).alias("f"))
    fixed = tools.first()["f"]
    assert (fixed["name"], fixed["description"]) == ("tool_function_7", "Auto-generated tool function")
    import json

    tree = json.loads(fixed["parameters"])
    assert tree["required"] == ["param_1", "param_3"]
    assert tree["properties"]["param_1"] == {"minimum": 1, "oneOf": [{"type": "a"}, {"type": "b"}]}


@pytest.mark.parametrize(("broken", "want"), [
    (None, {"type": "object", "properties": {}, "required": []}),
    ("null", {"type": "object", "properties": {}, "required": []}),
    ("3", {"type": "object", "properties": {}, "required": []}),
    ("{not json", {"type": "object", "properties": {}, "required": []}),
    ("[]", {"type": "object", "properties": {}, "required": []}),
    ("{}", {}),
    ('{"type":"object"}', {"type": "object"}),
    ('{"properties":[1]}', {"properties": [1]}),
    ('{"anyOf":[{"type":"x"}],"description":"d"}', {"description": "d", "type": "object", "properties": {}}),
    ('{"anyOf":[],"type":"array","properties":{"a":{"default":true}}}', {"type": "array", "properties": {"a": {"default": True}}}),
    ('[{"type":"array"},"x",{"type":null},{"y":1},{"type":["s",null],"oneOf":[1]}]',
     {"type": "object", "properties": {"param_1": {"type": "array"}, "param_3": {"type": None}, "param_5": {"oneOf": [{"type": "s"}, {"type": None}]}}, "required": ["param_1", "param_3", "param_5"]}),
    ('{"type":"object","properties":{"a":{"type":"array","default":false},"b":7,"c":{"minimum":false,"maximum":true,"default":0},"d":{"type":[]},"e":{"type":"array","items":null}},"required":["a"],"x":{"default":true}}',
     {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string"}}, "b": 7, "c": {"minimum": 0, "maximum": 1, "default": 0}, "d": {"oneOf": []}, "e": {"type": "array", "items": None}}, "required": ["a"], "x": {"default": True}}),
])
def test_repair_of_each_shape(spark, broken, want):
    import json

    assert json.loads(one(spark, schema.repair_parameters(F.col("s")), s=broken)) == want


def test_repair_keeps_the_order_of_a_list(spark):
    import json

    listed = json.dumps([{"type": "string"}] * 12)
    assert json.loads(one(spark, schema.repair_parameters(F.col("s")), s=listed))["required"] == [f"param_{n}" for n in range(1, 13)]


def test_info_that_is_no_object_stays(rows):
    listed = '[{"function":{"name":"n","parameters":{"type":"object","properties":{}}}}]'
    tools = rows("tool_id bigint, info string", [(1, listed), (2, None), (3, "{}"), (4, '"x"'), (5, '{"type":"function"}')])
    repaired = tools.select("tool_id", schema.repair_function(F.try_parse_json("info"), F.lit("t")).alias("f"))
    assert values(repaired.where("f IS NOT NULL"), "tool_id") == [(5,)]


def test_batches_of_sparse_ids(rows):
    ids = [(n * n * 10**12,) for n in range(50)] + [(None,)]
    batches = ordering.request_batches(rows("id bigint", ids[::-1]), "id", 20, rows_per_range=7)
    found = [(r["id"], r["batch_id"], r["batch_index"]) for r in batches.orderBy("batch_id", "batch_index").collect()]
    assert found == [(i, n // 20, n % 20) for n, (i,) in enumerate(ids)]
    assert ordering.request_batches(rows("id bigint", []), "id", 20).count() == 0


def test_list_lines(rows):
    tools = rows("tool_id bigint, info string, tag string, name string", [(1, '{"function":{"name":"f","description":"d"}}', None, "n"), (2, '{"function":{}}', "t", None), (3, "{}", "t", None), (4, None, None, None)])
    lines = tools.select("tool_id", catalog.list_line(F.try_parse_json("info"), F.col("tag")).alias("line"))
    assert values(lines, "tool_id", "line") == [(1, "- f: d"), (2, "- unknown: No description"), (3, "- unknown_tool: t"), (4, "- unknown_tool: No tag")]
    entries = tools.select("tool_id", catalog.function_entry(F.col("tool_id"), F.col("name"), F.lit(None).cast("string")).alias("e"))
    assert values(entries.where("tool_id < 3"), "e") == [("# Function 2: n\n# Description: Function: n\n",), ("# Function 3: tool_3\n# Description: Function: tool_3\n",)]


def test_enum_and_item_budgets(rows):
    enum = '{"enum":[%s]}' % ",".join(f'"{"e" * 60}{i:04d}"' for i in range(260))
    tree = '{"type":"object","properties":{"a":%s,"b":%s,"c":{"type":"array","items":[{"enum":["x","y"]},{"const":"z"}]}}}' % (enum, enum)
    trees = rows("tool_id bigint, parameters string", [(1, tree)])
    assert values(schema.schema_budgets(trees), "max_depth", "enum_count", "largest_enum_text") == [(3, 522, 260 * 64)]
    errors = values(schema.strict_errors(trees), "error_type", "detail")
    assert errors.count(("schema_enum_string_budget_exceeded", str(260 * 64))) == 2


# --- vectors ---------------------------------------------------------------------------------------

def test_zero_vector_stays_with_score_zero(rows):
    tools = rows("tool_id bigint, vec array<float>", [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, -2.0])])
    queries = rows("query_id bigint, vec array<float>", [(9, [0.0, 1.0])])
    expected = [(1, 1, 0.0), (2, 2, 0.0), (3, 3, -1.0)]
    assert values(retrieve.top_k(tools, queries, 5), "rank", "tool_id", "score") == expected
    scored = tools.select(vectors.score(F.col("vec"), F.array(F.lit(0.0), F.lit(1.0))).alias("s"))
    assert sorted(r["s"] for r in scored.collect()) == [-1.0, 0.0, 0.0]


def test_recall_without_expected_names_is_zero(rows):
    found = retrieve.recall(
        rows("question_id bigint", [(1,), (2,)]), rows("question_id bigint, name string, rank bigint", [(1, "a", 1), (1, "b", 2), (2, "a", 1)]),
        rows("question_id bigint, name string", [(1, "b"), (1, "b"), (1, "z")]),
    )
    assert values(found, "question_id", "recall", "retrieved_count", "truth_count", "matched") == [(1, 0.5, 2, 3, 1), (2, 0.0, 1, 0, 0)]


# --- usage --------------------------------------------------------------------------------------------

def test_modification_threshold_and_decay(rows):
    usages = rows("tool_id bigint, freq bigint, tsr bigint", [(1, 10, 9), (2, 10, 10), (3, 1, 0), (4, 3, 1)])
    picked = usage.needs_modification(usages)
    assert values(picked, "tool_id") == [(1,), (4,)]
    assert values(usage.decayed(picked), "tool_id", "freq", "tsr") == [(1, 5.0, 4.5), (4, 1.5, 1.0)]


def test_rollback_compares_with_the_accepted_loss(rows):
    losses = rows("subfield string, iter bigint, loss double", [("s", 0, 5.0), ("s", 1, 7.0), ("s", 2, 6.0), ("s", 3, 1.0), ("t", 0, 5.0), ("t", 1, 6.0), ("t", 2, 4.0)])
    assert values(usage.rollbacks(losses), "subfield", "iter", "rollback", "executed", "accepted_loss") == [
        ("s", 0, False, True, 5.0), ("s", 1, True, True, 5.0), ("s", 2, True, True, 5.0), ("s", 3, False, False, 1.0),
        ("t", 0, False, True, 5.0), ("t", 1, True, True, 5.0), ("t", 2, False, True, 4.0),
    ]


def test_loss_by_hand(rows):
    problems = rows("subfield string, iter bigint, problem_id bigint, is_correct boolean", [("s", 0, 1, True), ("s", 0, 2, False), ("s", 1, 3, True)])
    calls = rows("subfield string, iter bigint, problem_id bigint, tool_id bigint, is_correct boolean", [("s", 0, 1, 7, True), ("s", 1, 3, 8, True)])
    tools = rows("subfield string, tool_id bigint", [("s", 7), ("s", 8), ("s", 9)])
    got = {r["iter"]: r for r in usage.iteration_loss(problems, calls, tools).collect()}
    # iteration 0: Q = 0 + 1 + 1 + 7 padding = 9; Q_set = 1 + 15 * 0.5 * 2 = 16
    assert got[0]["loss"] == pytest.approx(9 + 1.25 * 16)
    # iteration 1: Q = 0 + 0 + 1 + 7 = 8; Q_set = 0
    assert got[1]["loss"] == pytest.approx(8)


# --- sources --------------------------------------------------------------------------------------------

def test_library_files_by_name(spark, tmp_path):
    import json

    unit = tmp_path / "c1_output" / "deep"
    unit.mkdir(parents=True)
    info = json.dumps({"function": {"name": "f"}})
    body = {"cluster_name": "c1", "tools": [{"tool_info": info, "tool_code": "def f():\n  pass"}, {"tool_info": info}]}
    (unit / "c1_sib_3_final_openai_tools.json").write_text(json.dumps(body, indent=2))
    (unit / "other.json").write_text("{}")
    (tmp_path / "c1_output" / "blueprint_sibs.json").write_text("{}")
    assert values(readers.read_library(spark, str(tmp_path)), "cluster_name", "pos", "name") == [("c1", 0, "f")]
    assert values(readers.finished_units(spark, str(tmp_path)), "cluster_name", "sib_index") == [("c1", 3)]
    assert values(readers.blueprint_folders(spark, str(tmp_path)), "unit") == [("c1_output",)]


def test_bad_lines_do_not_lose_the_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": \n{"x": 3}\n')
    lines = readers.read_json_lines(spark, str(tmp_path), "x bigint")
    assert values(readers.good_rows(lines), "x") == [(1,), (3,)]
    assert readers.good_rows(lines).count() == 2
    assert values(readers.rejected_rows(lines), "line") == [('{"x": ',)]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_json_lines(spark, str(tmp_path), "x bigint", strict=True).collect()


def test_extraction_keeps_results_of_any_status(rows):
    results = rows("qa_id bigint, agent_result string, question string, answer string", [(1, '{"status":"max_iterations_reached","final_tools":[{"tool_info":{"n":1},"code":"c"}]}', "q", "a"), (2, "{bad", "q", "a"), (3, None, "q", "a")])
    assert values(readers.extracted_tools(results), "qa_id", "index", "code") == [(1, 0, "c")]
    assert values(readers.unreadable_results(results), "qa_id") == [(2,)]


def test_positions_keep_null_keys_and_null_orders(rows):
    table = rows("k string, o long", [(None, 1), (None, 2), ("a", 3), ("a", None), ("a", 5_000_000)])
    found = {(r["k"], r["o"]): (r["pos0"], r["n"]) for r in ordering.number_rows(table, ["k"], "o", total="n").collect()}
    assert found == {(None, 1): (0, 2), (None, 2): (1, 2), ("a", 3): (0, 3), ("a", 5_000_000): (1, 3), ("a", None): (2, 3)}


def test_loss_keeps_groups_without_tools(rows):
    problems = rows("iter int, subfield string, problem_id long, is_correct boolean", [(0, "s", 1, True), (0, "s", 2, False)])
    calls = rows("iter int, subfield string, problem_id long, tool_id long, is_correct boolean, seq long", [])
    tools = rows("subfield string, tool_id long", [("other", 1)])
    found = usage.iteration_loss(problems, calls, tools).collect()
    assert [(r["subfield"], r["n"]) for r in found] == [("s", 0)] and found[0]["q_tools"] == 10


def test_every_tool_is_listed(spark):
    """Odd batches too, and a batch beyond the last one."""
    from toolmill.plans import QUERIES, roles

    folder = "/root/testdata/sf0.01"
    rows = {r["batch_id"]: r["text"] for r in QUERIES["p19_every_batch_listing"](spark, folder).collect()}
    tools = roles.parsed_tools(spark, folder).count()
    assert sum(text.count("# Function ") for text in rows.values()) == tools
    assert set(range(-(-tools // 20))) < set(rows) and "No tools found in this cluster." in rows.values()


def test_calls_have_every_line(spark):
    from toolmill.plans import roles

    folder = "/root/testdata/sf0.01"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct()
    called = roles.calls(spark, folder).select("problem_id", "tool_id")
    assert called.count() == lines.count() and called.exceptAll(lines).count() == 0


def test_blanks_of_any_script(spark):
    from toolmill.operators import logs

    text = "one two　three  four\x1cfive​six "
    assert one(spark, logs.word_count(F.col("t")), t=text) == len(text.split()) == 5
    assert one(spark, tools_text.strip(F.col("t")), t=" 　 x ") == "x"


def test_first_character_after_the_last_marker(spark):
    for response, answer in (("Final Answer: A. Final Answer:  (b)", "("), ("Final Answer: b", "b"), ("Final Answer: ", ""), ("no marker", "n"), ("", "")):
        assert one(spark, scoring.predicted_first(F.col("r")), r=response) == answer


def test_prompt_by_evaluation_type(spark):
    prompt = scoring.question_prompt(F.col("q"), F.col("e"), {"multiple_choice": "Choose: {question}"}, "Number: {question}")
    assert one(spark, prompt, q="a {question}?", e="multiple_choice") == "Choose: a {question}?"
    assert one(spark, prompt, q="x", e=None) == one(spark, prompt, q="x", e="anything") == "Number: x"


def test_booleans_may_pass_as_values(rows):
    info = '{"type":"function","function":{"name":"f","description":"d","parameters":{"type":"object","properties":{"a":{"type":"integer","default":true}}}}}'
    tools = rows("tool_id bigint, info string", [(1, info)])
    assert values(schema.schema_errors(tools), "error_type", "property") == [("schema_invalid_value_type", "a")]
    assert schema.schema_errors(tools, booleans=False).count() == 0


def test_texts_that_are_no_tree_are_rejects(rows):
    deep = '{"a":' * 3_000 + "1" + "}" * 3_000
    tools = rows("tool_id bigint, parameters string", [(1, '{"type":"object"}'), (2, "{bad"), (3, None), (4, deep)])
    assert values(schema.unreadable_schemas(tools), "tool_id") == [(2,), (4,)]
    assert values(schema.schema_budgets(tools), "tool_id", "max_depth") == [(1, 1)]
