"""Rules, budgets and repair of function schemas held as VARIANT or JSON text.

A parameters tree is flattened inside its row (nested arrays of nodes, depth
bounded), so the rules need no join and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.functions import fixed
from toolmill.functions.text import let

ENTRIES = "map<string,variant>"
JSON_DEPTH = 1_000  # nesting at which the JSON parser itself gives up


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_object(v: Column) -> Column:
    """False for absent values. A shallow cast decides; no schema of the tree is inferred."""
    return F.try_variant_get(v, "$", ENTRIES).isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_null(v: Column) -> Column:
    """Absent, or JSON null."""
    return v.isNull() | F.is_variant_null(v)


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def is_boolean(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "BOOLEAN", F.lit(False))


def text_at(v: Column, path: str) -> Column:
    """A member that is a JSON string; null for any other kind."""
    return F.when(is_string(at(v, path)), F.try_variant_get(v, path, "string"))


def has_type(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.type", "string") == name, F.lit(False))


def entries(v: Column) -> Column:
    """(key, value) array of an object; empty for anything else."""
    return F.coalesce(
        F.map_entries(F.try_variant_get(v, "$", ENTRIES)), F.array().cast("array<struct<key:string,value:variant>>")
    )


def items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def property_entries(v: Column) -> Column:
    return entries(at(v, "$.properties"))


def _is_object_schema(v: Column) -> Column:
    return has_type(v, "object") & at(v, "$.properties").isNotNull()


def depth_bound(text: Column) -> Column:
    """No tree is deeper than its text has objects; one more level for what they hold."""
    objects = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("{"), F.lit("")))
    return F.least(F.coalesce(objects, F.lit(0)) + 1, F.lit(JSON_DEPTH))


def unfold(roots: Column, children, node_type: str, depth: Column) -> Column:
    """Array of (depth, node) of every node below ``roots``, level by level, for
    ``depth`` levels. One expression for any depth; a row's tree stays in its row."""
    found_type = f"array<struct<depth:int,node:{node_type}>>"
    start = F.struct(F.array().cast(found_type).alias("found"), roots.alias("level"))

    def next_level(acc: Column, i: Column) -> Column:
        placed = F.transform(acc["level"], lambda n: F.struct(i.cast("int").alias("depth"), n.alias("node")))
        return F.struct(F.concat(acc["found"], placed).alias("found"), F.flatten(F.transform(acc["level"], children)).alias("level"))

    return F.aggregate(F.sequence(F.lit(1), depth), start, next_level)["found"]


# --- rules ------------------------------------------------------------------------------

def _issue(test: Column, error_type: str, prop: Column, detail: Column) -> Column:
    return F.when(test, F.struct(F.lit(error_type).alias("error_type"), prop.alias("property"), detail.alias("detail")))


def schema_errors(tools: DataFrame, info: str = "info", booleans: bool = True) -> DataFrame:
    """One row per violation ``(tool_id, error_type, property, detail)`` of the schema texts.
    ``booleans=False`` lets booleans pass as default, minimum or maximum, as numbers do."""
    nothing = F.lit("")
    v = F.col("_info")
    parameters = F.col("_parameters")
    parsed = tools.select("tool_id", F.try_parse_json(info).alias("_info"), depth_bound(F.col(info)).alias("_depth"))
    top = parsed.select("tool_id", "_info", "_depth", at(v, "$.function").alias("_function"), at(v, "$.function.parameters").alias("_parameters"))
    info_object = is_object(F.col("_info"))
    function_object = is_object(F.col("_function"))
    bad_words = F.filter(F.transform(entries(parameters), lambda e: e["key"]), lambda k: k.isin(*fixed.INVALID_TOP_KEYWORDS))
    checked = top.withColumn("_bad_words", F.array_sort(bad_words)).withColumn(
        "_checkable", is_object(parameters) & (F.size("_bad_words") == 0)
    )

    # objects whose own structure is checked: the root, then nested object properties
    node_type = "struct<path:string,node:variant>"
    root = F.when(F.col("_checkable"), F.array(F.struct(F.lit("").alias("path"), parameters.alias("node")))).otherwise(F.array().cast(f"array<{node_type}>"))

    def nested(n: Column) -> Column:
        return F.transform(
            F.filter(property_entries(n["node"]), lambda e: _is_object_schema(e["value"])),
            lambda e: F.struct(F.concat_ws(".", F.nullif(n["path"], F.lit("")), e["key"]).alias("path"), e["value"].alias("node")),
        )

    objects = F.transform(unfold(root, nested, node_type, F.col("_depth")), lambda x: x["node"])

    flat_info = F.col("_info")
    empty = info_object & (F.size(entries(flat_info)) == 0)
    top_issues = F.array(
        _issue(is_null(flat_info) | empty, "schema_missing_field", nothing, F.lit("tool_info")),
        _issue(~is_null(flat_info) & ~info_object, "schema_invalid_type", nothing, F.lit("tool_info")),
        _issue(info_object & ~empty & F.col("_function").isNull(), "schema_missing_field", nothing, F.lit("function")),
        _issue(info_object & F.col("_function").isNotNull() & ~function_object, "schema_invalid_type", nothing, F.lit("function")),
        *[
            _issue(function_object & at(F.col("_function"), f"$.{field}").isNull(), "schema_missing_field", nothing, F.lit(field))
            for field in fixed.REQUIRED_FUNCTION_FIELDS
        ],
        _issue(parameters.isNotNull() & ~is_object(parameters), "schema_parameters_wrong_type", nothing, F.lit("parameters")),
        _issue(F.size("_bad_words") > 0, "schema_parameters_invalid_keywords", nothing, F.concat_ws(",", "_bad_words")),
    )

    def object_issues(n: Column) -> Column:
        node, path = n["node"], n["path"]
        return F.array(
            _issue(~has_type(node, "object"), "schema_invalid_type", path, F.lit("type")),
            _issue(at(node, "$.properties").isNull(), "schema_missing_field", path, F.lit("properties")),
        )

    def property_issues(n: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter(property_entries(n["node"]), lambda e: is_object(e["value"])),
                lambda e: F.array(
                    _issue(has_type(e["value"], "array") & at(e["value"], "$.items").isNull(), "schema_array_missing_items", e["key"], F.lit("items")),
                    _issue(is_array(at(e["value"], "$.type")), "schema_type_array", e["key"], F.lit("type")),
                    *[_issue(is_boolean(at(e["value"], f"$.{f}")), "schema_invalid_value_type", e["key"], F.lit(f)) for f in fixed.VALUE_FIELDS if booleans],
                ),
            )
        )

    issues = F.concat(
        F.col("_top"),
        F.flatten(F.transform("_objects", object_issues)),
        F.flatten(F.transform("_objects", property_issues)),
    )
    return (
        checked.select("tool_id", top_issues.alias("_top"), objects.alias("_objects"))
        .select("tool_id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("e"))
        .select("tool_id", "e.*")
    )


# --- budgets ------------------------------------------------------------------------------

def _children(n: Column) -> Column:
    """Schema nodes right below a node: properties, items (one schema or a list of them),
    compositions and definitions."""
    none = F.array().cast("array<variant>")
    values = lambda path: F.transform(entries(at(n, path)), lambda e: e["value"])
    return F.concat(
        F.when(has_type(n, "object"), values("$.properties")).otherwise(none),
        F.when(has_type(n, "array") & is_array(at(n, "$.items")), items(at(n, "$.items")))
        .when(has_type(n, "array") & at(n, "$.items").isNotNull(), F.array(at(n, "$.items")))
        .otherwise(none),
        items(at(n, "$.anyOf")),
        items(at(n, "$.oneOf")),
        values("$['$defs']"),
        values("$.definitions"),
    )


def _node_measures(n: Column) -> Column:
    """What one node (depth, node) adds to the budgets of its tree."""
    node = n["node"]
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    keys = lambda path: F.transform(entries(at(node, path)), lambda e: F.length(e["key"]))
    texts_of = lambda enum: F.transform(F.filter(enum, is_string), lambda x: F.length(F.try_variant_get(x, "$", "string")))
    read = F.struct(
        F.when(has_type(node, "object"), keys("$.properties")).otherwise(F.array().cast("array<int>")).alias("names"),
        let(items(at(node, "$.enum")), lambda enum: F.struct(F.size(enum).alias("n"), texts_of(enum).alias("texts"))).alias("enum"),
    )

    def measures(r: Column) -> Column:
        enum = r["enum"]
        large = (enum["n"] > fixed.SCHEMA_ENUM_COUNT) & (enum["n"] == F.size(enum["texts"]))
        others = total(keys("$['$defs']")) + total(keys("$.definitions")) + F.coalesce(F.length(text_at(node, "$.const")), F.lit(0))
        return F.struct(
            n["depth"].cast("bigint").alias("depth"), F.size(r["names"]).cast("bigint").alias("props"), (total(r["names"]) + others + total(enum["texts"])).alias("text"),
            enum["n"].cast("bigint").alias("enums"), F.when(large, total(enum["texts"])).otherwise(F.lit(0).cast("bigint")).alias("enum_text"),
        )

    return let(read, measures)


def schema_budgets(tools: DataFrame, parameters: str = "parameters") -> DataFrame:
    """Depth, property count, text size and enum size of each tree."""
    return _measured_trees(tools, parameters).drop("enums_over")


def _measured_trees(tools: DataFrame, parameters: str) -> DataFrame:
    """The budgets of each tree and the text size of each of its enums over the limit, folded
    inside the tree's row. Texts that are no tree give no row (``unreadable_schemas``)."""
    none = F.array().cast("array<variant>")

    def tree(root: Column) -> Column:
        return unfold(F.when(root.isNotNull(), F.array(root)).otherwise(none), _children, "variant", depth_bound(F.col(parameters)))

    measured = F.transform(let(F.try_parse_json(parameters), tree), _node_measures)
    nodes = tools.select("tool_id", F.explode(F.array(measured)).alias("_m")).where(F.size("_m") > 0)  # a generator is evaluated once, however often its result is read
    total = lambda field: F.aggregate("_m", F.lit(0).cast("bigint"), lambda acc, m: acc + m[field])
    return nodes.select(
        "tool_id",
        F.array_max(F.col("_m.depth")).alias("max_depth"),
        total("props").alias("total_props"),
        total("text").alias("total_text"),
        total("enums").alias("enum_count"),
        F.array_max(F.col("_m.enum_text")).alias("largest_enum_text"),
        F.filter(F.col("_m.enum_text"), lambda x: x > fixed.SCHEMA_ENUM_TEXT).alias("enums_over"),
    )


def unreadable_schemas(tools: DataFrame, parameters: str = "parameters") -> DataFrame:
    """Texts that the JSON parser gives up on: no JSON, or deeper than ``JSON_DEPTH`` levels."""
    text = F.col(parameters)
    return tools.where(text.isNotNull() & F.try_parse_json(text).isNull()).select("tool_id", F.octet_length(text).cast("bigint").alias("bytes"))


def strict_errors(tools: DataFrame, parameters: str = "parameters") -> DataFrame:
    """Root strictness (no additional properties, all properties required) and
    budgets over their limit, one row per violation (of enum text: per enum)."""
    p = F.col("_p")
    names = F.transform(property_entries(p), lambda e: e["key"])
    required = F.transform(items(at(p, "$.required")), lambda x: F.try_variant_get(x, "$", "string"))
    missing = F.array_except(names, required)
    has_list = is_array(at(p, "$.required"))
    closed = F.coalesce(F.try_variant_get(p, "$.additionalProperties", "boolean") == F.lit(False), F.lit(False))
    rooted = tools.select("tool_id", F.try_parse_json(parameters).alias("_p")).where(has_type(p, "object")).select(
        "tool_id",
        F.explode(
            F.filter(
                F.array(
                    F.when(~closed, F.struct(F.lit("schema_missing_additional_properties").alias("error_type"), F.lit("").alias("detail"))),
                    F.when(~has_list, F.struct(F.lit("schema_missing_required").alias("error_type"), F.lit("").alias("detail"))),
                    F.when(has_list & (F.size(missing) > 0), F.struct(F.lit("schema_required_fields_missing").alias("error_type"), F.array_join(F.array_sort(missing), ",").alias("detail"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("e"),
    ).select("tool_id", "e.*")
    limits = (
        ("max_depth", fixed.SCHEMA_MAX_DEPTH, "schema_depth_limit_exceeded"),
        ("total_props", fixed.SCHEMA_MAX_PROPERTIES, "schema_property_limit_exceeded"),
        ("total_text", fixed.SCHEMA_MAX_TEXT, "schema_string_budget_exceeded"),
        ("enum_count", fixed.SCHEMA_MAX_ENUM, "schema_enum_count_exceeded"),
    )
    violation = lambda e, size: F.struct(F.lit(e).alias("error_type"), size.cast("string").alias("detail"))
    of_trees = F.filter(F.array(*[F.when(F.col(c) > limit, violation(e, F.col(c))) for c, limit, e in limits]), lambda x: x.isNotNull())
    of_enums = F.transform("enums_over", lambda size: violation("schema_enum_string_budget_exceeded", size))
    over = _measured_trees(tools, parameters).select("tool_id", F.explode(F.concat(of_trees, of_enums)).alias("e")).select("tool_id", "e.*")
    return rooted.unionByName(over)


# --- repair -----------------------------------------------------------------------------------

EMPTY_TREE = '{"properties":{},"required":[],"type":"object"}'


def _constant(json_text: str) -> Column:
    return F.parse_json(F.lit(json_text))


def _member(key: Column | str, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))


def _members(test: Column, *members: Column) -> Column:
    """The members if ``test`` holds, else none."""
    return F.when(test, F.array(*members)).otherwise(F.array().cast("array<struct<key:string,value:variant>>"))


def _object(members: Column) -> Column:
    """A VARIANT object of (key, value) members; its keys come sorted."""
    return F.to_variant_object(F.map_from_entries(members))


def _repaired_property(prop: Column, add_items: bool) -> Column:
    """One property, rewritten member by member: listed types become ``oneOf``, boolean
    bounds numbers, a boolean default goes, and an array without items gets text items."""
    listed = is_array(at(prop, "$.type"))

    def kept(e: Column) -> Column:
        return ~(e["key"].isin("type", "oneOf") & listed) & ~((e["key"] == "default") & is_boolean(e["value"]))

    def numbered(e: Column) -> Column:
        truth = F.when(F.try_variant_get(e["value"], "$", "boolean"), _constant("1")).otherwise(_constant("0"))
        return _member(e["key"], F.when(e["key"].isin("minimum", "maximum") & is_boolean(e["value"]), truth).otherwise(e["value"]))

    choices = F.to_variant_object(F.transform(items(at(prop, "$.type")), lambda t: F.to_variant_object(F.struct(t.alias("type")))))
    without_items = F.lit(add_items) & has_type(prop, "array") & at(prop, "$.items").isNull()
    return _object(F.concat(
        F.transform(F.filter(entries(prop), kept), numbered),
        _members(listed, _member("oneOf", choices)),
        _members(without_items, _member("items", _constant('{"type":"string"}'))),
    ))


def _tree_of_list(listed: Column) -> Column:
    """Parameters given as a list: its objects with a type, named by their position."""
    numbered = F.transform(listed, lambda p, i: _member(F.concat(F.lit("param_"), (i + 1).cast("string")), p))
    kept = F.filter(numbered, lambda e: is_object(e["value"]) & at(e["value"], "$.type").isNotNull())

    def tree(found: Column) -> Column:
        properties = _object(F.transform(found, lambda e: _member(e["key"], _repaired_property(e["value"], False))))
        required = F.to_variant_object(F.transform(found, lambda e: e["key"]))
        return _object(F.array(_member("type", _constant('"object"')), _member("properties", properties), _member("required", required)))

    return let(kept, tree)


def _tree_of_object(tree: Column) -> Column:
    """Keywords that no root may have go, with defaults for what a root needs; a root without
    them keeps its members, with its properties repaired."""
    bad = F.exists(entries(tree), lambda e: e["key"].isin(*fixed.INVALID_TOP_KEYWORDS))
    allowed = F.concat(
        F.filter(entries(tree), lambda e: ~e["key"].isin(*fixed.INVALID_TOP_KEYWORDS)),
        _members(at(tree, "$.type").isNull(), _member("type", _constant('"object"'))),
        _members(at(tree, "$.properties").isNull(), _member("properties", _constant("{}"))),
    )

    def repaired(e: Column) -> Column:
        return _member(e["key"], F.when(is_object(e["value"]), _repaired_property(e["value"], True)).otherwise(e["value"]))

    def with_properties(e: Column) -> Column:
        rewritten = _object(F.transform(entries(e["value"]), repaired))
        return _member(e["key"], F.when((e["key"] == "properties") & is_object(e["value"]), rewritten).otherwise(e["value"]))

    return _object(F.when(bad, allowed).otherwise(F.transform(entries(tree), with_properties)))


def repair_tree(tree: Column) -> Column:
    """Parameters (VARIANT) with the common errors fixed, as JSON text. Absent trees and those
    that are neither object nor list become an empty object schema."""
    return let(tree, lambda v: F.coalesce(
        F.when(is_array(v), F.to_json(_tree_of_list(items(v)))).when(is_object(v), F.to_json(_tree_of_object(v))), F.lit(EMPTY_TREE)
    ))


def repair_parameters(text: Column) -> Column:
    """``repair_tree`` of a JSON text; a text that is no JSON counts as absent."""
    return repair_tree(F.try_parse_json(text))


def repair_function(info: Column, tool_id: Column) -> Column:
    """Name, description and repaired parameters of a schema, defaults where absent.
    Null for info that is absent, empty or no object: it stays as it is."""
    repaired = F.struct(
        F.coalesce(text_at(info, "$.function.name"), F.concat(F.lit("tool_function_"), tool_id)).alias("name"),
        F.coalesce(text_at(info, "$.function.description"), F.lit(fixed.AUTO_DESCRIPTION)).alias("description"),
        repair_tree(at(info, "$.function.parameters")).alias("parameters"),
    )
    return F.when(F.size(entries(info)) > 0, repaired)
