"""Catalog rows: both stored formats in one shape, texts for requests,
registries, library selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.functions import fixed
from toolmill.functions.code import definition_count
from toolmill.functions.schema import entries, is_array, is_object, items
from toolmill.operators.ordering import first_rows, last_rows, ordered_text


def json_string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def unify_formats(tools: DataFrame) -> DataFrame:
    """``info`` and ``code`` from either pair of columns (tool_info / tool_code or
    description / python), decided per row, with the row's format."""
    return tools.withColumn(
        "format",
        F.when(F.col("tool_info").isNotNull() & F.col("tool_code").isNotNull(), "v2")
        .when(F.col("description").isNotNull() & F.col("python").isNotNull(), "valid_science")
        .otherwise("unknown"),
    ).select(
        "tool_id",
        "format",
        F.coalesce("tool_info", "description").alias("info"),
        F.coalesce("tool_code", "python").alias("code"),
    )


def first_object(v: Column) -> Column:
    """A description given as a list becomes its first object; null if it has none."""
    return F.when(is_array(v), F.get(F.filter(items(v), is_object), F.lit(0))).otherwise(v)


def summary_json(info: Column, tag: Column) -> Column:
    """``{name, tags, description}`` of a schema VARIANT, list or object or neither."""
    v = first_object(info)
    return F.to_json(
        F.struct(
            F.coalesce(json_string(v, "$.function.name"), F.lit(fixed.UNKNOWN_NAME)).alias("name"),
            F.coalesce(tag, F.lit(fixed.NO_TAG)).alias("tags"),
            F.coalesce(json_string(v, "$.function.description"), F.lit(fixed.BAD_DESCRIPTION)).alias("description"),
        )
    )


def tool_name(info: Column, plain_name: Column) -> Column:
    return F.coalesce(json_string(info, "$.function.name"), plain_name, F.lit(fixed.UNKNOWN_NAME))


def call_form(info: Column) -> Column:
    """Struct a model's function-calling interface takes; empty function if absent."""
    return call_form_of(
        json_string(info, "$.function.name"),
        json_string(info, "$.function.description"),
        F.to_json(F.try_variant_get(info, "$.function.parameters", "variant")),
    )


def call_form_of(name: Column, description: Column, parameters: Column) -> Column:
    """The same struct from separate columns (expected tools, registered tools)."""
    return F.struct(
        F.lit("function").alias("type"),
        F.struct(
            F.coalesce(name, F.lit("")).alias("name"),
            F.coalesce(description, F.lit("")).alias("description"),
            F.coalesce(parameters, F.lit("{}")).alias("parameters"),
        ).alias("function"),
    )


def embedding_text(tool_id: Column, fmt: Column, info: Column) -> Column:
    function = F.try_variant_get(info, "$.function", "variant")
    has_function = is_object(function)
    name = F.coalesce(json_string(info, "$.function.name"), F.concat(F.lit("tool_"), tool_id))
    description = F.coalesce(json_string(info, "$.function.description"), F.lit(fixed.NO_DESCRIPTION))
    bad = F.when(fmt == "v2", "Invalid tool_info function format").otherwise("Invalid description format")
    return (
        F.when(fmt == "unknown", F.concat(F.lit("Tool "), tool_id, F.lit(": Invalid tool format for detected format unknown")))
        .when(has_function, F.concat(F.lit("The function name is: "), name, F.lit(". The function description is: "), description, F.lit(".")))
        .otherwise(F.concat(F.lit("Tool "), tool_id, F.lit(": "), bad))
    )


def list_line(info: Column, tag: Column) -> Column:
    """``- name: description`` of a schema VARIANT; the tag where there is no schema."""
    name = F.coalesce(json_string(info, "$.function.name"), F.lit(fixed.LIST_NAME))
    description = F.coalesce(json_string(info, "$.function.description"), F.lit(fixed.LIST_DESCRIPTION))
    tagged = F.concat(F.lit(f"- {fixed.LIST_WITHOUT_INFO}: "), F.coalesce(tag, F.lit(fixed.LIST_NO_TAG)))
    return F.when(F.size(entries(info)) > 0, F.concat(F.lit("- "), name, F.lit(": "), description)).otherwise(tagged)


def function_entry(position: Column, name: Column, description: Column) -> Column:
    """Heading and description of the tool at a zero-based place of a listing."""
    number = (position + 1).cast("string")
    named = F.coalesce(name, F.concat(F.lit("tool_"), number))
    described = F.coalesce(description, F.concat(F.lit("Function: "), named))
    return F.concat(F.lit("# Function "), number, F.lit(": "), named, F.lit("\n# Description: "), described, F.lit("\n"))


def function_listing(clusters: DataFrame, tools: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``clusters`` with the ``text`` that lists their tools (keys, position, name,
    description) in order. A row of ``clusters`` has to be a bounded group: a chunk or batch."""
    texts = ordered_text(tools, keys, position, function_entry(F.col(position), F.col("name"), F.col("description")))
    return clusters.join(texts, keys, "left").withColumn("text", F.coalesce("text", F.lit(fixed.EMPTY_CLUSTER)))


def library_rows(tools: DataFrame) -> DataFrame:
    """Rows a library keeps: the named function is defined exactly once; the
    future import is taken out of the code."""
    return tools.where(definition_count(F.col("code"), F.col("name")) == 1).withColumn(
        "code", F.replace(F.col("code"), F.lit(fixed.FUTURE_IMPORT), F.lit(""))
    )


def registry(tools: DataFrame, columns: list[str]) -> DataFrame:
    """One tool per name, the last loaded wins."""
    return last_rows(tools, ["name"], F.col("pos"), columns)


def pool(tools: DataFrame, columns: list[str]) -> DataFrame:
    """One tool per name, the first retrieved wins."""
    return first_rows(tools, ["name"], F.col("pos"), columns)


def library_totals(tools: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return tools.agg(F.count("*").alias("total_tools"), distinct("name").alias("distinct_names"))


def set_fingerprint(tools: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Content key of each tool set: changes with any name, description or order.

    Digests of the rows are summed in four limbs, so a set of any size combines
    before the shuffle; no set is gathered into one row first.
    """
    digest = F.sha2(F.concat_ws("\u001f", F.col(position).cast("string"), F.col("name"), F.col("description")), 256)
    limbs = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.sum(limb).cast("string") for limb in limbs]
    return tools.groupBy(*keys).agg(
        F.sha2(F.concat_ws("-", F.count("*").cast("string"), *sums), 256).alias("fingerprint"),
        F.count("*").alias("tools"),
    )
