"""Tool blocks of replies and tool schemas of source text, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolmill.functions.code import doc_params, function_name, merge_params, python_syntax, signature_params, splits_a_type, summary_line
from toolmill.functions.text import strip


def tool_blocks(replies: DataFrame, reply: str = "response") -> DataFrame:
    """``<toolN>…</toolN>`` blocks of a reply that hold a tag and code; ``index`` is
    the block's place in the reply, fenced code loses its fence."""
    pattern = F.lit(r"(?s)<tool(\d+)>(.*?)</tool\1>")
    found = F.zip_with(
        F.regexp_extract_all(reply, pattern, F.lit(1)),
        F.regexp_extract_all(reply, pattern, F.lit(2)),
        lambda number, content: F.struct(number.alias("tool_number"), content.alias("content")),
    )
    placed = F.transform(found, lambda b, i: F.struct(i.cast("bigint").alias("index"), b["tool_number"].alias("tool_number"), b["content"].alias("content")))
    content = F.col("content")
    code = F.regexp_extract(content, r"(?s)<code>(.*?)</code>", 1)
    fenced = F.split_part(F.split_part(code, F.lit("```python"), F.lit(2)), F.lit("```"), F.lit(1))
    return (
        replies.select("question_id", F.inline(placed))
        .where(content.rlike(r"(?s)<tag>.*?</tag>") & content.rlike(r"(?s)<code>.*?</code>"))
        .select(
            "question_id",
            "index",
            "tool_number",
            strip(F.regexp_extract(content, r"(?s)<tag>(.*?)</tag>", 1)).alias("tag"),
            strip(F.when(F.contains(code, F.lit("```python\n")), fenced).otherwise(code)).alias("code"),
        )
    )


def tool_schemas(sources: DataFrame, code: str = "code", keys: tuple[str, ...] = ("tool_id",)) -> DataFrame:
    """Name, summary and parameters (array in order) read from each source text.
    Signature and docstring are parsed once per row and merged from columns."""
    parsed = sources.withColumn("_signature", signature_params(F.col(code))).withColumn("_documented", doc_params(F.col(code)))
    return parsed.select(
        *keys,
        function_name(F.col(code)).alias("name"),
        summary_line(F.col(code)).alias("description"),
        splits_a_type(F.col(code)).alias("type_was_split"),
        merge_params(F.col("_signature"), F.col("_documented")).alias("params"),
    )


def schema_parameters(schemas: DataFrame) -> DataFrame:
    placed = F.transform(
        "params",
        lambda p, i: F.struct(
            i.cast("bigint").alias("position"), p["name"].alias("param"), p["json_type"].alias("json_type"),
            p["description"].alias("param_description"), p["required"].alias("required"),
        ),
    )
    return schemas.select("tool_id", "name", "description", "type_was_split", F.inline(placed))


def schema_json(schemas: DataFrame, keys: tuple[str, ...] = ("tool_id",)) -> DataFrame:
    """Function-calling JSON of each schema."""
    def quoted(text):
        return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)

    def prop(p):
        opened = F.substr(p["json_type"], F.lit(1), F.length(p["json_type"]) - 1)
        described = F.concat(opened, F.lit(',"description":'), quoted(p["description"]), F.lit("}"))
        return F.concat(quoted(p["name"]), F.lit(":"), F.when(p["description"] == "", p["json_type"]).otherwise(described))

    properties = F.concat(F.lit("{"), F.array_join(F.transform("params", prop), ","), F.lit("}"))
    required = F.transform(F.filter("params", lambda p: p["required"]), lambda p: p["name"])
    return schemas.select(*keys, "name", properties.alias("properties"), F.to_json(required).alias("required"))


def block_schemas(replies: DataFrame, reply: str = "response") -> DataFrame:
    """The function schema of each tool block of a reply, read from the block's code."""
    keys = ("question_id", "index", "tag")
    return schema_json(tool_schemas(tool_blocks(replies, reply), keys=keys), (*keys, "description"))


def syntax_errors(tools: DataFrame, code: str = "code") -> DataFrame:
    """Tools whose code does not parse: error type and line."""
    checked = tools.select("tool_id", python_syntax(F.col(code)).alias("s"))
    return checked.where(~F.col("s.valid")).select("tool_id", F.col("s.error_type").alias("error_type"), F.col("s.line").cast("bigint").alias("line"))


def validated_count(tools: DataFrame, errors: DataFrame) -> DataFrame:
    """Tools, tools with at least one error, and the rest."""
    bad = errors.agg(F.countDistinct("tool_id")).scalar()
    return tools.agg(F.count("*").alias("tools")).select("tools", bad.alias("with_errors")).withColumn("validated", F.col("tools") - F.col("with_errors"))
