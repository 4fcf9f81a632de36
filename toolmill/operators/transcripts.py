"""Conversations as text. A conversation is cut into pages by the running length of its
messages, so one of any length is never gathered whole; the texts of its ``n_pages`` pages
in order are the transcript. ``page_chars`` bounds a page to that many characters of content and one message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.functions import fixed
from toolmill.operators.ordering import PAGE_CHARS, ordered_text, pages


def _calls() -> Column:
    return F.coalesce(F.col("tool_calls"), F.array().cast("array<struct<id:string,name:string,arguments:string>>"))


def _lines_of_message() -> Column:
    """Message lines for analysis; roles without a line give an empty array."""
    content = F.coalesce("content", F.lit(""))
    calls = F.transform(_calls(), lambda c: F.concat(F.lit(fixed.CALL_LINE), c["name"], F.lit("("), c["arguments"], F.lit(")")))
    return (
        F.when(F.col("role") == "user", F.array(F.concat(F.lit(fixed.USER_LINE), content)))
        .when(F.col("role") == "assistant", F.concat(F.array(F.concat(F.lit(fixed.ASSISTANT_LINE), content)), calls))
        .when(F.col("role") == "tool", F.array(F.concat(F.lit(fixed.RESULT_LINE), content)))
        .otherwise(F.array().cast("array<string>"))
    )


def analysis_transcript(messages: DataFrame, page_chars: int = PAGE_CHARS) -> DataFrame:
    lined = messages.withColumn("_lines", _lines_of_message()).where(F.size("_lines") > 0)
    paged = pages(lined, ["conv_id"], "turn", F.col("content"), page_chars)
    return ordered_text(paged, ["conv_id", "page", "n_pages"], "page_pos", F.array_join("_lines", "\n\n"), separator="\n\n")


def reading_transcript(messages: DataFrame, page_chars: int = PAGE_CHARS) -> DataFrame:
    """Messages numbered by their place in the conversation, with a mark per role and their tool calls spelled out.
    Ids come from ``id`` of a call and ``tool_call_id`` of a message, ``unknown`` where
    there is none."""
    icon = F.lit(fixed.OTHER_ICON)
    for role, mark in fixed.ROLE_ICONS.items():
        icon = F.when(F.col("role") == role, mark).otherwise(icon)
    number = (F.col("page_pos") + 1).cast("string")
    has_content = F.coalesce(F.col("content"), F.lit("")) != ""
    call_lines = F.transform(
        _calls(),
        lambda c, i: F.concat(
            F.lit("  Tool Call "), (i + 1).cast("string"), F.lit(":\n    ID: "), F.coalesce(c["id"], F.lit("unknown")), F.lit("\n    Function: "), c["name"], F.lit("\n    Arguments: "), c["arguments"]
        ),
    )
    parts = F.array(
        F.lit("\n" + fixed.RULE),
        F.concat(F.lit("Message "), number, F.lit(": "), icon, F.lit(" "), F.upper("role")),
        F.lit(fixed.RULE),
        F.when(has_content, F.concat(F.lit("Content:\n"), F.col("content"))),
        F.when(F.col("tool_calls").isNotNull(), F.concat_ws("\n", F.lit(fixed.CALLS_HEADING), call_lines)),
        F.when(F.col("role") == "tool", F.concat(F.lit("Tool Call ID: "), F.coalesce("tool_call_id", F.lit("unknown")))),
        F.when((F.col("role") == "tool") & has_content, F.concat(F.lit("Tool Result:\n"), F.col("content"))),
        F.lit(""),
    )
    paged = pages(messages, ["conv_id"], "turn", F.col("content"), page_chars)
    return ordered_text(paged, ["conv_id", "page", "n_pages"], "page_pos", F.concat_ws("\n", parts))
