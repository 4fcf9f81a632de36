"""String and JSON expressions over replies, reports and answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolmill.functions import fixed


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, also inside loops over arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(fixed.BLANK))


def rstrip(s: Column) -> Column:
    return F.rtrim(s, F.lit(fixed.BLANK))


def contains(s: Column, part: str) -> Column:
    return s.contains(F.lit(part))


def occurrences(s: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``s`` without overlap."""
    return F.try_divide(F.length(s) - F.length(F.replace(s, part, F.lit(""))), F.length(part)).cast("bigint")


def occurrences_of(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def preview(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


# --- code taken out of replies -------------------------------------------------

def strip_fences(s: Column) -> Column:
    """Code without its Markdown fence: first opening fence, last closing one."""
    code = F.ltrim(F.coalesce(s, F.lit("")), F.lit(fixed.BLANK))

    def inside(opening: str) -> Column:
        rest = F.substr(code, F.locate(opening, code) + len(opening))
        closed = F.regexp_extract(rest, r"(?s)^(.+)```", 1)
        body = F.when(closed != "", closed).otherwise(rest)
        return rstrip(F.ltrim(body, F.lit("\n")))

    return (
        F.when(contains(code, "```python"), inside("```python"))
        .when(code.startswith("```"), inside("```"))
        .when(code.startswith("python\n"), rstrip(F.substr(code, F.lit(len("python\n") + 1))))
        .otherwise(code)
    )


def code_from_reply(s: Column) -> Column:
    """Code of a reply: the code tag, else the part after a fence, else all."""
    def after(fence: str) -> Column:
        part = F.split_part(s, F.lit(fence), F.lit(2))
        return strip(F.regexp_replace(part, r"```\z", ""))

    tagged = r"(?s)<code>\s*(.*?)\s*</code>"
    return (
        F.when(s.rlike(tagged), strip(F.regexp_extract(s, tagged, 1)))
        .when(contains(s, "```python"), after("```python"))
        .when(contains(s, "```"), after("```"))
        .otherwise(strip(F.coalesce(s, F.lit(""))))
    )


def first_program(s: Column) -> Column:
    """First fenced program of a reply, or the reply itself."""
    python_fence = r"(?s)```python\n(.*?)\n```"
    any_fence = r"(?s)```(.*?)```"
    return (
        F.when(s.rlike(python_fence), F.regexp_extract(s, python_fence, 1))
        .when(s.rlike(any_fence), F.regexp_extract(s, any_fence, 1))
        .otherwise(s)
    )


def between_tags(s: Column, start: str, end: str) -> Column:
    """Every text between two tags, as an array."""
    pattern = f"(?s){re.escape(start)}(.*?){re.escape(end)}"
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(1))


# --- answers ---------------------------------------------------------------------

def answer_tail(s: Column, marker: str = fixed.ANSWER_MARKER) -> Column:
    """Text after the last marker; after ``boxed{`` if that follows; '' without a marker."""
    tail = strip(F.substring_index(s, marker, -1))
    boxed = strip(F.split_part(tail, F.lit(fixed.BOXED_OPEN), F.lit(2)))
    return F.when(~contains(s, marker), F.lit("")).when(contains(tail, fixed.BOXED_OPEN), boxed).otherwise(tail)


def first_choice(s: Column, choices: str = fixed.CHOICES_A_TO_J) -> Column:
    return F.regexp_extract(s, choices, 0)


def first_token(s: Column) -> Column:
    return F.regexp_extract(s, r"\S+", 0)


def clean_prediction(s: Column) -> Column:
    """Final answer without outer dots and blanks, cut to its first token."""
    tail = strip(F.substring_index(s, fixed.ANSWER_MARKER_COLON, -1))
    return F.when(contains(s, fixed.ANSWER_MARKER_COLON), first_token(F.btrim(tail, F.lit(". ")))).otherwise(F.lit(""))


def clean_search_query(reply: Column, question: Column) -> Column:
    s = strip(F.coalesce(reply, F.lit("")))
    s = F.when(contains(s, fixed.SEARCH_MARKER), strip(F.substring_index(s, fixed.SEARCH_MARKER, -1))).otherwise(s)
    unquoted = F.substr(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))
    s = F.when(s.startswith('"') & s.endswith('"'), unquoted).otherwise(s)
    return F.when(F.length(s) < 3, question).otherwise(s)


def number_in(s: Column) -> Column:
    """First number of a text with thousands commas removed, else null."""
    found = F.regexp_extract(strip(s), fixed.NUMBER_PATTERN, 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def same_without_line_breaks(a: Column, b: Column) -> Column:
    return F.translate(a, "\r\n", "") == F.translate(b, "\r\n", "")


# --- reports ------------------------------------------------------------------------

def mentions_any(lowered: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | contains(lowered, word)
    return found


def helpful_status(report: Column) -> Column:
    """PASS / NEED_PATCHING / UNKNOWN where the report has the field, else null."""
    return F.when(
        contains(report, fixed.HELPFUL_FIELD),
        F.when(contains(report, fixed.STATUS_PASS), fixed.STATUS_PASS)
        .when(contains(report, fixed.STATUS_PATCH), fixed.STATUS_PATCH)
        .otherwise(fixed.STATUS_UNKNOWN),
    )


def report_indicators(report: Column) -> list[Column]:
    lowered = F.lower(F.coalesce(report, F.lit("")))
    columns = [
        (F.length(F.coalesce(report, F.lit(""))) > 0).alias("report_available"),
        mentions_any(lowered, fixed.PASS_WORDS).alias("contains_pass"),
        mentions_any(lowered, fixed.PATCH_WORDS).alias("contains_need_patching"),
        mentions_any(lowered, fixed.ERROR_WORDS).alias("contains_error"),
        F.length(F.coalesce(report, F.lit(""))).cast("bigint").alias("report_length"),
        helpful_status(report).alias("library_helpful_status"),
    ]
    return columns + [occurrences_of(lowered, w).alias(f"{w}_mentions") for w in fixed.COUNTED_WORDS]


def experience_list(s: Column) -> Column:
    return strip(F.regexp_extract(s, r"(?s)<experience_list>(.*?)</experience_list>", 1))


def is_effective(s: Column) -> Column:
    return contains(s, fixed.EFFECTIVE_LINE)


def outcome(success: Column, final_message: Column) -> Column:
    """failed / needs_patching / passed; patching is looked for first."""
    return (
        F.when(~success | final_message.isNull(), "failed")
        .when(contains(final_message, fixed.STATUS_PATCH), "needs_patching")
        .when(contains(final_message, fixed.STATUS_PASS), "passed")
        .otherwise("failed")
    )


# --- JSON inside replies -------------------------------------------------------------

def report_json(s: Column) -> Column:
    """VARIANT of the report tag, else of the outermost braces; null if unreadable."""
    start, end = "<final_report>", "</final_report>"
    tagged = strip(F.split_part(F.split_part(s, F.lit(start), F.lit(2)), F.lit(end), F.lit(1)))
    braces = F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))
    return F.try_parse_json(F.when(contains(s, start) & contains(s, end), tagged).otherwise(braces))


def suggestion_field(s: Column) -> Column:
    return F.regexp_extract(s, r'"modification_suggestions":\s*"([^"]*)"', 1)


def operation_list(reply: Column) -> Column:
    """Operations of a reply (a list or an object with one), one level flattened,
    objects only; an empty array if the reply is not JSON."""
    v = F.try_parse_json(reply)
    def as_list(x: Column, path: str = "$") -> Column:
        return F.try_variant_get(x, path, "array<variant>")

    listed = F.coalesce(as_list(v), as_list(v, "$.operations"), F.array().cast("array<variant>"))
    flat = F.flatten(F.transform(listed, lambda x: F.coalesce(as_list(x), F.array(x))))
    return F.filter(flat, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())


# --- lists inside replies -------------------------------------------------------------

def answer_indices(s: Column, size: Column) -> Column:
    """Distinct in-range indices of the answer tags: a numeric list as written,
    else every run of digits. Nothing is evaluated."""
    number_list = r"^\[?\s*-?\d+(\.\d+)?(\s*,\s*-?\d+(\.\d+)?)*\s*\]?$"

    def indices(body: Column) -> Column:
        text = strip(body)
        numbers = F.when(text.rlike(number_list), F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))).otherwise(
            F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
        )
        return F.transform(numbers, lambda n: n.try_cast("double").cast("bigint"))

    found = F.flatten(F.transform(F.regexp_extract_all(s, F.lit(r"<answer>(.*?)</answer>"), F.lit(1)), indices))
    return F.array_distinct(F.filter(found, lambda i: (i >= 0) & (i < size)))


def comma_items(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), strip), lambda x: x != "")
