"""Expressions over columns of Python source text. Source is read, never run."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolmill.functions import fixed
from toolmill.functions.text import let, strip


# --- names ---------------------------------------------------------------------

def clean_tool_name(name: Column) -> Column:
    """Lower-case identifier of at most 64 characters, ``tool_`` in front where it
    would not start with a letter."""
    base = F.lower(F.btrim(F.regexp_replace(name, r"[^a-zA-Z0-9_]+", "_"), F.lit("_")))
    named = (
        F.when(base == "", "tool")
        .when(~base.rlike(r"^[a-zA-Z]"), F.concat(F.lit("tool_"), base))
        .otherwise(base)
    )
    return F.substring(named, 1, fixed.NAME_LENGTH)


def slug(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9_\-\s]", "")
    joined = F.btrim(F.regexp_replace(kept, r"[\s\-]+", "_"), F.lit("_"))
    return F.when(joined == "", fixed.GENERATED_NAME).otherwise(joined)


def definition_count(code: Column, name: Column) -> Column:
    """How often ``def name(`` occurs in the code."""
    pattern = F.concat(F.lit("def "), name, F.lit("("))
    return F.try_divide(F.length(code) - F.length(F.replace(code, pattern, F.lit(""))), F.length(pattern)).cast("bigint")


def first_function(code: Column) -> Column:
    return F.regexp_extract(code, r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1)


# runs of plain characters are possessive, so that long literals need no deep recursion
LITERALS = r"""(?s)\"{3}.*?\"{3}|'{3}.*?'{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|#[^\n]*"""


def first_class(code: Column) -> Column:
    return F.regexp_extract(code, r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1)


def docstring(code: Column, keyword: str = "def") -> Column:
    return strip(F.regexp_extract(code, rf'(?s){keyword}\s.*?:\s*(?:"""(.*?)""")?', 1))


def without_literals(code: Column) -> Column:
    """Code with its comments gone and its string literals empty."""
    return F.regexp_replace(code, LITERALS, '""')


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def public_function(code: Column, parses: Column | None = None) -> Column:
    """Public top-level function: the only one, the only one without a leading
    underscore, ``execute`` if defined, else the first. Code that does not parse
    (``parses`` false) gives its first one."""
    names = F.regexp_extract_all(
        without_literals(F.replace(code, F.lit(fixed.FUTURE_IMPORT), F.lit(""))),
        F.lit(r"(?m)^(?:async\s+)?def\s+([a-zA-Z_]\w*)\s*\("),
        F.lit(1),
    )
    public = F.filter(names, lambda n: ~n.startswith("_"))
    first = F.get(names, F.lit(0))
    return (
        F.when(F.size(names) == 0, "")
        .when(F.lit(False) if parses is None else ~parses, first)
        .when(F.size(names) == 1, first)
        .when(F.size(public) == 1, F.get(public, F.lit(0)))
        .when(F.array_contains(names, "execute"), "execute")
        .otherwise(first)
    )


# --- blocks and calls --------------------------------------------------------------

def top_level_blocks(program: Column) -> Column:
    """Top-level ``def`` / ``class`` blocks of a program, text before the first
    dropped, each block stripped."""
    parts = F.split(F.concat(F.lit("\n"), program), r"\n(?=(?:def|class)\s)")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), strip)


def is_called(code: Column, name: Column) -> Column:
    """Whether ``name(`` occurs on a line that is neither import nor comment."""
    return F.exists(
        F.split(code, "\n"),
        lambda line: ~F.ltrim(line, F.lit(fixed.BLANK)).rlike(r"^(import|from|#)") & F.contains(line, F.concat(name, F.lit("("))),
    )


# --- signature and docstring ----------------------------------------------------------

def normal_type(type_text: Column) -> Column:
    return F.lower(F.replace(strip(type_text), F.lit(" "), F.lit("")))


WRAPPER = r"(optional\[|(?:typing\.)?list\[)"


def json_type(normalized: Column) -> Column:
    """JSON-schema text of a normalized declared type. Leading ``optional[`` and
    ``list[`` are peeled as far as closing brackets match them; what is left is a
    mapping, a tuple, a known name, or a string."""
    opened = F.regexp_extract_all(F.regexp_extract(normalized, f"^{WRAPPER}+", 0), F.lit(WRAPPER), F.lit(1))

    def peel(x: Column) -> Column:
        matched = F.least(F.size(x["opened"]), F.length(F.regexp_extract(x["t"], r"\]*$", 0)))
        whole = F.length(F.array_join(F.slice(x["opened"], F.lit(1), matched), "")) + matched == F.length(x["t"])
        return F.struct(x["t"].alias("t"), F.slice(x["opened"], F.lit(1), F.when(whole, F.greatest(matched - 1, F.lit(0))).otherwise(matched)).alias("kept"))

    def write(x: Column) -> Column:
        before = F.length(F.array_join(x["kept"], ""))
        core = F.substr(x["t"], before + 1, F.length(x["t"]) - before - F.size(x["kept"]))
        lists = F.size(F.filter(x["kept"], lambda w: w.contains("list")))
        return F.concat(F.repeat(F.lit('{"type":"array","items":'), lists), F.lit('{"type":"'), let(core, core_type), F.lit('"}'), F.repeat(F.lit("}"), lists))

    known = let(F.struct(normalized.alias("t"), opened.alias("opened")), lambda x: let(peel(x), write))
    return F.when(normalized.isNull(), '{"type":"string"}').otherwise(known)


def core_type(t: Column) -> Column:
    named = F.when(t.rlike(r"^(?:typing\.)?(?:dict|mapping)\[.+\]$"), "object").when(t.rlike(r"^(?:typing\.)?tuple\[.+\]$"), "array")
    for name, target in fixed.TYPE_NAMES.items():
        named = named.when(t == name, target)
    return named.otherwise("string")


def is_optional(normalized: Column) -> Column:
    return F.coalesce(normalized.startswith("optional["), F.lit(False))


def signature_params(code: Column) -> Column:
    """Array of (name, type_text, has_default) of the first signature. The list is
    split on every comma, so ``Dict[str, int]`` loses its second half."""
    blob = strip(F.regexp_extract(code, fixed.SIGNATURE_PATTERN, 2))
    raws = F.filter(F.transform(F.split(blob, r",\s*"), strip), lambda r: ~r.isin("", "*", "**"))
    typed, defaulted = fixed.TYPED_PARAMETER, fixed.DEFAULTED_PARAMETER

    def parse(raw: Column) -> Column:
        return F.when(
            raw.rlike(typed),
            F.struct(
                F.regexp_extract(raw, typed, 1).alias("name"),
                F.nullif(strip(F.regexp_extract(raw, typed, 2)), F.lit("")).alias("type_text"),
                (F.regexp_extract(raw, typed, 3) != "").alias("has_default"),
            ),
        ).when(
            raw.rlike(defaulted) | raw.rlike(r"^[a-zA-Z_]\w*$"),
            F.struct(
                F.regexp_extract(raw, r"^([a-zA-Z_]\w*)", 1).alias("name"),
                F.lit(None).cast("string").alias("type_text"),
                raw.rlike(defaulted).alias("has_default"),
            ),
        )

    return F.filter(F.transform(raws, parse), lambda p: p.isNotNull())


def splits_a_type(code: Column) -> Column:
    """Flags signatures whose comma split cuts a bracketed type."""
    return F.regexp_extract(code, fixed.SIGNATURE_PATTERN, 2).rlike(r"\[[^\]]*,")


def doc_params(code: Column) -> Column:
    """Array of (name, type_text, description) of the docstring's argument section:
    the lines after its heading up to the next heading, or the first blank line
    once a parameter was read."""

    def after_heading(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda l: l.rlike(fixed.DOC_ARGS_LINE)), True)
        rest = F.when(start > 0, F.slice(lines, (start + 1).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
        return F.transform(
            rest,
            lambda l, i: F.struct(
                i.alias("i"), l.alias("line"), l.rlike(fixed.DOC_SECTION_LINE).alias("heading"),
                l.rlike(fixed.DOC_PARAM_LINE).alias("param"), (strip(l) == "").alias("blank"),
            ),
        )

    def positions(rows: Column, test) -> Column:
        return F.transform(F.filter(rows, test), lambda r: r["i"])

    def with_first(rows: Column) -> Column:
        first = F.array_min(positions(rows, lambda r: r["param"] & ~r["heading"]))
        return let(F.struct(rows.alias("rows"), first.alias("first")), with_end)

    def with_end(x: Column) -> Column:
        end = F.array_min(positions(x["rows"], lambda r: r["heading"] | (r["blank"] & (r["i"] > x["first"]))))
        return let(F.struct(x["rows"].alias("rows"), F.coalesce(end, F.size(x["rows"])).alias("end")), read)

    def read(x: Column) -> Column:
        return F.transform(
            F.filter(x["rows"], lambda r: r["param"] & (r["i"] < x["end"])),
            lambda r: F.struct(
                F.regexp_extract(r["line"], fixed.DOC_PARAM_LINE, 1).alias("name"),
                F.nullif(strip(F.regexp_extract(r["line"], fixed.DOC_PARAM_LINE, 2)), F.lit("")).alias("type_text"),
                strip(F.regexp_extract(r["line"], fixed.DOC_PARAM_LINE, 3)).alias("description"),
            ),
        )

    return let(F.split(code, r"\r?\n"), lambda lines: let(after_heading(lines), with_first))


def summary_line(code: Column) -> Column:
    """First non-empty line, quotes stripped, that is not a signature."""
    cleaned = F.transform(F.split(code, r"\r?\n"), lambda l: F.btrim(strip(l), F.lit("\"'")))
    found = F.get(F.filter(cleaned, lambda l: (l != "") & ~l.startswith("def ")), F.lit(0))
    return F.coalesce(found, F.lit(fixed.GENERATED_SUMMARY))


def function_name(code: Column) -> Column:
    signed = F.regexp_extract(code, fixed.SIGNATURE_PATTERN, 1)
    return F.when(signed != "", signed).otherwise(F.substring(slug(summary_line(code)), 1, fixed.NAME_LENGTH))


def merge_params(signature: Column, documented: Column) -> Column:
    """Array of (name, json_type, description, required): the signature decides
    which parameters exist, a documented type overrides the declared one, and a
    function without parameters takes one free-form input."""

    def with_docs(documented: Column) -> Column:
        def with_doc(p: Column) -> Column:
            return F.struct(p.alias("p"), F.try_element_at(F.filter(documented, lambda d: d["name"] == p["name"]), F.lit(-1)).alias("doc"))

        return F.transform(signature, with_doc)

    def with_type(x: Column) -> Column:
        return F.struct(
            x["p"].alias("p"),
            F.coalesce(x["doc"]["description"], F.lit("")).alias("description"),
            normal_type(F.coalesce(x["doc"]["type_text"], x["p"]["type_text"])).alias("t"),
        )

    def final(x: Column) -> Column:
        return F.struct(
            x["p"]["name"].alias("name"),
            json_type(x["t"]).alias("json_type"),
            x["description"].alias("description"),
            (~x["p"]["has_default"] & ~is_optional(x["t"])).alias("required"),
        )

    generic = F.struct(
        F.lit("input").alias("name"), F.lit('{"type":"string"}').alias("json_type"),
        F.lit("Free-form input").alias("description"), F.lit(True).alias("required"),
    )
    merged = F.transform(F.transform(let(documented, with_docs), with_type), final)
    return F.when(F.size(signature) == 0, F.array(generic)).otherwise(merged)


# --- syntax -----------------------------------------------------------------------------

SYNTAX = T.StructType([
    T.StructField("valid", T.BooleanType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("line", T.IntegerType()),
])


@F.pandas_udf(SYNTAX)
def python_syntax(codes: pd.Series) -> pd.DataFrame:
    """Whether a source text parses, however long it is. Blank text is valid."""

    def check(code: str | None) -> tuple[bool, str | None, int | None]:
        if not code or not code.strip():
            return True, None, None
        try:
            ast.parse(code)
        except SyntaxError as error:
            return False, "SyntaxError", error.lineno
        except (ValueError, RecursionError, MemoryError) as error:
            return False, type(error).__name__, None
        return True, None, None

    result = pd.DataFrame([check(code) for code in codes], columns=["valid", "error_type", "line"])
    return result.astype({"line": "Int32"})
