"""Blueprint blocks: ``cover(cluster_name, sib_index, covered)`` lists the tool
positions a block covers, one row each; ``tools(cluster_name, pos, …)`` the
cluster's tools; ``results(cluster_name, sib_index, seq, question, success,
final_report)`` the optimisation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.functions import fixed
from toolmill.functions.text import outcome, strip
from toolmill.operators.ordering import PAGE_CHARS, first_rows, ordered_text, pages

UNIT = ["cluster_name", "sib_index"]


def covered_tools(cover: DataFrame, tools: DataFrame, index_base: int = 0) -> DataFrame:
    """Blocks with the tools they cover; positions outside the cluster drop out."""
    placed = cover.select(*UNIT, (F.col("covered") - index_base).alias("pos"))
    return placed.join(tools, ["cluster_name", "pos"])


def usable(tools: DataFrame) -> DataFrame:
    """Tools with a question and an answer."""
    return tools.where((F.col("question") != "") & (F.col("answer") != ""))


def block_questions(cover: DataFrame, tools: DataFrame) -> DataFrame:
    """Questions of a block, the first tool wins per question text."""
    return first_rows(usable(covered_tools(cover, tools)), [*UNIT, "question"], F.col("pos"), ["answer", "pos"])


def cluster_questions(tools: DataFrame) -> DataFrame:
    """Questions of a cluster, the last answer wins, placed by first position."""
    return usable(tools).groupBy("cluster_name", "question").agg(
        F.max_by("answer", "pos").alias("answer"), F.min("pos").alias("first_pos")
    )


def questions_with_results(cover: DataFrame, tools: DataFrame, results: DataFrame) -> DataFrame:
    """Each covered question with the first optimisation result of its text in the block."""
    first = first_rows(results, [*UNIT, "question"], F.col("seq"), ["success", "final_report"])
    return usable(covered_tools(cover, tools)).join(first, [*UNIT, "question"], "left")


def question_statistics(questions: DataFrame, keys: list[str]) -> DataFrame:
    return questions.groupBy(*keys).agg(
        F.count("*").alias("total_questions"),
        F.count_if(F.col("success")).alias("optimized_questions"),
        F.count_if(~F.col("success")).alias("failed_optimizations"),
        F.count_if(F.col("success").isNull()).alias("unoptimized_questions"),
    )


def solver_performance(cover: DataFrame, tools: DataFrame, results: DataFrame) -> DataFrame:
    """Per block: results, successes, failures and tools without a result (the
    difference of the two counts, so it can be negative)."""
    originals = covered_tools(cover, tools).groupBy(*UNIT).agg(F.count("*").alias("original_tools"))
    solved = results.groupBy(*UNIT).agg(
        F.count("*").alias("questions_optimized"),
        F.count_if(F.col("success")).alias("questions_successful"),
        F.count_if(~F.col("success")).alias("questions_failed"),
    )
    joined = cover.select(*UNIT).distinct().join(originals, UNIT, "left").join(solved, UNIT, "left")
    filled = joined.fillna(0)
    return filled.withColumn("questions_unoptimized", F.col("original_tools") - F.col("questions_optimized")).withColumn(
        "success_rate", F.coalesce(F.try_divide("questions_successful", "questions_optimized"), F.lit(0.0))
    )


def overall_solver_statistics(performance: DataFrame) -> DataFrame:
    sums = performance.agg(
        F.sum("questions_optimized").alias("total_questions"),
        F.sum("questions_successful").alias("successful_optimizations"),
        F.sum("questions_failed").alias("failed_optimizations"),
        F.sum("questions_unoptimized").alias("unoptimized_questions"),
    )
    asked = F.col("total_questions")
    return sums.withColumn(
        "overall_success_rate", F.coalesce(F.try_divide("successful_optimizations", asked), F.lit(0.0))
    ).withColumn(
        "optimization_coverage", F.coalesce(F.try_divide(asked, asked + F.col("unoptimized_questions")), F.lit(0.0))
    )


def classify_results(results: DataFrame) -> DataFrame:
    return results.withColumn("outcome", outcome(F.col("success"), F.col("final_report")))


def outcome_counts(classified: DataFrame, keys: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "needs_patching", "failed")]
    return classified.groupBy(*keys).agg(*counts, F.count("*").alias("total")).withColumn(
        "needs_refinement", (F.col("needs_patching") > 0) | (F.col("failed") > 0)
    )


def cluster_summary(tools: DataFrame, final_tools: DataFrame) -> DataFrame:
    """Per cluster: tools, final tools, success (at least one final tool)."""
    sizes = tools.groupBy("cluster_name").agg(F.count("*").alias("total_tools"))
    final = final_tools.groupBy("cluster_name").agg(F.count("*").alias("final_tools"))
    return (
        sizes.join(final, "cluster_name", "left")
        .withColumn("final_tools", F.coalesce("final_tools", F.lit(0)))
        .withColumn("success", F.col("final_tools") > 0)
    )


def run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("total_clusters"),
        F.count_if("success").alias("successful_clusters"),
        F.count_if(~F.col("success")).alias("failed_clusters"),
        F.sum("total_tools").alias("total_tools"),
    )


def run_summary(summary: DataFrame, tools: DataFrame, results: DataFrame) -> DataFrame:
    """Run totals with unique questions and outcomes of the successful clusters."""
    asked = cluster_questions(tools).groupBy("cluster_name").agg(F.count("*").alias("unique_questions"))
    outcomes = outcome_counts(classify_results(results), ["cluster_name"])
    joined = summary.join(asked, "cluster_name", "left").join(outcomes, "cluster_name", "left")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("success"), F.col(column))), F.lit(0))

    return joined.agg(
        F.count("*").alias("total_clusters"),
        F.count_if("success").alias("successful_clusters"),
        F.count_if(~F.col("success")).alias("failed_clusters"),
        total("unique_questions").alias("total_unique_questions"),
        total("passed").alias("total_passed"),
        total("needs_patching").alias("total_needs_patching"),
        total("failed").alias("total_failed"),
    )


def coverage_references(cover: DataFrame, keys: list[str]) -> DataFrame:
    return cover.groupBy(*keys).agg(F.count("*").alias("coverage_references"))


def suggestions(rows: DataFrame, page_chars: int = PAGE_CHARS) -> DataFrame:
    """``- From Tool<i>: …`` lines of a block in tool order, tools numbered from 1
    before empty suggestions drop out; pages of about ``page_chars`` characters keep texts bounded."""
    said = pages(rows, UNIT, "pos", F.col("suggestion"), page_chars).where(F.col("suggestion") != "")
    line = F.concat(F.lit("- From Tool"), (F.col("page_pos") + 1).cast("string"), F.lit(": "), F.col("suggestion"))
    return ordered_text(said, [*UNIT, "page", "n_pages"], "page_pos", line, "suggestions")


def pending_units(planned: DataFrame, completed: DataFrame) -> DataFrame:
    return planned.select(*UNIT).distinct().join(completed, UNIT, "left_anti")


def tools_by_position(blueprints: DataFrame) -> DataFrame:
    """Position → tool from the parallel arrays of each block, first occurrence wins."""
    pairs = blueprints.select(
        *UNIT, F.posexplode(F.arrays_zip("covered", "tools")).alias("i", "pair")
    ).select(*UNIT, "i", "pair.covered", "pair.tools").where(F.col("covered").isNotNull() & F.col("tools").isNotNull())
    return pairs.groupBy("cluster_name", F.col("covered").alias("pos")).agg(
        F.min_by("tools", F.struct("sib_index", "i")).alias("tool")
    )


def merged_library(sources: DataFrame) -> DataFrame:
    """One library per cluster as ordered rows ``(cluster_name, part, sib_index,
    line_no, text)``: future imports, imports (each line once, at its first
    place), then the body of every block. Imports are deduplicated by an
    aggregate, bodies never leave their row."""
    lines = F.split("code", r"\r?\n")
    future, imports = F.lit(fixed.FUTURE_LINE), F.lit(fixed.IMPORT_LINE)
    numbered = F.transform(lines, lambda l, i: F.struct(i.alias("line_no"), l.alias("line")))
    placed = sources.select("cluster_name", "sib_index", F.inline(F.filter(numbered, lambda r: F.rlike(r["line"], imports)))).select(
        "cluster_name", "sib_index", "line_no", strip(F.col("line")).alias("text")
    )
    hoisted = (
        placed.withColumn("part", F.when(F.rlike("text", future), 1).otherwise(2))
        .groupBy("cluster_name", "part", "text")
        .agg(F.min(F.struct("sib_index", "line_no")).alias("_at"))
        .select("cluster_name", "part", "_at.sib_index", "_at.line_no", "text")
    )
    bodies = sources.select(
        "cluster_name",
        F.lit(3).alias("part"),
        "sib_index",
        F.lit(0).alias("line_no"),
        strip(F.array_join(F.filter(lines, lambda l: ~F.rlike(l, imports)), "\n")).alias("text"),
    )
    return hoisted.unionByName(bodies)


# --- block text -----------------------------------------------------------------------

def parse_blocks(blueprints: DataFrame) -> DataFrame:
    """Blocks of blueprint texts with their covered tool numbers (sorted, distinct)."""
    sections = blueprints.select("cluster_name", F.posexplode(F.split("text", "<SIB>")).alias("sib_index", "section"))
    content = strip(F.split_part("section", F.lit("</SIB>"), F.lit(1)))
    blocks = sections.where(F.col("sib_index") > 0).select("cluster_name", "sib_index", content.alias("content"))
    listed = F.regexp_extract("content", r"(?is)\[Covered Tools\]\s*\n(.*?)(?:\n\[|\z)", 1)
    named = F.regexp_extract_all(listed, F.lit(r"(?i)tool\s*(\d+)"), F.lit(1)).cast("array<int>")
    bare = F.regexp_extract_all(listed, F.lit(r"\b(\d+)\b"), F.lit(1)).cast("array<int>")
    return blocks.where(F.col("content") != "").withColumn("covered", F.array_sort(F.array_union(named, bare)))
