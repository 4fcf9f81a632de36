"""Evaluation metrics over ``attempts(question_id, attempt, model, correctness,
tool_count, retrieved)``; every metric is per model.

Percentages are doubles from 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.operators.ordering import top_per_group


def percent(part: Column, whole: Column) -> Column:
    return part * 100.0 / whole


def run_accuracy(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Correct replies over all questions; a question without a reply counts wrong."""
    right = attempts.groupBy("model").agg(F.sum("correctness").alias("correct"))
    total = questions.agg(F.count("*")).scalar()
    return right.select("model", "correct", total.alias("questions")).withColumn("accuracy", F.col("correct") / F.col("questions"))


def overall(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("model").agg(
        (F.avg("correctness") * 100).alias("overall_accuracy"),
        ((1 - F.avg("correctness")) * 100).alias("failure_rate"),
        F.count("*").alias("total_samples"),
    )


def per_question(attempts: DataFrame) -> DataFrame:
    """Attempts, successes and first successful attempt of each question."""
    return attempts.groupBy("model", "question_id").agg(
        F.count("*").alias("n"),
        F.sum("correctness").alias("successes"),
        F.min(F.when(F.col("correctness") == 1, F.col("attempt"))).alias("first_success"),
    )


def average_success_rate(attempts: DataFrame) -> DataFrame:
    return per_question(attempts).groupBy("model").agg(
        (F.avg(F.col("successes") / F.col("n")) * 100).alias("average_success_rate")
    )


def success_distribution(attempts: DataFrame) -> DataFrame:
    questions = per_question(attempts)
    totals = questions.groupBy("model").agg(F.count("*").alias("all_questions"))
    counts = questions.groupBy("model", "successes").agg(F.count("*").alias("questions"))
    return counts.join(totals, "model").select(
        "model", "successes", "questions", percent(F.col("questions"), F.col("all_questions")).alias("percentage")
    )


def _passed(k: int) -> Column:
    return F.count_if((F.col("n") >= k) & (F.col("first_success") < k))


def first_attempts(attempts: DataFrame, order: str, n: int) -> DataFrame:
    """The first n attempts of each question and model by a unique column, numbered from
    0. Spark keeps n rows of a question before the shuffle too, so no question is numbered as a whole."""
    ranked = top_per_group(attempts, ["question_id", "model"], [F.col(order)], n, "attempt")
    return ranked.withColumn("attempt", F.col("attempt") - 1)


def pass_at_k(attempts: DataFrame, ks: list[int]) -> DataFrame:
    """Share of questions with a success in the first k attempts; questions with
    fewer than k attempts stay in the denominator only. The first max(ks) attempts will do."""
    stats = per_question(attempts).groupBy("model").agg(
        F.count("*").alias("questions"),
        F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), _passed(k).alias("passed")) for k in ks]).alias("_k"),
    )
    return stats.select("model", "questions", F.inline("_k")).withColumn("pass_at_k", percent(F.col("passed"), F.col("questions")))


def successes_in_first(attempts: DataFrame, ks: list[int]) -> DataFrame:
    """Successes of a question in its first k attempts, for each k: one
    conditional sum per k, combined before the shuffle."""
    sums = attempts.groupBy("model", "question_id").agg(
        *[F.sum(F.when(F.col("attempt") < k, F.col("correctness")).otherwise(0)).alias(f"_s{k}") for k in ks]
    )
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"_s{k}").alias("successes")) for k in ks])
    return sums.select("model", "question_id", F.inline(rows))


def tool_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("model").agg(
        F.avg("tool_count").alias("avg_tools"), F.max("tool_count").alias("max_tools"), F.min("tool_count").alias("min_tools")
    )


def by_tool_count(attempts: DataFrame) -> DataFrame:
    """Histogram of tool counts with the accuracy at each count."""
    totals = attempts.groupBy("model").agg(F.count("*").alias("_all"))
    counts = attempts.groupBy("model", "tool_count").agg(
        F.count("*").alias("samples"), (F.avg("correctness") * 100).alias("accuracy")
    )
    return counts.join(totals, "model").select(
        "model", "tool_count", "samples", percent(F.col("samples"), F.col("_all")).alias("percentage"), "accuracy"
    )


def most_retrieved(attempts: DataFrame, n: int) -> DataFrame:
    """The n most retrieved tools of each model, ties by name, with their share of attempts."""
    totals = attempts.groupBy("model").agg(F.count("*").alias("_all"))
    used = attempts.select("model", F.explode("retrieved").alias("name")).groupBy("model", "name").agg(F.count("*").alias("frequency"))
    top = top_per_group(used, ["model"], [F.desc("frequency"), F.col("name")], n)
    return top.join(totals, "model").select(
        "model", "rank", "name", "frequency", percent(F.col("frequency"), F.col("_all")).alias("percentage")
    )


def compare_models(attempts: DataFrame, first: DataFrame) -> DataFrame:
    """One row per model: accuracy, pass@1, pass@4, average success rate, tools
    per sample and the most used tool. ``first`` has the first four attempts of each
    question; the other figures need no order."""
    questions = attempts.groupBy("model", "question_id").agg(
        F.count("*").alias("n"), F.sum("correctness").alias("successes"), F.sum("tool_count").alias("tools"), F.max("tool_count").alias("max_tools")
    )
    summary = questions.groupBy("model").agg(
        percent(F.sum("successes"), F.sum("n")).alias("overall_accuracy"),
        (F.avg(F.col("successes") / F.col("n")) * 100).alias("average_success_rate"),
        (F.sum("tools") / F.sum("n")).alias("avg_tools"),
        F.max("max_tools").alias("max_tools"),
    )
    passed = per_question(first).groupBy("model").agg(
        percent(_passed(1), F.count("*")).alias("pass_at_1"), percent(_passed(4), F.count("*")).alias("pass_at_4")
    )
    used = attempts.select("model", F.explode("retrieved").alias("name")).groupBy("model", "name").agg(F.count("*").alias("frequency"))
    top = used.groupBy("model").agg(F.min_by("name", F.struct((-F.col("frequency")).alias("f"), "name")).alias("most_used_tool"))
    columns = ["model", "overall_accuracy", "pass_at_1", "pass_at_4", "average_success_rate", "avg_tools", "max_tools", "most_used_tool"]
    return summary.join(passed, "model", "left").join(top, "model", "left").select(*columns)


def answer_diversity(attempts: DataFrame, answer: Column, reasoning: Column) -> DataFrame:
    return attempts.groupBy("question_id").agg(
        F.countDistinct(answer).alias("distinct_answers"),
        F.countDistinct(reasoning).alias("distinct_reasonings"),
        F.count("*").alias("attempts"),
    )


def compare_runs(stats: DataFrame, key: str, left: str, right: str, on: list[str], metric: str) -> DataFrame:
    """Difference of a metric between two runs of a statistics table."""
    a = stats.where(F.col(key) == left).select(*on, F.col(metric).alias("left_value"))
    b = stats.where(F.col(key) == right).select(*on, F.col(metric).alias("right_value"))
    return a.join(b, on).withColumn("difference", F.col("right_value") - F.col("left_value"))


def expand_attempts(questions: DataFrame, k: int) -> DataFrame:
    """k rows per question with ids ``<question>_<attempt>``."""
    return questions.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("attempt")).withColumn(
        "id", F.concat_ws("_", F.col("question_id").cast("string"), F.col("attempt").cast("string"))
    )


def split_attempt_id(attempt_id: Column) -> Column:
    """Question part of an attempt id: text before the last underscore."""
    return F.regexp_replace(attempt_id, r"_[^_]*\z", "")
