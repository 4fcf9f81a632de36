"""Scoring of replies against the expected answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.functions import fixed
from toolmill.functions.text import answer_tail, clean_prediction, first_choice, first_token, number_in, strip


def score_choices(replies: DataFrame, eval_type: str = "multiple_choice", marker: str = fixed.ANSWER_MARKER) -> DataFrame:
    """Adds the predicted tail, ``correct_contains`` (expected answer contained in
    the lower-cased tail) and ``correct_choice`` (first letter A-J equals it)."""
    if eval_type not in fixed.EVAL_TYPES:
        raise ValueError(f"eval_type must be one of {fixed.EVAL_TYPES}")
    truth = F.col("ground_truth")
    tail = F.col("pred_answer")
    scored = replies.withColumn("pred_answer", answer_tail(F.col("response"), marker))
    if eval_type == "number":
        value = F.ltrim(tail, F.lit(": "))  # the marker may end in a colon
        return scored.withColumn("correctness", grade_number(value, truth).cast("bigint"))
    return (
        scored.withColumn("pred_choice", first_choice(tail))
        .withColumn("correct_contains", F.contains(F.lower(tail), F.lower(truth)).cast("bigint"))
        .withColumn("correct_choice", ((F.col("pred_choice") == truth) & (truth != "")).cast("bigint"))
        .withColumn("empty_truth", (truth == ""))
    )


def predicted_letter(response: Column, choices: str, marker: str = fixed.ANSWER_MARKER_COLON) -> Column:
    """First letter of the class after the last marker, else the first token."""
    tail = strip(F.substring_index(response, marker, -1))
    letter = first_choice(tail, choices)
    return F.when(~F.contains(response, F.lit(marker)), "").when(letter != "", letter).otherwise(first_token(tail))


def predicted_plain(response: Column, marker: str = fixed.ANSWER_MARKER_COLON) -> Column:
    """Tail after the last marker without trailing dots."""
    tail = F.rtrim(strip(F.substring_index(response, marker, -1)), F.lit("."))
    return F.when(F.contains(response, F.lit(marker)), tail).otherwise("")


def predicted_first(response: Column, marker: str = fixed.ANSWER_MARKER_SPACE) -> Column:
    """First character of the text after the last marker (of the whole text without one)."""
    return F.substring(strip(F.substring_index(response, marker, -1)), 1, 1)


def question_prompt(question: Column, eval_type: Column, templates: dict[str, str], other: str) -> Column:
    """The template of the evaluation type, or ``other``, with the question for ``{question}``."""
    template = F.lit(other)
    for name, text in templates.items():
        template = F.when(eval_type == name, F.lit(text)).otherwise(template)
    return F.replace(template, F.lit("{question}"), question)


def answer_contained(truth: Column, predicted: Column) -> Column:
    return F.contains(F.lower(predicted), F.lower(truth)).cast("bigint")


def grade_number(result: Column, truth: Column) -> Column:
    """Numbers equal within the tolerance; equal texts where either has no number."""
    a, b = number_in(result), number_in(truth)
    return F.when(
        a.isNotNull() & b.isNotNull(), F.abs(a - b) < fixed.NUMBER_TOLERANCE
    ).otherwise(F.coalesce(strip(result) == strip(truth), F.lit(False)))


def correct_training_rows(replies: DataFrame) -> DataFrame:
    """Replies whose cleaned prediction equals the expected answer, both non-empty."""
    predicted = replies.withColumn("pred_answer", clean_prediction(F.col("response")))
    return predicted.where(
        (F.col("pred_answer") != "")
        & (F.col("ground_truth") != "")
        & (F.lower(strip(F.col("pred_answer"))) == F.lower(strip(F.col("ground_truth"))))
    )
