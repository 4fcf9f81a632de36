"""Token, cost and call-log statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.functions import fixed


def word_count(text: Column) -> Column:
    """Words between blanks of any script."""
    return F.regexp_count(text, F.lit(f"[^{fixed.BLANK}]+"))


def token_estimate(text: Column) -> Column:
    return F.floor(word_count(text) * fixed.TOKENS_PER_WORD).cast("bigint")


def cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Price of a call; models without a listed price cost nothing."""
    price = F.lit(0.0)
    for name, (dear_in, dear_out) in fixed.PRICE_PER_MILLION.items():
        price = F.when(F.lower(model) == name, input_tokens / 1e6 * dear_in + output_tokens / 1e6 * dear_out).otherwise(price)
    return price


def call_summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("step_name", "model_name").agg(
        F.count("*").alias("calls"),
        F.count_if("success").alias("successes"),
        F.sum("prompt_length").alias("prompt_length"),
        F.sum("response_length").alias("response_length"),
    )
