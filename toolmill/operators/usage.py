"""Usage statistics of tools over optimisation iterations.

``problems(subfield, iter, problem_id, is_correct)`` and ``calls(subfield, iter,
problem_id, tool_id, is_correct)``, one row per problem and called tool;
``tools(subfield, tool_id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from toolmill.functions import fixed
from toolmill.operators.ordering import first_rows, seeded_sample_per_group, top_per_group


def usage_by_iteration(calls: DataFrame) -> DataFrame:
    """Calls and correct calls of a tool up to each iteration it was used in. The
    window runs over iterations of aggregated rows."""
    counts = calls.groupBy("subfield", "tool_id", "iter").agg(
        F.count("*").alias("calls"), F.sum(F.col("is_correct").cast("bigint")).alias("right")
    )
    so_far = W.partitionBy("subfield", "tool_id").orderBy("iter").rowsBetween(W.unboundedPreceding, 0)
    return counts.select(
        "subfield", "tool_id", "iter", F.sum("calls").over(so_far).alias("freq"), F.sum("right").over(so_far).alias("tsr")
    )


def usage_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("subfield", "tool_id").agg(
        F.count("*").alias("freq"), F.sum(F.col("is_correct").cast("bigint")).alias("tsr")
    )


def needs_modification(usage: DataFrame, ratio: float = fixed.MODIFY_RATIO) -> DataFrame:
    return usage.where((F.col("freq") > 1) & (F.col("tsr") / F.col("freq") <= ratio))


def decayed(usage: DataFrame) -> DataFrame:
    """Statistics of a modified tool start at half, at least 1."""
    return usage.withColumn("freq", F.greatest(F.lit(1.0), F.col("freq") / 2)).withColumn(
        "tsr", F.greatest(F.lit(1.0), F.col("tsr") / 2)
    )


def without_tool(problems: DataFrame, calls: DataFrame) -> DataFrame:
    """Problems solved or tried without any tool, as rows."""
    return problems.join(calls, ["subfield", "iter", "problem_id"], "left_anti")


def iteration_accuracy(problems: DataFrame, calls: DataFrame) -> DataFrame:
    """TA (accuracy), TSC (share of problems that used a tool) and counts."""
    key = ["subfield", "iter"]
    all_problems = problems.groupBy(*key).agg(
        F.count("*").alias("len_questions"), F.avg(F.col("is_correct").cast("double")).alias("ta")
    )
    used = calls.select(*key, "problem_id").distinct().groupBy(*key).agg(F.count("*").alias("with_tool"))
    return (
        all_problems.join(used, key, "left")
        .withColumn("with_tool", F.coalesce("with_tool", F.lit(0)))
        .withColumn("len_without_tool", F.col("len_questions") - F.col("with_tool"))
        .withColumn("tsc", F.col("with_tool") / F.col("len_questions"))
    )


def iteration_loss(problems: DataFrame, calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Loss of the tool set after each iteration.

    A tool costs 1 - TSR/Freq (1 if unused), so the sum over all tools is the
    number of tools minus the ratios of the used ones. Ratios are added up as
    changes per iteration; no grid of tools and iterations is built.
    """
    by_tool = W.partitionBy("subfield", "tool_id").orderBy("iter")
    ratios = usage_by_iteration(calls).withColumn("ratio", F.col("tsr") / F.col("freq"))
    changes = (
        ratios.withColumn("change", F.col("ratio") - F.coalesce(F.lag("ratio").over(by_tool), F.lit(0.0)))
        .groupBy("subfield", "iter").agg(F.sum("change").alias("change"))
    )
    n_tools = tools.groupBy("subfield").agg(F.count("*").alias("n"))
    so_far = W.partitionBy("subfield").orderBy("iter").rowsBetween(W.unboundedPreceding, 0)
    stats = (
        iteration_accuracy(problems, calls)
        .join(changes, ["subfield", "iter"], "left")
        .withColumn("ratios", F.sum(F.coalesce("change", F.lit(0.0))).over(so_far))
        .join(n_tools, "subfield", "left")  # a group without tools is padded like any small one
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    target = fixed.LOSS_TARGET_TOOLS
    per_tool = F.col("len_questions") / F.greatest(F.lit(1), F.col("n"))
    return (
        stats.withColumn("q_tools", F.col("n") - F.col("ratios") + F.greatest(F.lit(0), target - F.col("n")))
        .withColumn("q_set", F.col("len_without_tool") + fixed.LOSS_ACCURACY_WEIGHT * (1 - F.col("ta")) * F.col("len_questions"))
        .withColumn(
            "loss",
            F.greatest(F.lit(1.0), per_tool) * F.col("q_tools")
            + fixed.LOSS_BETA * F.col("q_set")
            + per_tool * F.greatest(F.lit(0), F.col("n") - target),
        )
        .select("subfield", "iter", "tsc", "ta", "n", "len_questions", "len_without_tool", "q_tools", "q_set", "loss")
    )


def rollbacks(losses: DataFrame) -> DataFrame:
    """Iterations whose loss is above the accepted one. A rollback copies the
    accepted loss forward, so the accepted loss is the running minimum; two
    rollbacks in a row end the run."""
    order = W.partitionBy("subfield").orderBy("iter")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    flagged = losses.select("subfield", "iter", "loss").withColumn("accepted_before", F.min("loss").over(earlier)).withColumn(
        "rollback", F.coalesce(F.col("loss") > F.col("accepted_before"), F.lit(False))
    )
    twice = F.col("rollback") & F.coalesce(F.lag("rollback").over(order), F.lit(False))
    return (
        flagged.withColumn("stops", twice)
        .withColumn("executed", ~F.coalesce(F.max("stops").over(earlier), F.lit(False)))
        .withColumn("accepted_loss", F.least("loss", F.coalesce("accepted_before", "loss")))
    )


def last_wrong_calls(calls: DataFrame, n: int = fixed.WRONG_EXAMPLES) -> DataFrame:
    wrong = calls.where(~F.col("is_correct"))
    return top_per_group(wrong, ["subfield", "tool_id"], [F.desc("iter"), F.desc("problem_id")], n)


def unsolved_head(unused: DataFrame, problems: DataFrame, n: int) -> DataFrame:
    """First n problems without a tool per iteration, with their text."""
    first = top_per_group(unused.select("subfield", "iter", "problem_id"), ["subfield", "iter"], [F.col("problem_id")], n)
    return first.join(problems.select("problem_id", "problem_text"), "problem_id")


def unsolved_sample(unused: DataFrame, n: int = fixed.UNSOLVED_SAMPLE, seed: int = 42) -> DataFrame:
    return seeded_sample_per_group(unused.select("subfield", "iter", "problem_id"), ["subfield", "iter"], "problem_id", n, seed)


def usage_examples(calls: DataFrame) -> DataFrame:
    """Called tools with their first correct call, if any."""
    right = first_rows(calls.where("is_correct"), ["subfield", "tool_id"], F.struct("iter", "problem_id"), ["iter", "problem_id"])
    example = right.select("subfield", "tool_id", F.col("iter").alias("example_iter"), F.col("problem_id").alias("example_problem"))
    return calls.select("subfield", "tool_id").distinct().join(example, ["subfield", "tool_id"], "left")


def select_problems(members: DataFrame, knowledge: DataFrame, large: int = fixed.SMALL_CLUSTER) -> DataFrame:
    """Problem ids of a field's subfield: all of its small clusters; from clusters over
    ``large`` ids only those with exactly one knowledge row, of that field and subfield."""
    sizes = members.groupBy("field", "subfield", "cluster").agg(F.count("*").alias("size"))
    single = (
        knowledge.groupBy("id").agg(F.count("*").alias("n"), F.min("field").alias("field"), F.min("subfield").alias("subfield"))
        .where(F.col("n") == 1).select("id", "field", "subfield", F.lit(True).alias("single"))
    )
    return (
        members.join(sizes, ["field", "subfield", "cluster"]).join(single, ["id", "field", "subfield"], "left")
        .where((F.col("size") <= large) | F.col("single"))
        .select("field", "subfield", "cluster", "id")
    )


def key_points(problems: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Key points of the first knowledge row that matches a problem's id, field and subfield."""
    first = first_rows(knowledge, ["id", "field", "subfield"], F.col("seq"), ["keypoints"])
    return problems.join(first, ["id", "field", "subfield"], "left").withColumn("keypoints", F.coalesce("keypoints", F.lit("")))
