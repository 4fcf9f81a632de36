"""Incremental forms: running totals, an appended result table, hierarchy updates
per batch, and the pool of names seen per question. All run with a checkpoint in
the shared folder, so a restart adds nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolmill.operators.cluster import apply_operations


def running_totals(attempts: DataFrame) -> DataFrame:
    """Correct and total replies per model; the state is one row per model."""
    return attempts.groupBy("model").agg(F.count("*").alias("total"), F.sum("correctness").alias("correct"))


def admitted_names(retrievals: DataFrame) -> DataFrame:
    """Each name once per question, at its first appearance."""
    return retrievals.dropDuplicates(["question_id", "name"])


def admitted_names_within(retrievals: DataFrame, event_time: str, delay: str) -> DataFrame:
    """As above with state bounded by event time: names are forgotten after ``delay``."""
    return retrievals.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["question_id", "name"])


def append_results(stream: DataFrame, path: str, checkpoint: str):
    """Results appended to a Parquet table, exactly once and without rewriting it."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str):
    """Updated rows of each batch in a folder of its own; a repeated batch
    overwrites its folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last update of each key."""
    updates = spark.read.option("basePath", path).parquet(path)
    values = [c for c in updates.columns if c not in {*keys, "batch_id"}]
    picked = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def version_path(path: str, version: int) -> str:
    return f"{path}/version={version}"


def save_hierarchy(nodes: DataFrame, edges: DataFrame, path: str, version: int) -> None:
    nodes.write.mode("overwrite").parquet(f"{version_path(path, version)}/nodes")
    edges.write.mode("overwrite").parquet(f"{version_path(path, version)}/edges")


def read_hierarchy(spark: SparkSession, path: str, version: int, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """The hierarchy after ``version`` batches: the saved version ``base`` with the
    logged batches from there on applied in their order."""
    at = version_path(path, base)
    nodes, edges = spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges")
    if version == base:
        return nodes, edges
    log = spark.read.parquet(f"{path}/log").where(F.col("batch_id").between(base, version - 1))
    return apply_operations(nodes, edges, log.drop("batch_id"))


def compact(spark: SparkSession, path: str, version: int, base: int = 0) -> None:
    """Saves the hierarchy after ``version`` batches, so that later reads fold only newer ones."""
    save_hierarchy(*read_hierarchy(spark, path, version, base), path, version)


def hierarchy_updates(operations: DataFrame, path: str, checkpoint: str):
    """Appends each batch of operations to the change log, in a folder of its own: a batch
    costs what it holds, however large the tree, and a repeated one overwrites itself.
    Version 0 of the hierarchy must exist."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")

    return (
        operations.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
