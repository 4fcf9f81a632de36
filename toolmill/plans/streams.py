"""Incremental forms (R1-R4): each runs the given table through a stream to its
end and returns what the stream left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolmill.plans import roles
from toolmill.plans.hierarchy import EDGES_SQL, NODES_SQL, base, operations
from toolmill.plans.registry import query
from toolmill.session import run_folder
from toolmill.sources.readers import table
from toolmill.streaming import live


BATCH_BYTES = 4 << 30  # of files in one micro-batch


def stream(spark: SparkSession, folder: str, name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A given table (one file, or a folder of files) as a stream of its files, in
    micro-batches of at most ``batch_bytes`` (one file at least)."""
    reader = spark.readStream.schema(table(spark, folder, name).schema).option("maxBytesPerTrigger", str(batch_bytes))
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parque[t]")  # a pattern finds a file as well as a folder


@query("r1_running_totals", "SELECT model, count(*) AS total, CAST(sum(correctness) AS BIGINT) AS correct FROM r_attempts GROUP BY model")
def running_totals(spark, folder):
    path = run_folder(spark, "r1")
    attempts = stream(spark, folder, "events").select(F.expr(roles.MODEL).alias("model"), F.expr(roles.CORRECT).alias("correctness"))
    live.write_updates(live.running_totals(attempts), f"{path}/updates", f"{path}/checkpoint").awaitTermination()
    return live.latest(spark, f"{path}/updates", ["model"])


@query("r2_appended_results", "SELECT event_id, question_id, model, correctness FROM r_attempts")
def appended_results(spark, folder):
    path = run_folder(spark, "r2")
    rows = stream(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("question_id"), F.expr(roles.MODEL).alias("model"), F.expr(roles.CORRECT).alias("correctness")
    )
    live.append_results(rows, f"{path}/results", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/results")


def updated_hierarchy(spark, folder):
    """The log arrives in three parts; the stream stops after each part and starts
    again from its checkpoint for the next. After the second part the log is compacted."""
    path = run_folder(spark, "r3")
    log = operations(spark, folder)
    last = log.agg(F.max("seq")).first()[0]
    nodes, edges = base(spark, folder)
    live.save_hierarchy(nodes, edges.withColumn("seq", F.lit(-1).cast("bigint")), f"{path}/hierarchy", 0)
    version = base_version = 0
    for part in range(3):
        arrived = log.where((F.col("seq") * 3 > last * part) if part else F.lit(True)).where(F.col("seq") * 3 <= last * (part + 1))
        arrived.write.mode("append").parquet(f"{path}/operations")
        arriving = spark.readStream.schema(log.schema).parquet(f"{path}/operations")
        run = live.hierarchy_updates(arriving, f"{path}/hierarchy", f"{path}/checkpoint")
        run.awaitTermination()
        version = run.lastProgress["batchId"] + 1
        if part == 1:
            live.compact(spark, f"{path}/hierarchy", version)
            base_version = version
    return live.read_hierarchy(spark, f"{path}/hierarchy", version, base_version)


@query("r3_streamed_nodes", NODES_SQL)
def streamed_nodes(spark, folder):
    return updated_hierarchy(spark, folder)[0]


@query("r3_streamed_edges", EDGES_SQL)
def streamed_edges(spark, folder):
    return updated_hierarchy(spark, folder)[1]


@query("r4_admitted_names", "SELECT DISTINCT question_id, name FROM r_retrievals")
def admitted_names(spark, folder):
    path = run_folder(spark, "r4")
    names = stream(spark, folder, "events").select(
        F.col("user_id").alias("question_id"),
        F.concat(F.lit("tool_"), (F.regexp_extract("props", "[0-9]+", 0).cast("bigint") % 40).cast("string")).alias("name"),
    )
    live.append_results(live.admitted_names(names), f"{path}/names", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/names")
