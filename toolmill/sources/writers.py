"""Writers. Tables partition by a bounded bucket of the cluster name, never by
the name itself: clusters are as many as the data, folders must not be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_json_arrays(df: DataFrame, path: str, key: str, rows_per_file: int = 1_000) -> None:
    """Files that each hold one indented JSON array of at most ``rows_per_file``
    rows, cut by ranges of a unique integer key."""
    chunks = df.groupBy(F.floor(F.col(key) / rows_per_file)).agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows"))
    text = chunks.select(F.to_json("rows", {"pretty": "true"}).alias("value"))
    text.write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.select("tool_id", F.col("vec").cast("array<float>").alias("vec")).write.mode("errorifexists").parquet(path)


def write_by_cluster(df: DataFrame, path: str, buckets: int = BUCKETS, file_format: str = "parquet") -> None:
    """Rows in folders by cluster bucket; a large bucket is split over several
    files because rebalancing, unlike a plain repartition, may cut it."""
    bucketed = df.withColumn("cluster_bucket", F.pmod(F.xxhash64("cluster_name"), F.lit(buckets)))
    bucketed.hint("rebalance", "cluster_bucket").write.mode("errorifexists").partitionBy("cluster_bucket").format(file_format).save(path)


def final_tools(tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The thin projection (schema and code) and the full one (block, coverage,
    model) of the final tools."""
    thin = tools.select("cluster_name", "sib_index", "tool_info", "tool_code")
    return thin, tools


def write_final_tools(tools: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    thin, full = final_tools(tools)
    write_by_cluster(thin, f"{path}/final_openai_tools", buckets, "json")
    write_by_cluster(full, f"{path}/enhanced_tools_complete", buckets)


def write_blocks_with_tools(blocks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Covered tools of each block as rows, next to the block's content."""
    write_by_cluster(blocks, path, buckets)
