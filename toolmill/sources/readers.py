"""Readers with explicit schemas. Rows that cannot be read go to a reject table
of their own; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolmill.functions import fixed
from toolmill.functions.schema import at, entries, is_array, is_object, is_string, items, text_at

CORRUPT = "_corrupt_record"
LIBRARY_SCHEMA = "cluster_name string, tools array<struct<tool_info:string,tool_code:string>>"


def _with_corrupt(schema: str | T.StructType) -> T.StructType:
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that each hold one JSON array. Such a file cannot be split: read it
    once and keep the rows as Parquet."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; a bad line keeps its text in ``_corrupt_record``, or fails the job if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.btrim("value", F.lit(fixed.BLANK)) != "")
    return lines.select(F.from_json("value", _with_corrupt(schema), options).alias("_r")).select("_r.*")


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


#: Columns of the given tables. A declared schema saves the job that would read file footers for it.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables, by its declared columns; any other by its own schema."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the files give fewer splits than there are cores
    (one small file, heavy work per row); a larger table is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


# --- library files ------------------------------------------------------------------------

def read_library(spark: SparkSession, folder: str, pattern: str = fixed.LIBRARY_FILES) -> DataFrame:
    """Tools of every library file below a folder, with name, schema and code. Files
    are one JSON document each; pass another pattern for JSON lines written by Spark."""
    files = (
        spark.read.schema(LIBRARY_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("multiLine", pattern == fixed.LIBRARY_FILES)
        .json(folder)
    )
    tools = files.select("cluster_name", F.posexplode("tools").alias("pos", "t"))
    info = F.try_parse_json("t.tool_info")
    return tools.where(F.col("t.tool_info").isNotNull() & F.col("t.tool_code").isNotNull()).select(
        "cluster_name",
        "pos",
        F.try_variant_get(info, "$.function.name", "string").alias("name"),
        F.col("t.tool_info").alias("tool_info"),
        F.col("t.tool_code").alias("code"),
    )


# --- cluster files ---------------------------------------------------------------------------

def clusters_long(documents: DataFrame, body: str = "body") -> DataFrame:
    """``(doc_id, cluster_name, pos, tool)`` of cluster documents in any of three
    shapes: an object with a ``clusters`` list, a list (of objects, or of bare tool
    lists), or an object from names to tool lists. Clusters without a name are
    ``cluster_<i>``."""
    parsed = documents.select("doc_id", F.try_parse_json(body).alias("v"))
    v = F.col("v")
    clusters = at(v, "$.clusters")
    pair = "array<struct<name:string,tools:array<variant>>>"

    def from_list(listed: Column) -> Column:
        return F.transform(
            items(listed),
            lambda c, i: F.struct(
                F.coalesce(text_at(c, "$.cluster_name"), F.concat(F.lit("cluster_"), i.cast("string"))).alias("name"),
                F.when(is_array(c), items(c)).otherwise(items(at(c, "$.tools"))).alias("tools"),
            ),
        )

    def from_names(named: Column) -> Column:
        return F.transform(entries(named), lambda e: F.struct(e["key"].alias("name"), items(e["value"]).alias("tools")))

    pairs = (
        F.when(is_array(clusters), from_list(clusters))
        .when(is_object(clusters), from_names(clusters))
        .when(is_array(v), from_list(v))
        .when(is_object(v), from_names(v))
        .otherwise(F.array().cast(pair))
    )
    return (
        parsed.select("doc_id", F.inline(pairs))
        .select("doc_id", F.col("name").alias("cluster_name"), F.posexplode("tools").alias("pos", "tool"))
    )


# --- extraction results ------------------------------------------------------------------------

def extracted_tools(results: DataFrame) -> DataFrame:
    """Tools of extraction results: the result text is an object with
    ``final_tools``, a bare list, or a JSON string of either. Status is not looked at."""
    v = F.try_parse_json("agent_result")
    unwrapped = F.when(is_string(v), F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    parsed = results.withColumn("_v", unwrapped)
    listed = F.when(is_array(F.col("_v")), items(F.col("_v"))).otherwise(items(at(F.col("_v"), "$.final_tools")))
    return parsed.select("qa_id", "question", "answer", F.posexplode(listed).alias("index", "t")).select(
        "qa_id",
        "index",
        at(F.col("t"), "$.tool_info").alias("tool_info"),
        F.coalesce(F.try_variant_get("t", "$.code", "string"), F.lit("")).alias("code"),
        F.col("question").alias("original_question"),
        F.col("answer").alias("original_answer"),
    )


def unreadable_results(results: DataFrame) -> DataFrame:
    return results.where(F.col("agent_result").isNotNull() & F.try_parse_json("agent_result").isNull()).select("qa_id", "agent_result")


def single_reasoning(column: str = "reasoning") -> Column:
    """A reasoning given as a JSON list becomes its first element."""
    v = F.try_parse_json(column)
    return F.when(is_array(v), F.try_variant_get(v, "$[0]", "string")).otherwise(F.col(column))


# --- finished work -----------------------------------------------------------------------------

def finished_units(spark: SparkSession, folder: str, pattern: str = fixed.LIBRARY_FILES) -> DataFrame:
    """Blocks ``(cluster_name, sib_index)`` that already have a final file, read
    from the paths of the output files only."""
    paths = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
        .select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))
    )
    unit = r"([^/=]+)_sib_(\d+)_final_openai_tools\.json"
    return (
        paths.where(F.col("path").rlike(unit))
        .select(F.regexp_extract("path", unit, 1).alias("cluster_name"), F.regexp_extract("path", unit, 2).cast("bigint").alias("sib_index"))
        .distinct()
    )


def blueprint_folders(spark: SparkSession, folder: str, pattern: str = fixed.BLUEPRINT_FILE) -> DataFrame:
    """Unit folders that hold a blueprint."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return paths.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("unit")).distinct()
