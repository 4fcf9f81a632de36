"""Set operations (U1-U5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.functions.schema import at, items, property_entries
from toolmill.operators import blocks
from toolmill.plans import roles
from toolmill.plans.aggregates import retrieved_names
from toolmill.plans.registry import query
from toolmill.sources.readers import table


@query("u1_matched_names", "SELECT question_id, name FROM r_truth INTERSECT SELECT question_id, name FROM r_retrieved")
def matched_names(spark, folder):
    return roles.truth(spark, folder).intersect(retrieved_names(spark, folder).select("question_id", "name"))


@query("u1_array_intersection", """SELECT event_id, list_aggregate(list_sort(list_intersect(a, b)), 'string_agg', ',') AS matched FROM (
    SELECT event_id, ['t' || (event_id % 3), 't' || (user_id % 4), 't9'] AS a, ['t' || (event_id % 5), 't' || (user_id % 2), 't9'] AS b FROM events)""")
def array_intersection(spark, folder):
    name = lambda column, n: F.concat(F.lit("t"), (F.col(column) % n).cast("string"))
    a = F.array(name("event_id", 3), name("user_id", 4), F.lit("t9"))
    b = F.array(name("event_id", 5), name("user_id", 2), F.lit("t9"))
    return table(spark, folder, "events").select("event_id", F.array_join(F.array_sort(F.array_intersect(a, b)), ",").alias("matched"))


@query("u2_missing_required", """WITH p AS (SELECT tool_id, json_extract(info, '$.function.parameters') AS j FROM r_tools WHERE json_type(info, '$.function.parameters') = 'OBJECT'),
    d AS (SELECT tool_id, j, unnest(json_keys(j, '$.properties')) AS name FROM p WHERE json_type(j, '$.properties') = 'OBJECT')
    SELECT tool_id, string_agg(name, ',' ORDER BY name) AS missing FROM d
    WHERE NOT list_contains(coalesce(CAST(json_extract(j, '$.required') AS VARCHAR[]), []), name) GROUP BY tool_id""")
def missing_required(spark, folder):
    p = at(F.col("info"), "$.function.parameters")
    names = F.transform(property_entries(p), lambda e: e["key"])
    required = F.transform(items(at(p, "$.required")), lambda x: F.try_variant_get(x, "$", "string"))
    tools = roles.parsed_tools(spark, folder).select("tool_id", F.array_sort(F.array_except(names, required)).alias("missing"))
    return tools.where(F.size("missing") > 0).select("tool_id", F.array_join("missing", ",").alias("missing"))


@query("u3_library_union", """SELECT tool_id, name, 'part' AS origin, p_type FROM r_tools UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier""")
def library_union(spark, folder):
    parts = roles.tools(spark, folder).select("tool_id", "name", F.lit("part").alias("origin"), "p_type")
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("tool_id"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return parts.unionByName(suppliers, allowMissingColumns=True)


@query("u4_merged_indices", """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat([o_orderkey % 7, o_custkey % 5], [o_custkey % 7, o_orderkey % 3]))), ',') AS covered FROM orders""")
def merged_indices(spark, folder):
    a = F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 5)
    b = F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 3)
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_union(a, b)).cast("array<string>"), ",").alias("covered"))


@query("u5_planned_except_completed", """SELECT DISTINCT cluster_name, sib_index FROM r_cover EXCEPT SELECT cluster_name, sib_index FROM r_final""")
def planned_except_completed(spark, folder):
    planned = roles.cover(spark, folder).select(*blocks.UNIT).distinct()
    return planned.exceptAll(roles.final_tools(spark, folder))
