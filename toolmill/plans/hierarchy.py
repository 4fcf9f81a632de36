"""Cluster tree (H1-H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolmill.operators import cluster
from toolmill.plans import roles
from toolmill.plans.aggregates import completed_nodes
from toolmill.plans.joins import tool_targets
from toolmill.plans.registry import query
from toolmill.sources.readers import table

BASE_NODES = """SELECT 'r' || r_regionkey AS id, CAST(0 AS BIGINT) AS level, CAST(NULL AS VARCHAR) AS parent FROM region
    UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey FROM nation WHERE n_nationkey % 5 <> 4"""
BASE_EDGES = "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation"
ADDS = "SELECT 'c' || c_custkey AS id, CAST(2 AS BIGINT) AS level, 'n' || c_nationkey AS parent, c_custkey * 20 AS seq FROM customer"
NODES_SQL = f"SELECT id, level, parent FROM ({BASE_NODES}) UNION ALL SELECT id, level, parent FROM ({ADDS})"
EDGES_SQL = f"""WITH born AS (SELECT id, -1 AS born FROM ({BASE_NODES}) UNION ALL SELECT id, seq FROM ({ADDS})),
    links AS (SELECT parent, id AS child, seq FROM ({ADDS}) UNION ALL SELECT 'c' || o_custkey, 't' || (o_orderkey % 5), o_orderkey * 10 + 5 FROM orders
        UNION ALL SELECT 'c' || o_custkey, 'u' || o_orderkey, o_orderkey * 10 + 5 FROM orders)
    SELECT parent, child, min(seq) AS seq FROM (SELECT parent, child, CAST(-1 AS BIGINT) AS seq FROM ({BASE_EDGES})
        UNION ALL SELECT l.parent, l.child, l.seq FROM links l JOIN born ON born.id = l.parent AND born <= l.seq) GROUP BY ALL"""


def base(spark, folder):
    """Regions and listed nations; every nation is a child of its region."""
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    nodes = region.select(name("r", "r_regionkey").alias("id"), F.lit(0).cast("bigint").alias("level"), F.lit(None).cast("string").alias("parent")).unionByName(
        nation.where("n_nationkey % 5 <> 4").select(name("n", "n_nationkey").alias("id"), F.lit(1).cast("bigint").alias("level"), name("r", "n_regionkey").alias("parent"))
    )
    return nodes, nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))


def operations(spark, folder):
    """A log that adds every customer and hangs every order under its customer."""
    adds = table(spark, folder, "customer").select(
        (F.col("c_custkey") * 20).alias("seq"), F.lit("ADD_NODE").alias("action"), F.expr("concat('c', CAST(c_custkey AS STRING))").alias("node_id"),
        F.lit(2).cast("bigint").alias("level"), F.expr("concat('n', CAST(c_nationkey AS STRING))").alias("parent"), F.lit(None).cast("array<string>").alias("add_children"),
    )
    changes = table(spark, folder, "orders").select(
        (F.col("o_orderkey") * 10 + 5).alias("seq"), F.lit("MODIFY_NODE").alias("action"),
        F.expr(roles.CLUSTER).alias("node_id"), F.lit(None).cast("bigint").alias("level"), F.lit(None).cast("string").alias("parent"),
        F.expr("array(concat('t', CAST(o_orderkey % 5 AS STRING)), concat('u', CAST(o_orderkey AS STRING)))").alias("add_children"),
    )
    return adds.unionByName(changes)


@query("h1_nodes_after_operations", NODES_SQL)
def nodes_after_operations(spark, folder):
    return cluster.apply_operations(*base(spark, folder), operations(spark, folder))[0]


@query("h1_edges_after_operations", EDGES_SQL)
def edges_after_operations(spark, folder):
    return cluster.apply_operations(*base(spark, folder), operations(spark, folder))[1]


@query("h2_leaf_nodes", "SELECT id, level, parent FROM r_complete WHERE id NOT IN (SELECT parent FROM r_edges)")
def leaf_nodes(spark, folder):
    return cluster.leaves(completed_nodes(spark, folder), roles.edges(spark, folder))


@query("h3_levels", "SELECT level, count(*) AS nodes, (SELECT max(level) FROM r_complete) AS max_level FROM r_complete GROUP BY level")
def levels(spark, folder):
    nodes = completed_nodes(spark, folder)
    counts = nodes.groupBy("level").agg(F.count("*").alias("nodes"))
    return counts.select("level", "nodes", nodes.agg(F.max("level")).scalar().alias("max_level"))


@query("h4_level_violations", """SELECT e.parent, e.child, p.level AS parent_level, c.level AS child_level FROM r_edges e JOIN r_complete p ON p.id = e.parent
    JOIN r_complete c ON c.id = e.child WHERE c.level <> p.level + 1""")
def level_violations(spark, folder):
    return cluster.level_violations(completed_nodes(spark, folder), roles.edges(spark, folder))


@query("h5_non_leaf_assignments", "SELECT tool_id, target FROM r_targets WHERE target IN (SELECT parent FROM r_edges)")
def non_leaf_assignments(spark, folder):
    return cluster.non_leaf_assignments(tool_targets(spark, folder), roles.edges(spark, folder)).select("tool_id", "target")
