"""Cluster hierarchy and the assignment of tools to it.

A hierarchy is two tables, ``nodes(id, level, parent)`` and
``edges(parent, child, seq)``: a node may have any number of children, so child
lists are rows and not one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.functions import fixed
from toolmill.operators.ordering import first_rows, number_rows
from toolmill.session import materialize


def complete_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes plus every child that has no row of its own (level of parent + 1, first
    parent by edge order), then the children of those, until no edge leads further.
    The tables are read once: only edges to unlisted children are kept, and after the first level
    only those whose parent is unlisted too are looked at, level by level.
    Edges that no listed node leads to add nothing (``unreached_edges``)."""
    known = nodes.select("id", "level", "parent")
    listed = known.select(F.col("id").alias("parent"), (F.col("level") + 1).alias("level"))
    missing = edges.select("parent", "child", "seq").join(known.select(F.col("id").alias("child")), "child", "left_anti")
    missing = materialize(missing.join(listed, "parent", "left"), "tree-missing")
    found = newest = _first_parents(missing.where("level IS NOT NULL"))
    deeper = missing.where("level IS NULL").drop("level")
    while not deeper.isEmpty():
        deeper = deeper.join(newest.select(F.col("id").alias("child")), "child", "left_anti")
        newest = materialize(_first_parents(deeper.join(newest.select(F.col("id").alias("parent"), (F.col("level") + 1).alias("level")), "parent")), "tree-level")
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
    return known.unionByName(found)


def _first_parents(listed: DataFrame) -> DataFrame:
    """Each child with the first of its edges."""
    return first_rows(listed, ["child"], F.struct("seq", "parent"), ["level", "parent"]).withColumnRenamed("child", "id")


def unreached_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent is in no node of a completed tree."""
    return edges.join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti")


def resolve_targets(assignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Target cluster of each tool and the rule that gave it: own id if it exists,
    else the deepest existing id of the path, else the last path id or the own id
    as a new flat node. Tools without any id have a null target (rule 'reject').

    Existence is judged against the completed hierarchy only.
    """
    path = F.coalesce(F.col("cluster_ids"), F.array().cast("array<string>"))
    steps = F.concat(F.array("cluster_id"), F.reverse(path))
    candidates = assignments.select("tool_id", F.col("cluster_id").alias("own"), path.alias("path"), F.posexplode(steps).alias("step", "id"))
    known = candidates.join(nodes.select("id", F.lit(True).alias("known")), "id", "left")
    # the tool decides own id and path; as grouping keys they leave a numeric buffer, so no task sorts
    nearest = known.groupBy("tool_id", "own", "path").agg(F.min(F.when(F.col("known"), F.col("step"))).alias("step"))
    last = F.try_element_at("path", F.lit(-1))
    return nearest.select(
        "tool_id",
        F.when(F.col("step") == 0, F.col("own")).otherwise(F.coalesce(F.try_element_at("path", -F.col("step")), last, "own")).alias("target"),
        F.when(F.col("step") == 0, "exact")
        .when(F.col("step") > 0, "path")
        .when(last.isNotNull(), "new_from_path")
        .when(F.col("own").isNotNull(), "new_from_own")
        .otherwise("reject")
        .alias("rule"),
    )


def eligible(cluster: Column, size: Column, minimum: int = fixed.CLUSTER_MIN) -> Column:
    return (size >= minimum) & ~F.contains(cluster, F.lit("}"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("n_tools"))


def split_evenly(members: DataFrame, position: str, maximum: int = fixed.CLUSTER_MAX, values: DataFrame | None = None) -> DataFrame:
    """Members with ``cluster_name``: clusters over the maximum become
    ceil(n / maximum) chunks of sizes that differ by at most one, larger first."""
    placed = number_rows(members, ["cluster_id"], position, "pos0", "cluster_size", values=values)
    n, pos = F.col("cluster_size"), F.col("pos0")
    chunks = F.ceil(n / maximum)
    base, rest = F.floor(n / chunks), n % chunks
    larger = rest * (base + 1)
    chunk = F.when(pos < larger, F.floor(pos / (base + 1))).otherwise(rest + F.floor((pos - larger) / base))
    return (
        placed.withColumn("chunk", F.when(n > maximum, chunk))
        .withColumn("chunk_pos", F.when(n <= maximum, pos).when(pos < larger, pos % (base + 1)).otherwise((pos - larger) % base))
        .withColumn(
            "cluster_name",
            F.when(F.col("chunk").isNull(), F.col("cluster_id")).otherwise(F.concat_ws("_", "cluster_id", F.col("chunk").cast("string"))),
        )
    )


# --- replies that assign tools ------------------------------------------------------

ASSIGNMENT_REPLY = (
    "struct<assignments:array<struct<tool_index:bigint,assigned_cluster_id:string,reasoning:string>>>"
)


def apply_assignments(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Cluster per (batch_id, batch_index) from reply texts: indices outside the
    batch are ignored, the last entry of a reply wins, tools nobody mentioned keep
    a null cluster and the reason."""
    listed = F.transform(
        F.from_json("reply", ASSIGNMENT_REPLY)["assignments"],
        lambda a, i: F.struct(
            i.alias("entry"), a["tool_index"].alias("batch_index"), a["assigned_cluster_id"].alias("cluster_id"),
            F.coalesce(a["reasoning"], F.lit("")).alias("reasoning"),
        ),
    )
    entries = replies.select("batch_id", F.inline(listed)).where(F.col("batch_index").isNotNull())
    chosen = entries.groupBy("batch_id", "batch_index").agg(
        F.max_by(F.struct("cluster_id", "reasoning"), "entry").alias("_a")
    )
    return batches.join(chosen, ["batch_id", "batch_index"], "left").select(
        *batches.columns,
        F.col("_a.cluster_id").alias("cluster_id"),
        F.when(F.col("_a").isNull(), fixed.NOT_ASSIGNED).otherwise(F.col("_a.reasoning")).alias("reasoning"),
    )


# --- operation log --------------------------------------------------------------------

def apply_operations(nodes: DataFrame, edges: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after an operation log ``(seq, action, node_id, level,
    parent, add_children)``. A link counts only if its parent existed when the
    operation ran; a child is linked to a parent once, at its first operation.
    Unknown nodes and actions change nothing, and applying a log twice is the
    same as applying it once. Edges keep the ``seq`` they carry, -1 without one.
    """
    adds = operations.where(F.col("action") == "ADD_NODE")
    existing = nodes.select("id", "level", "parent", F.lit(-1).cast("bigint").alias("born"))
    added = adds.select(F.col("node_id").alias("id"), "level", "parent", F.col("seq").alias("born"))
    all_nodes = first_rows(existing.unionByName(added), ["id"], F.col("born"), ["level", "parent", "born"])

    linked = adds.select("parent", F.col("node_id").alias("child"), "seq").unionByName(
        operations.where(F.col("action") == "MODIFY_NODE").select(
            F.col("node_id").alias("parent"), F.explode("add_children").alias("child"), "seq"
        )
    )
    births = all_nodes.select(F.col("id").alias("parent"), "born")
    valid = linked.join(births, "parent").where(F.col("born") <= F.col("seq")).drop("born")
    before = F.col("seq") if "seq" in edges.columns else F.lit(-1)
    merged = edges.select("parent", "child", before.cast("bigint").alias("seq")).unionByName(valid)
    all_edges = merged.groupBy("parent", "child").agg(F.min("seq").alias("seq"))
    return all_nodes.drop("born"), all_edges


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("parent").alias("id")), "id", "left_anti")


def level_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose child is not exactly one level below its parent."""
    parents = nodes.select(F.col("id").alias("parent"), F.col("level").alias("parent_level"))
    children = nodes.select(F.col("id").alias("child"), F.col("level").alias("child_level"))
    return (
        edges.select("parent", "child").join(parents, "parent").join(children, "child")
        .where(F.col("child_level") != F.col("parent_level") + 1)
    )


def non_leaf_assignments(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Assigned tools whose cluster has children."""
    return targets.where(F.col("target").isNotNull()).join(edges.select(F.col("parent").alias("target")), "target", "left_semi")
