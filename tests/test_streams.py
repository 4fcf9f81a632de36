"""Restarts add nothing and change nothing."""

from pyspark.sql import functions as F

from toolmill.operators.cluster import apply_operations
from toolmill.plans import streams
from toolmill.streaming import live


def source(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_append_survives_a_restart(spark, tmp_path):
    data, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.range(50).write.parquet(data)
    for _ in range(2):
        live.append_results(source(spark, data, "id bigint"), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 50
    spark.range(50, 60).write.mode("append").parquet(data)
    live.append_results(source(spark, data, "id bigint"), out, checkpoint).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(60))


def test_totals_over_two_arrivals(spark, tmp_path):
    data, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "model string, correctness bigint"
    for part in ([("a", 1), ("b", 0)], [("a", 0), ("a", 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(data)
        live.write_updates(live.running_totals(source(spark, data, schema)), out, checkpoint).awaitTermination()
    got = sorted(tuple(r) for r in live.latest(spark, out, ["model"]).select("model", "total", "correct").collect())
    assert got == [("a", 3, 2), ("b", 1, 0)]


def test_names_are_admitted_once(spark, tmp_path):
    data, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "question_id bigint, name string"
    for part in ([(1, "a"), (1, "a"), (2, "a")], [(1, "a"), (1, "b")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(data)
        live.append_results(live.admitted_names(source(spark, data, schema)), out, checkpoint).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_names_within_a_time_bound(spark, tmp_path):
    data, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = spark.range(20).select((F.col("id") % 2).alias("question_id"), F.lit("a").alias("name"), F.timestamp_seconds("id").alias("ts"))
    rows.write.parquet(data)
    names = live.admitted_names_within(source(spark, data, rows.schema), "ts", "1 hour")
    live.append_results(names, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_hierarchy_versions(spark, tmp_path):
    path, data, checkpoint = (str(tmp_path / n) for n in ("tree", "in", "checkpoint"))
    schema = "seq bigint, action string, node_id string, level bigint, parent string, add_children array<string>"
    nodes = spark.createDataFrame([("r", 0, None)], "id string, level bigint, parent string")
    edges = spark.createDataFrame([], "parent string, child string, seq bigint")
    live.save_hierarchy(nodes, edges, path, 0)
    parts = [[(1, "ADD_NODE", "a", 1, "r", None)], [(2, "MODIFY_NODE", "a", None, None, ["x"]), (3, "MODIFY_NODE", "q", None, None, ["y"])]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(data)
        live.hierarchy_updates(source(spark, data, schema), path, checkpoint).awaitTermination()
    got = [sorted(map(str, t.collect())) for t in live.read_hierarchy(spark, path, 2)]
    log = spark.createDataFrame(parts[0] + parts[1], schema)
    expected = [sorted(map(str, t.collect())) for t in apply_operations(nodes, edges, log)]
    assert got == expected


def test_compaction_changes_no_result_and_batches_cost_their_own_rows(spark, tmp_path):
    path, data, checkpoint = (str(tmp_path / n) for n in ("tree", "in", "checkpoint"))
    schema = "seq bigint, action string, node_id string, level bigint, parent string, add_children array<string>"
    nodes = spark.range(2_000).selectExpr("concat('n', id) AS id", "id % 5 AS level", "CAST(NULL AS string) AS parent")
    live.save_hierarchy(nodes, spark.createDataFrame([], "parent string, child string, seq bigint"), path, 0)
    parts = [[(i, "ADD_NODE", f"a{i}", 1, f"n{i}", None), (i + 10, "MODIFY_NODE", f"n{i}", None, None, [f"x{i}", "shared"])] for i in range(3)]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(data)
        live.hierarchy_updates(source(spark, data, schema), path, checkpoint).awaitTermination()
    live.hierarchy_updates(source(spark, data, schema), path, checkpoint).awaitTermination()  # a restart without news
    folded = [sorted(map(str, t.collect())) for t in live.read_hierarchy(spark, path, 3)]
    live.compact(spark, path, 2)
    assert [sorted(map(str, t.collect())) for t in live.read_hierarchy(spark, path, 3, 2)] == folded
    assert [r["count"] for r in spark.read.parquet(f"{path}/log").groupBy("batch_id").count().collect()] == [2, 2, 2]


def test_bounded_batches_with_a_restart(spark, tmp_path):
    """Many small batches, some before and some after a restart: totals stay right, state is a row per model."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = spark.range(400).selectExpr("concat('m', id % 3) AS model", "id % 2 AS correctness")
    batches = 0
    for part in (0, 200):
        rows.where(f"correctness = {part // 200}").repartition(4).write.mode("append").parquet(f"{folder}/attempts.parquet")
        run = live.write_updates(live.running_totals(streams.stream(spark, folder, "attempts", 1)), out, checkpoint)
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
        assert run.lastProgress["batchId"] >= batches + 3
        batches = run.lastProgress["batchId"] + 1
    got = {r["model"]: (r["total"], r["correct"]) for r in live.latest(spark, out, ["model"]).collect()}
    assert got == {r["model"]: (r["n"], r["c"]) for r in rows.groupBy("model").agg(F.count("*").alias("n"), F.sum("correctness").alias("c")).collect()}
