"""Properties that hold for any input."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toolmill.operators import cluster, metrics, ordering, retrieve
from toolmill.plans import QUERIES

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(sizes=st.lists(st.integers(1, 1900), min_size=1, max_size=3), maximum=st.integers(1, 400))
def test_chunks_are_even_and_complete(spark, sizes, maximum):
    rows = [(f"c{i}", i * 10_000 + j) for i, n in enumerate(sizes) for j in range(n)]
    members = spark.createDataFrame(rows, "cluster_id string, pos bigint")
    counts = cluster.split_evenly(members, "pos", maximum).groupBy("cluster_id", "cluster_name").count().collect()
    for i, n in enumerate(sizes):
        mine = [c["count"] for c in counts if c["cluster_id"] == f"c{i}"]
        assert sum(mine) == n and max(mine) <= maximum and max(mine) - min(mine) <= 1 and len(mine) == -(-n // maximum)


@FEW
@given(per_range=st.integers(1, 60), data=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 500)), unique_by=lambda r: r[1], min_size=1, max_size=80))
def test_numbering_in_ranges_is_row_number(spark, per_range, data):
    df = spark.createDataFrame(data, "k bigint, o bigint")
    got = sorted((r["k"], r["o"], r["pos0"], r["n"]) for r in ordering.number_rows(df, ["k"], "o", total="n", rows_per_range=per_range).collect())
    expected = []
    for k in {k for k, _ in data}:
        mine = sorted(o for key, o in data if key == k)
        expected += [(k, o, i, len(mine)) for i, o in enumerate(mine)]
    assert got == sorted(expected)


def brute_force(tools, queries, k):
    out = []
    for qid, q in queries:
        scored = []
        for tid, t in tools:
            length = np.linalg.norm(q) * np.linalg.norm(t)
            scored.append((-(round(float(np.dot(q, t)) / length, 6) + 0.0 if length else 0.0), tid))
        out += [(qid, tid, -s, r) for r, (s, tid) in enumerate(sorted(scored)[:k], 1)]
    return sorted((q, t, r) for q, t, _, r in out)


@pytest.mark.parametrize("k", [1, 4, 1000])
@pytest.mark.parametrize(("pivots", "cell_rows"), [(1, 7), (8, 4), (32, 1024)])
def test_top_k_equals_brute_force(spark, k, pivots, cell_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, size=(60, 8)).astype(float)  # small integers give many ties
    base[5] = 0
    tools = [(i, v.tolist()) for i, v in enumerate(base)]
    queries = [(100 + i, v.tolist()) for i, v in enumerate(base[:17])]
    t = spark.createDataFrame(tools, "tool_id bigint, vec array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id bigint, vec array<float>")
    got = retrieve.top_k(t, q, k, pivots, cell_rows).collect()
    assert sorted((r["query_id"], r["tool_id"], r["rank"]) for r in got) == brute_force(tools, queries, k)


def test_pivots_skip_most_pairs_of_clustered_vectors(spark):
    """Forty clusters: exact results from under a third of all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 1_500)] + 0.1 * rng.normal(size=(1_500, 16))
    tools = [(i, v.tolist()) for i, v in enumerate(points)]
    t = spark.createDataFrame(tools, "tool_id bigint, vec array<double>").repartition(3)
    q = t.where("tool_id % 15 = 0").withColumnRenamed("tool_id", "query_id")
    got = retrieve.top_k(t, q, 5).collect()
    assert sorted((r["query_id"], r["tool_id"], r["rank"]) for r in got) == brute_force(tools, [x for x in tools if x[0] % 15 == 0], 5)
    pairs = retrieve.pairs_multiplied(t, q, 5).first()
    assert 3 * pairs["multiplied"] < pairs["pairs"] == 150_000


def test_top_k_over_many_small_batches(spark, monkeypatch):
    """Best rows are carried over batches and query chunks of a task."""
    rng = np.random.default_rng(5)
    tools = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, size=(80, 4)).astype(float))]
    queries = [(i, v) for i, v in tools[:23]]
    monkeypatch.setattr(retrieve, "QUERY_CHUNK", 5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        t = spark.createDataFrame(tools, "tool_id bigint, vec array<float>").repartition(2)
        q = spark.createDataFrame(queries, "query_id bigint, vec array<float>")
        got = retrieve.top_k(t, q, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted((r["query_id"], r["tool_id"], r["rank"]) for r in got) == brute_force(tools, queries, 4)


@pytest.mark.parametrize(("pivots", "cell_rows"), [(1, 4), (8, 4)])
def test_top_k_in_bounded_blocks(spark, monkeypatch, pivots, cell_rows):
    """Many slices and groups, the same result; a block sends k rows a query, not k for every cell."""
    rng = np.random.default_rng(6)
    base = rng.integers(-2, 3, size=(120, 5)).astype(float)
    base[7] = 0
    tools = [(i, v.tolist()) for i, v in enumerate(base)]
    queries = tools[:40]
    t = spark.createDataFrame(tools, "tool_id bigint, vec array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id bigint, vec array<double>")
    first, _, rest = retrieve._phases(t, q, 3, pivots, cell_rows)
    sent = first.unionByName(rest).where("tool_id IS NOT NULL").groupBy("query_id").count().agg({"count": "max"}).first()[0]
    assert sent <= 2 * 3  # one slice: a row of results in each phase
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieve, "TOOL_CHUNK", 7)
    assert retrieve._parts(120) == 8
    got = retrieve.top_k(t, q, 3, pivots, cell_rows).collect()
    assert sorted((r["query_id"], r["tool_id"], r["rank"]) for r in got) == brute_force(tools, queries, 3)


def test_top_k_scores_copies_of_one_vector_in_bounded_pieces(spark, monkeypatch):
    """Every pair of copies ties at the best score: pairs are scored a bounded number at a time, the lowest ids stay."""
    scored = []
    unit = np.ones((200, 4)) / 2
    cells = retrieve._Cells(unit, np.arange(200)[::-1].copy(), np.zeros(200), 64)
    best = retrieve._Best(np.full(50, retrieve.NO_SCORE), 3)
    monkeypatch.setattr(retrieve, "PAIR_CHUNK", 128, raising=False)
    monkeypatch.setattr(np, "einsum", lambda *a, real=np.einsum: scored.append(len(a[1])) or real(*a))
    retrieve._multiplied(unit[:50], unit[:50].astype(np.float32), np.arange(50), cells, 0, 200, best)
    assert best.tool.reshape(50, 3).tolist() == [[0, 1, 2]] * 50 and (best.score == 1).all()
    assert max(scored) <= 128


@pytest.mark.parametrize("name", ["a12_tool_recall", "a13_recall_at_k", "j10_truth_hits", "u1_matched_names"])
def test_first_scores_of_top_k_are_computed_once(spark, name):
    """What a query joins its results with adds no filter that would make the first phase run twice."""
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final.count("FlatMapCoGroupsInArrow") == 2


def test_top_k_takes_slices_of_balanced_size():
    spans = [(64, 0, 0.0, 1.0, 200_000), (64, 1, 0.0, 1.0, 10), (64, 2, 0.0, 1.0, 12), (32, 0, 0.0, 1.0, 5)]
    slices = retrieve._slices(spans)
    assert slices[64, 0] == (0, 7) and slices[64, 1] == slices[64, 2] == (7, 1) and slices[32, 0] == (8, 1)
    assert np.bincount(retrieve._dealt(200_000, 7, 1)).max() <= retrieve.BLOCK_ROWS


@FEW
@given(data=st.lists(st.lists(st.booleans(), min_size=4, max_size=6), min_size=1, max_size=8))
def test_pass_at_k_grows_with_k(spark, data):
    rows = [(i, j, "m", int(c)) for i, q in enumerate(data) for j, c in enumerate(q)]
    attempts = spark.createDataFrame(rows, "question_id bigint, attempt bigint, model string, correctness bigint")
    shares = [r["pass_at_k"] for r in metrics.pass_at_k(attempts, [1, 2, 3, 4]).orderBy("k").collect()]
    assert shares == sorted(shares)
    assert shares == [pytest.approx(100 * sum(any(q[:k]) for q in data) / len(data)) for k in (1, 2, 3, 4)]


@pytest.mark.parametrize("dense", [True, False])
def test_a_hot_key_is_numbered_in_ranges(spark, dense):
    """A third of all rows in one key, a third without an order, ids dense or hashed: no
    range of a key has more than its share of rows."""
    order = F.col("id") if dense else F.xxhash64("id")
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("k"), F.when(F.col("id") % 3 != 1, order).alias("o"), F.col("id").alias("v"))
    numbered = ordering.number_rows(df, ["k"], "o", total="n", rows_per_range=9).collect()
    for key in ("hot", "1", "2"):
        mine = sorted((r["pos0"], r["o"] is None, r["o"] or 0) for r in numbered if r["k"] == key)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    cut = ordering._cut(df, "o", ordering.range_splits(df, "o", 9))
    assert max(r["count"] for r in cut.groupBy("k", "_span").count().collect()) <= 20


def test_pages_by_running_length(spark):
    """A conversation far over the bound: pages hold it in order, none over the bound and one line."""
    lines = [("a", 10 * i + i % 7, "x" * (i % 90)) for i in range(700)] + [("b", 5, "one"), ("c", 1, ""), ("d", 1, None)]
    df = spark.createDataFrame(lines, "k string, o bigint, t string")
    got = ordering.pages(df, ["k"], "o", F.col("t"), 500, rows_per_range=40).collect()
    mine = sorted((r for r in got if r["k"] == "a"), key=lambda r: r["o"])
    assert [r["page_pos"] for r in mine] == list(range(700)) and {r["n_pages"] for r in mine} == {mine[-1]["page"] + 1}
    held = {}
    for r in mine:
        held[r["page"]] = held.get(r["page"], 0) + len(r["t"])
    assert all(v <= 500 + 90 for v in held.values()) and len(held) > 50
    assert {(r["page"], r["n_pages"], r["page_pos"]) for r in got if r["k"] != "a"} == {(0, 1, 0)}


def test_sample_is_repeatable(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    pick = lambda: sorted(r["id"] for r in ordering.seeded_sample_per_group(df.repartition(7), ["g"], "id", 5).collect())
    assert pick() == pick() and len(pick()) == 15
    assert ordering.seeded_sample(df, "id", 9, seed=1).count() == 9
